"""The corpus operators as queries over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.llm import decontaminate, divergence, langid, licenses, linededup, minhash, mixing, resample, simhash, syncmers, urlfilter, warc, wrappers
from sphaera.llm.common import WORD, read

DIMS = ("source", "lang", "topic")
ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")
BLOCKED_HOSTS = ("spam-farm.example.org", "ads-track.example.org", "cheap-pills.example.com", "casino-win.example.com", "free-bets.example.com")


def op1_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    docs = docs.withColumn("n_tokens", mixing.token_count(F.col("text")))
    docs = docs.withColumn("topic", mixing.topic_of(F.col("text"), F.col("n_tokens"))).drop("text")
    out = mixing.mix(docs, DIMS, "n_tokens")
    return out.select("doc_id", *DIMS, "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "copies")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.digest(licenses.scan(docs)).drop("last_end")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, ALLOW, BLOCK, BLOCKED_HOSTS).select("page_id", "host", "path", "rule", "verdict", "listed")


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_extract_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = wrappers.extract_articles(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made of pages: each is captured once in full, and a week later found not modified."""
    digest = F.md5(F.coalesce("html", F.lit("")))
    first = F.lit(1704067200) + F.col("page_id") * 60
    full = pages.select(
        F.concat(F.lit("full-"), F.col("page_id").cast("string")).alias("record_id"), "url", first.cast("long").alias("ts"), F.lit("response").alias("kind"),
        F.create_map(
            F.lit("etag"), F.concat(F.lit('"'), digest, F.lit('"')), F.lit("content-length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"),
            F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), first.cast("string"),
        ).alias("headers"), F.concat(F.lit("md5:"), digest).alias("payload_digest"),
    )
    later = first + 7 * 86400
    revisit = pages.select(
        F.concat(F.lit("revisit-"), F.col("page_id").cast("string")).alias("record_id"), "url", later.cast("long").alias("ts"), F.lit("revisit").alias("kind"),
        F.create_map(
            F.lit("etag"), F.concat(F.lit('W/"'), digest, F.lit('"')), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"),
            F.lit("date"), later.cast("string"), F.lit("x-cache"), F.lit("revalidated"),
        ).alias("headers"), F.lit(None).cast("string").alias("payload_digest"),
    )
    return full.unionByName(revisit)


def op8_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(captures(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return out.select("record_id", "canonical", "ts", "response_id", "outcome", "payload_digest", warc.header_lines(F.col("merged_headers")).alias("headers"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_resample_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.importance(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents").select("lang", "source", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_to_targets, op2_license_scan, op3_url_filter, op4_syncmer_fingerprints, op5_decontaminate,
        op6_simhash_near_dedup, op7_extract_articles, op8_resolve_revisits, op9_line_dedup, op10_language_id, op11_resample_to_target,
        op12_minhash_near_dedup, op13_source_divergence, pipeline,
    )
}


def _mix_sql(rounds: int = 60) -> str:
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    steps = [
        f"t as materialized (select doc_id, source, lang, text, {words} as n_tokens from documents)",
        "d as materialized (select doc_id, source, lang, n_tokens, case when n_tokens = 0 then 'empty' when (length(text) - length(replace(text, '|', ''))) * 20 >= n_tokens "
        "then 'table' when n_tokens < 50 then 'note' when n_tokens < 500 then 'page' else 'long' end as topic from t)",
        "c as materialized (select source, lang, topic, sum(n_tokens)::double as tokens from d group by all)",
        "total as materialized (select sum(tokens) as total from c)",
    ]
    for dim in DIMS:
        steps.append(f"flat_{dim} as materialized (select {dim} as value, pow(sum(tokens), {mixing.TEMPERATURE}) as share from c group by 1 having sum(tokens) > 0)")
        steps.append(f"goal_{dim} as materialized (select value, share / (select sum(share) from flat_{dim}) as share from flat_{dim})")
    steps.append("w0 as materialized (select *, tokens as weight from c)")
    n = 0
    for _ in range(rounds):
        for dim in DIMS:
            steps.append(
                f"w{n + 1} as materialized (select w.source, w.lang, w.topic, w.tokens, w.weight * case when s.now > 0 then coalesce(g.share, 0) * (select total from total) / s.now else 0 end as weight "
                f"from w{n} w join (select {dim} as v, sum(weight) as now from w{n} group by 1) s on w.{dim} is not distinct from s.v left join goal_{dim} g on s.v is not distinct from g.value)"
            )
            n += 1
    return (
        f"with {', '.join(steps)}, f as (select source, lang, topic, case when tokens > 0 then weight / tokens else 0 end as weight from w{n}), "
        "e as (select d.*, f.weight, round(f.weight, 7) as p from d join f on d.source is not distinct from f.source and d.lang is not distinct from f.lang and d.topic is not distinct from f.topic) "
        "select doc_id, source, lang, topic, n_tokens, round(weight, 6) as weight, round(least(p, 1.0), 6) as probability, "
        "cast(floor(p) + case when cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 8) as bigint) / 4294967296.0::double < p - floor(p) then 1 else 0 end as bigint) as copies from e"
    )


#: CRC-32 in SQL: the table of all bytes by its rule, then byte by byte over the UTF-8 of a word.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)))"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(w)), lambda i: cast('0x' || substr(hex(encode(w)), 2 * i + 1, 2) as bigint))), lambda c, x: xor(c >> 8, crc[xor(c, x) % 256 + 1])))"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_mix_to_targets": _mix_sql(),
    "op3_url_filter": f"""
with p as (select page_id, url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path from pages),
r(rule, h, pre, verdict) as (values ('org/', 'org', '/', 'allow'), ('com/fr/', 'com', '/fr/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
                             ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/de/', 'com', '/de/', 'block')),
f as (select page_id, url, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from p join r
      on (p.host = r.h or p.host like '%.' || r.h) and starts_with(p.path, r.pre) group by all),
l as (select *, {" or ".join(f"host = '{h}' or host like '%.{h}'" for h in BLOCKED_HOSTS)} as listed from p)
select l.page_id, l.host, l.path, f.rule, coalesce(f.verdict, case when listed then 'block' else 'allow' end) as verdict, listed
from l left join f on l.page_id = f.page_id and l.url is not distinct from f.url""",
    "op5_decontaminate": f"""
with d as materialized (select doc_id, regexp_extract_all({_LOWER}, '{WORD}') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '{WORD}') as w from benchmark),
win as materialized (select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s
        from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
place as materialized (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
          from d, (select distinct n from win) where len(w) >= n)),
hit as materialized (select p.doc_id, p.i, p.n, win.item from place p join win on p.n = win.n and p.s = win.s),
words as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from hit) group by 1),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct doc_id, item from hit) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id""",
    "op8_resolve_revisits": r"""
with p as (select page_id, url, md5(coalesce(html, '')) as digest, cast(octet_length(encode(coalesce(html, ''))) as varchar) as size, 1704067200 + page_id * 60 as ts,
                  regexp_replace(regexp_replace(url, '#[\s\S]*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') as rest from pages),
q as (select *, regexp_extract(rest, '^([^?]*)', 1) as before, regexp_extract(rest, '^[^?]*\?([\s\S]*)$', 1) as query from p),
k as (select *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?$'))) as kept from q),
c as materialized (select *, regexp_replace(regexp_replace(translate(regexp_extract(before, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', ''), ':(80|443)$', '')
        || regexp_replace(regexp_extract(before, '^[^/]*([\s\S]*)$', 1), '/+$', '') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as canonical from k),
j as (select r.page_id as rid, r.canonical, r.ts + 604800 as ts, r.digest as want, f.page_id as fid, f.digest as have, f.size as size
      from c r left join c f on r.canonical = f.canonical and f.ts < r.ts + 604800
      qualify row_number() over (partition by r.page_id order by f.ts desc nulls last, f.page_id desc) = 1)
select 'revisit-' || rid as record_id, canonical, ts, 'full-' || fid as response_id, case when fid is null then 'missing' when want = have then 'resolved' else 'mismatch' end as outcome,
       case when want = have then 'md5:' || have end as payload_digest,
       case when want = have then concat_ws(chr(10), 'cache-control: max-age=600', 'content-length: ' || size, 'content-type: text/html', 'date: ' || ts, 'etag: "' || have || '"', 'x-cache: revalidated') end as headers
from j""",
    "op11_resample_to_target": f"""
with d as materialized (select doc_id, regexp_extract_all({_LOWER}, '{WORD}') as w from documents),
b as materialized (select unnest(regexp_extract_all({_LOWER}, '{WORD}')) as w from benchmark),
f as materialized (select doc_id, unnest(w) as w from d),
names as materialized (select w, {_CRC} % 10000 as bucket from (select distinct w from (select w from f union all select w from b)), (select {_CRC_TABLE} as crc)),
src as (select bucket, count(*) as s from f join names using (w) group by 1),
tgt as (select bucket, count(*) as t from b join names using (w) group by 1),
n as (select (select count(*) from f) as s_all, (select count(*) from b) as t_all),
gain as materialized (select src.bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000)::double / ((s + 1)::double * (t_all + 10000)::double))) as bigint) as gain
         from src left join tgt on src.bucket = tgt.bucket cross join n),
total as (select doc_id, sum(gain) as gain from f join names using (w) join gain using (bucket) group by 1),
wt as (select d.doc_id, cast(len(w) as bigint) as n_features, case when len(w) = 0 then 0 else cast((gain - ((gain % len(w)) + len(w)) % len(w)) / len(w) as bigint) end as weight
       from d left join total on d.doc_id = total.doc_id),
sc as (select *, weight + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score from wt),
rk as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as place from sc)
select doc_id, n_features, weight, score, case when place <= (10 * (select count(*) from rk where n_features >= 20)) // 100 then place end as rank from rk""",
    "op12_minhash_near_dedup": rf"""
with recursive d as materialized (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i:i + 1], ' ') as shingle from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) as i from d where len(w) > 0)),
z as materialized (select doc_id, count(*) as n from s group by 1),
p as materialized (select a.doc_id as x, b.doc_id as y, count(*) as n from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
l as materialized (select x, y from p join z zx on zx.doc_id = x join z zy on zy.doc_id = y where 100 * p.n >= 80 * (zx.n + zy.n - p.n)),
e as materialized (select x, y from l union all select y, x from l),
reach as (select doc_id as a, doc_id as b from d union select reach.a, e.y from reach join e on reach.b = e.x)
select d.doc_id, coalesce(z.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from d left join z on d.doc_id = z.doc_id join (select a, min(b) as component_id from reach group by 1) c on c.a = d.doc_id""",
    "op13_source_divergence": r"""
with d as materialized (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
           list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from documents),
g as materialized (select distinct lang, source from d),
c as materialized (select id, lang, source, w as term, count(*) as n from (select id, lang, source, unnest(w) as w from d) group by all),
k as materialized (select lang, term, sum(n) as n from c group by all having count(*) >= 3),
lk as (select lang, count(*) as v, sum(n) as n from k group by lang),
gc as materialized (select lang, source, term, sum(c.n) as n from c join k using (lang, term) group by all),
gn as (select g.lang, g.source, coalesce(sum(n), 0) as n from g left join gc on g.lang = gc.lang and g.source = gc.source group by all),
p as materialized (select gn.lang, gn.source, k.term, coalesce(gc.n, 0) as n, 1 + cast(1000000000::hugeint * (coalesce(gc.n, 0) + 1) // (gn.n + lk.v) as bigint) as p
      from gn join lk on gn.lang = lk.lang join k on k.lang = gn.lang left join gc on gc.lang = gn.lang and gc.source = gn.source and gc.term = k.term),
q as (select k.lang, k.term, 1 + cast(1000000000::hugeint * (k.n + 1) // (lk.n + lk.v) as bigint) as q from k join lk using (lang)),
pv as (select a.lang, a.source, b.source as item, sum((a.p - b.p)::hugeint * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pr as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
       from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
tv as (select lang, source, 'term' as part, term as item, cast((p - q)::hugeint * (p - q) // q as bigint) as value from p join q using (lang, term) where n > 0 and p > q),
r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from (select * from pr union all select * from tv))
select * from r where part = 'pair' or rank <= 200""",
    "op9_line_dedup": r"""
with l as materialized (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents),
k as materialized (select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, r.key is not null and k.doc_id <> r.keeper as gone from k left join r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from m group by doc_id""",
}
