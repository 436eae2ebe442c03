"""Each operator against a plain version of itself on small and odd tables, and on a small test table."""

import hashlib
import html as html_lib
import json
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import pytest
import xxhash
from pyspark.sql import functions as F

from sphaera.llm import decontaminate, langid, licenses, linededup, mixing, queries, simhash, syncmers, urlfilter, warc, wrappers
from sphaera.llm.common import Bloom, hash_of, hot_above, join_hot

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LONG = "lorem ipsum dolor sit amet " * 5000
ODD = [
    (1, "Released under the MIT License.\nA line that is long enough to count", "en", "a"),
    (2, "a LINE that is long enough to count  \nReleased under the MIT license.", "en", "a"),
    (3, "\tA line that is long enough to count\nand something else entirely here", "en", None),
    (3, "\tA line that is long enough to count\nand something else entirely here", "en", None),
    (4, None, None, "b"),
    (5, "", "fr", "b"),
    (6, "   \n\n \t", "fr", "b"),
    (7, "word", "de", "b"),
    (8, LONG, "en", "c"),
    (9, LONG + "x", "en", "c"),
    (10, "12345 !!! ???", "es", "c"),
    (11, "ÀÉÎ straße Ünïcode K ſ\x00\x01", "de", "c"),
    (None, "A line that is long enough to count", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "clash") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(t):
    return WORDS.findall((t or "").translate(LOWER))


# mixing


def test_mix_meets_targets(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, "xy"[i % 5 > 1], 10 + i % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n long")
    goal = {"source": [("a", 0.5), ("b", 0.2), ("c", 0.2), (None, 0.1)], "lang": [("x", 0.7), ("y", 0.3)]}
    targets = {d: spark.createDataFrame(v, "value string, share double") for d, v in goal.items()}
    out = mixing.mix(df, ("source", "lang"), "n", targets).collect()
    assert len(out) == 3000
    total = sum(r["n"] for r in out)
    for d, shares in goal.items():
        for value, share in shares:
            assert sum(r["n"] * r["weight"] for r in out if r[d] == value) / total == pytest.approx(share, abs=1e-3)
            assert sum(r["n"] * r["copies"] for r in out if r[d] == value) / total == pytest.approx(share, abs=0.05)
    assert all(r["probability"] == min(1, round(r["weight"], 7)) for r in out)


def test_mix_in_rounds_of_jobs(spark, docs):
    cells = docs.groupBy("source", "lang").agg(F.sum(mixing.token_count(F.col("text"))).alias("tokens"))
    targets = {d: mixing.tempered(cells, d) for d in ("source", "lang")}
    one, many = (mixing.rake(cells, targets, cells_in_task=n).select("source", "lang", F.round("weight", 4)).collect() for n in (1000, 0))
    assert sorted(one, key=repr) == sorted(many, key=repr) and len(one) > 4


def test_mix_odd(odd, empty):
    df = odd.withColumn("n", mixing.token_count(F.col("text")))
    out = mixing.mix(df, ("source", "lang"), "n").collect()
    assert len(out) == len(ODD) and all(r["weight"] == 0 for r in out if r["n"] == 0)
    assert mixing.mix(empty.withColumn("n", F.lit(1)), ("source", "lang"), "n").count() == 0


# licences


def plain_licenses(text):
    w, found = words(text), []
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(spark, odd, empty, docs):
    more = [(9100, "MIT license mit MIT LICENSE apache-license General\nPublic license gnu general public license"), (9101, "licensed under CC BY-NC 4.0"), (9102, "license general public")]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).unionByName(docs.select("doc_id", "text"))
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = licenses.digest(licenses.scan(df)).collect()
    want = sorted(((i, *plain_licenses(t)) for i, t in texts), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr) == want
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert {r["labels"] for r in got if r["doc_id"] == 9101} == {"cc-by-nc"}
    assert licenses.digest(licenses.scan(empty)).count() == 0


def test_license_labels_and_scores(spark):
    """Labels, places and scores of all templates against a plain search of their key phrases."""
    pick, texts = random.Random(9), []
    for t in licenses.TEMPLATES:
        edited = ["reworded" if pick.random() < 0.2 else w for w in t.words]
        cut = list(t.words[max(0, t.key_at - 1) :])
        texts += [" ".join(t.words), "See: " + " ".join(edited).upper() + ".", " ".join(["x"] * 5 + cut + ["y"] + cut), " ".join(reversed(t.words))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    files = [words(t) for t in texts] + [[], []]
    idf = lambda w: math.log((len(files) + 1) / (sum(w in f for f in files) + 0.5))
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    found = 0
    for i, f in enumerate(files[:-2]):
        want, best = [], 0.0
        for t in licenses.TEMPLATES:
            total = sum(map(idf, t.words))
            for s in range(len(f) - t.key_words + 1):
                if tuple(f[s : s + t.key_words]) == t.key:
                    want.append((t.label, s))
                    best = max(best, sum(idf(w) for k, w in enumerate(t.words) if 0 <= s + k - t.key_at < len(f) and f[s + k - t.key_at] == w) / total)
        found += len(want)
        assert [(p["label"], p["start"]) for p in got[i]["places"]] == want and got[i]["score"] == pytest.approx(best)
    assert found > 60 and got[900]["places"] == [] == got[901]["places"]


# URLs


@pytest.mark.parametrize("bits", [urlfilter.MAX_LEVEL_BITS, 64])
def test_url_filter(spark, bits):
    urls = [
        None, "", "nothing", "http://", "HTTP://A.Example.ORG/es/1?x#y", "https://example.org/en/1234", "http://example.org/en/2", "http://x.com/fr/", "ftp://com/de/x",
        "http://org/", "http://org", "http://notexample.org/es/", "http://spam-farm.example.org", "http://a.spam-farm.example.org?q=/es/", "http://a/b://c.org/", "x\n://com/fr/\n",
    ]
    urls += ["http://" + "a." * 20_000 + "example.org/es/", "http://x.org/" + "p" * 100_000, "http://x.org/" + "p" * 100_000]
    urls += [f"http://h{i}.{d}/{p}/{i}" for i in range(300) for d in ("com", "org", "net") for p in ("de", "fr", "es")]
    rows = [(i, u) for i, u in enumerate(urls)]
    rules = [(r, a) for a, x in (("allow", queries.ALLOW), ("block", queries.BLOCK)) for r in x]
    got = by_id(urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)), queries.ALLOW, queries.BLOCK, queries.BLOCKED_HOSTS, max_level_bits=bits), "page_id")
    for i, u in rows:
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOWER)
        under = lambda h: host == h or host.endswith("." + h)
        fits = [(len(r), r, a) for r, a in rules if under(r[: r.index("/")]) and path.startswith(r[r.index("/") :])]
        listed = any(map(under, queries.BLOCKED_HOSTS))
        _, rule, verdict = max(fits, default=(0, None, "block" if listed else "allow"))
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) == (host, path, rule, verdict, listed), u
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), queries.ALLOW, queries.BLOCK).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.where("xxhash64(key) % 9 = 0")
    levels = urlfilter.build_cascade(listed, universe)
    wrong = universe.join(listed.withColumn("yes", F.lit(True)), "key", "left").where(urlfilter.in_cascade(F.col("key"), levels) != F.coalesce("yes", F.lit(False)))
    assert len(levels) > 1 and wrong.count() == 0


# syncmers


def plain_anchors(text, k=syncmers.K, s=syncmers.S):
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(*hashes):
        seed = 42
        for h in hashes:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return seed

    n = len(text)
    if n < k:
        return [xxhash.xxh64_intdigest(text.encode(), 42) >> 32] if text else []
    runs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in text]
    for step in (1, 2, 4):
        runs = [chain(a, b) for a, b in zip(runs, runs[step:])]
    small, w = list(map(signed, runs)), k - s + 1
    return [chain(runs[i], runs[i + w - 1]) >> 32 for i in range(n - k + 1) if min(small[i], small[i + w - 1]) == min(small[i : i + w])]


def test_syncmers(spark, odd, empty, docs):
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        got = sorted(syncmers.edited_fingerprints(df).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        assert len(got) == len(rows)
        sketches = [sorted(set(plain_anchors(t)))[: syncmers.SKETCH] for _, t in rows]

        def alike(a, b):
            union = sorted({*a, *b})[: syncmers.SKETCH]
            return len(set(a) & set(b) & set(union)) / len(union) if union else 1.0

        for i, ((d, t), r) in enumerate(zip(rows, got)):
            j = (i + 1) % len(rows)
            cut = len(t) // 4
            edited = t[: len(t) - cut] + rows[j][1][:cut]
            e = sorted(set(plain_anchors(edited)))[: syncmers.SKETCH]
            text = lambda x: "".join(f"{v:08x}" for v in x)
            assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (d, len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r["fingerprint"], r["edited_fingerprint"]) == (text(sketches[i]), text(e))
            assert r["near_edited"] == pytest.approx(alike(sketches[i], e)) and r["near_next"] == pytest.approx(alike(sketches[i], sketches[j]))
    assert syncmers.edited_fingerprints(empty).count() == 0


@pytest.mark.parametrize("alphabet", ["abcdefghij ", "\u4e2d\u6587\u5b57\u6c49\u8bed\u8a00\u65e5\u672c", "\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437", "\U0001f600\U0001f601\U0001f602\U0001f603"])
def test_unchanged_parts_show_in_every_script(spark, alphabet):
    pick = random.Random(8)
    rows = [(i, "".join(pick.choice(alphabet) for _ in range(2000))) for i in range(20)]
    got = syncmers.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["near_edited"] > 0.35 and r["near_next"] < 0.2 for r in got)
    assert sum(r["near_edited"] for r in got) / 20 == pytest.approx(0.6, abs=0.1)


def test_matches_find_a_moved_passage(spark, docs):
    passage = next(r["text"] for r in docs.collect() if len(r["text"]) > 1500)[:1000]
    df = spark.createDataFrame([(passage, "x" * 300 + passage)], "p string, q string")
    df = syncmers.fingerprints(df, "p").withColumnRenamed("anchors", "a").drop("sketch")
    df = syncmers.fingerprints(df, "q").withColumnRenamed("anchors", "b")
    assert syncmers.matches(df, "a", "b").first()["matches"][0]["shift"] == 300


# decontamination


@pytest.mark.parametrize("block", [{}, {"block_windows": 40}, {"block_bytes": 30_000}])
def test_decontaminate(spark, odd, empty, docs, block):
    bench = spark.createDataFrame(
        [(1, "A line that is long enough to count"), (2, "word"), (3, None), (4, "..."), (None, "and something ELSE entirely"), (10, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum")],
        "item_id long, text string",
    ).unionByName(spark.read.parquet(f"{SF}/benchmark.parquet"))
    items = [("null" if r["item_id"] is None else str(r["item_id"]), words(r["text"])) for r in bench.collect()]
    windows = defaultdict(set)
    for item, w in items:
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    lengths = {len(w) for w in windows}
    df = odd.select("doc_id", "text", F.lit(1).alias("hits")).unionByName(docs.select("doc_id", "text", F.lit(1).alias("hits")))
    got = Counter((r["doc_id"], r["n_words"], tuple(r["hits"]), tuple(r["items"])) for r in decontaminate.contamination(df, bench, **block).collect())
    want = Counter()
    for r in df.collect():
        w, hit, found = words(r["text"]), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        want[r["doc_id"], len(w), tuple(sorted(hit)), tuple(sorted(found))] += 1
    assert got == want
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.where("false")).where("size(hits) > 0").count() == 0


def test_remove_spans(spark):
    df = spark.createDataFrame([(1, "Keep this. Cut, that one! Keep the rest.")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "cut that one")], "item_id long, text string")
    found = decontaminate.contamination(df, bench)
    assert decontaminate.remove_spans(found).first()["clean_text"] == "Keep this. ! Keep the rest."
    assert decontaminate.without_contaminated(df.withColumn("hits", F.lit(1)), bench).count() == 0


# SimHash


def plain_simhash(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("limit", [simhash.BUCKET_LIMIT, 3])
def test_near_duplicates(odd, empty, docs, limit):
    df = odd.select("doc_id", "text").where("doc_id is not null").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = [(r["doc_id"], plain_simhash(r["text"])) for r in df.collect()]
    fps = {f for _, f in rows}
    groups = plain_components(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4])
    low = {}
    for d, f in rows:
        low[groups[f]] = min(d, low.get(groups[f], d))
    got = simhash.near_duplicates(df, bucket_limit=limit).select("doc_id", simhash.fp_hex(F.col("fp")).alias("fp"), "component_id")
    assert Counter(map(tuple, got.collect())) == Counter((d, f"{f:016x}", low[groups[f]]) for d, f in rows)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(odd).count() == len(ODD)


def test_covering_masks_cover_every_pair_of_bits_within_the_radius():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31 and all(m.bit_count() >= 32 for m in masks)
    import random

    rng = random.Random(1)
    for _ in range(2000):
        differing = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & differing for m in masks)


def test_larger_buckets_and_shared_points(spark):
    import random

    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = sorted({0x123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    near = [(signed(a), signed(b)) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4]
    fps = sorted(map(signed, fps))
    want = plain_components(fps, near)
    for limit in (10_000, 20):
        got = {r["node"]: r["component"] for r in simhash.components(simhash.fingerprint_links(df, bucket_limit=limit)).collect()}
        assert {f: got.get(f, f) for f in fps} == want


def test_near_copies(spark, docs):
    texts = [r["text"] for r in docs.collect() if len(r["text"].split()) > 150][:6]
    edit = lambda t, i: " ".join(w if j != i else "changed" for j, w in enumerate(t.split()))
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, edit(t, 20)) for i, t in enumerate(texts)] + [(200, texts[0]), (201, None), (202, ""), (None, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    kept = [r["doc_id"] for r in simhash.without_near_copies(df).collect()]
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    assert all(len(a & b) / len(a | b) < 0.5 for a, b in combinations(sets, 2))
    assert sorted(kept, key=repr) == sorted([None, 0, 2, 3, 4, 5, 201], key=repr)
    assert simhash.without_near_copies(df.where("false")).count() == 0


def plain_groups(texts, similarity=0.8):
    """Components of all pairs of five-word similarity, each as the set of its ids; and how many pairs."""
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.split()]}
    group, pairs = {i: {i} for i in sets}, 0
    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
            pairs += 1
            if group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    return {frozenset(g) for g in group.values()}, pairs


@pytest.mark.parametrize("limits", [{}, {"bands": 100, "band_rows": 2}])
def test_near_copies_with_replaced_passages(spark, limits):
    pick = random.Random(7)
    fresh = lambda n: [f"w{pick.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n in (40, 200, 1200):
        for i in range(8):
            base = fresh(n)
            texts.append(base)
            for share in (0.02, 0.04, 0.06, 0.09):
                k, at = max(1, round(n * share)), pick.randrange(n // 2)
                texts.append(base[:at] + fresh(k) + base[at + k :])
    passage = fresh(60)
    texts += [passage + fresh(15) for _ in range(30)]
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    want, pairs = plain_groups(texts)
    assert pairs > 80
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = defaultdict(set)
    for r in simhash.near_copy_groups(df, **limits).collect():
        got[r["group"]].add(r["doc_id"])
    assert set(map(frozenset, got.values())) == want


def test_near_copies_beside_a_reordering(spark):
    """Texts of the same distinct words have one fingerprint; the two alike are found whichever is smallest."""
    rows, pick = [], random.Random(3)
    for g in range(8):
        words = [f"g{g}w{i}" for i in range(120)]
        mixed = words[:]
        pick.shuffle(mixed)
        rows += [(3 * g, " ".join(mixed)), (3 * g + 1, " ".join(words)), (3 * g + 2, " ".join(words + words[:8]))]
    got = {r["doc_id"]: r["group"] for r in simhash.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[3 * g + 1] == got[3 * g + 2] != got[3 * g] for g in range(8))


def test_near_copies_in_pairs_of_one_vocabulary(spark):
    """Pairs that are alike among texts of the same distinct words, which are all in one list of the tables."""
    pick, rows = random.Random(5), []
    words = [f"w{i}" for i in range(150)]
    for g in range(4):
        pick.shuffle(words)
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words + words[:3]))]
    kept = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 6]


def test_near_copies_in_a_large_list(spark):
    """Two hundred texts that share most of a passage, in groups that are alike within and not across."""
    pick, texts = random.Random(6), {}
    passage = [f"p{i}" for i in range(150)]
    for g in range(50):
        own = passage + [f"g{g}w{i}" for i in range(60)]
        for v in range(4):
            at = pick.randrange(len(own) - 4)
            texts[4 * g + v] = " ".join(own[:at] + [f"g{g}v{v}"] + own[at + 1 :])
    want, pairs = plain_groups(texts)
    assert len(want) == 50 and pairs == 300
    got = defaultdict(set)
    for r in simhash.near_copy_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        got[r["group"]].add(r["doc_id"])
    assert set(map(frozenset, got.values())) == want


def test_hot_keys_join_alike(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.max("id").alias("most"), F.count("*").alias("n")).where("k < 2000")
    assert sorted(map(tuple, join_hot(left, right, "k").collect())) == sorted(map(tuple, left.join(right.drop("n"), "k").collect()))


def test_hot_keys_are_bounded_in_rows_and_in_number():
    for total in (0, 100, 10**6, 10**9, 10**12, 10**15):
        most = hot_above(total)
        assert most <= total / 256 and (most + 1) * 65_536 > total or total < 256 * 65_536
        assert most <= max(1_000_000, total / 65_536)
        assert total // (most + 1) <= 65_536


def test_bloom_filters_miss_no_key(spark):
    keys = spark.range(0, 400_000, 7).select(hash_of(F.col("id")).alias("h"))
    passed = {r["id"] for r in spark.range(400_000).where(Bloom(keys).maybe(hash_of(F.col("id")))).collect()}
    assert set(range(0, 400_000, 7)) <= passed and len(passed) < 70_000
    assert spark.range(10).where(Bloom(keys.where("false")).maybe(hash_of(F.col("id")))).count() == 0


# pages


def test_extract_articles(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = by_id(wrappers.extract_articles(spark.read.parquet(f"{SF}/pages.parquet")), "page_id")
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inner)
        lines = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
        assert got[r["page_id"]]["text"] == "\n".join(filter(None, lines))


PAGE = """<html><head><title>T</title></head><body><div class="menu"><a>Home</a></div><div id=top><header>Site</header>{ad}
<div class=body><h2>{h}</h2><p>{p} &amp; more<p>Second  paragraph {p}<div class="user-comments">nice</div><aside>x</aside><form>f</form>
<script>var a = "<p>no</p>";</script><style>p{{}}</style><p hidden>no<ul><li>one<li>two</ul></div><div class=legal>Copyright by the company</div></div></body></html>"""


def test_wrapper_finds_the_region_without_marks(spark):
    rows = [(i, f"http://h.org/{i}", PAGE.format(ad='<div class="ad">buy</div>' if i % 2 else "", h=f"Head {i}", p=f"words of page number {i} " * 5)) for i in range(12)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://only.one/", "<p>Just &lt;this&gt;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(4)
    got = by_id(wrappers.extract_articles(df), "page_id")
    for i in range(12):
        p = f"words of page number {i} " * 5
        assert got[i]["text"] == f"Head {i}\n{' '.join(p.split())} & more\nSecond paragraph {' '.join(p.split())}\none\ntwo"
    assert (got[100]["text"], got[101]["text"], got[102]["text"]) == ("", "", "Just <this>")
    assert wrappers.extract_articles(df.where("false")).count() == 0


def test_alignment_makes_optional_repeated_and_slots():
    one = wrappers.fold(wrappers.parse("<div><h1>A</h1><p>x</p><p>y</p><b>k</b></div>"))
    two = wrappers.fold(wrappers.parse("<div><h1>B</h1><table>t</table><p>x</p></div>"))
    assert wrappers.expression(wrappers.align(one, two)) == "<root><div><h1>#slot</> (<table>#text</>)? (<p>#slot</>)+ (#slot)?</></>"
    assert json.loads(json.dumps(one)) == one


def articles_of(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = by_id(wrappers.extract_articles(df), "page_id")
    return [got[i]["text"] for i in range(len(pages))]


def test_marks_decide_by_page(spark):
    """A host with some marked articles: the others get a wrapper of their own, whose template texts go."""
    plain = "<body><div>Home</div><div class=x><p>Text {0} of this page</p></div><div>Imprint</div></body>"
    marked = "<body><div>Home</div><main><h1>Title {0}</h1><div>Subscribe here</div><p>Text {0}</p></main></body>"
    got = articles_of(spark, [(marked if i < 5 else plain).format(i) for i in range(10)])
    assert got == [f"Title {i}\nSubscribe here\nText {i}" if i < 5 else f"Text {i} of this page" for i in range(10)]
    copies = articles_of(spark, [marked.format(0)] * 4)
    assert copies == ["Title 0\nSubscribe here\nText 0"] * 4


@pytest.mark.parametrize("n", [1, 3, 40])
def test_marked_articles_lose_nothing_to_other_pages(spark, n):
    """Headings that all articles of a host have stay, however many pages the host has; so does a paragraph like one."""
    page = "<body><div>Menu</div><article><h1>Title {0}</h1><h2>Overview</h2><p>text {0}</p><h2>Sources</h2><ul><li>one {0}</ul><p>{1}</p></article></body>"
    got = articles_of(spark, [page.format(i, "Overview" if i == 0 else f"end {i}") for i in range(n)])
    assert got == [f"Title {i}\nOverview\ntext {i}\nSources\none {i}\n{'Overview' if i == 0 else f'end {i}'}" for i in range(n)]


def test_forms_around_a_page_are_containers(spark):
    around = "<body><form id=aspnetForm><input type=hidden value=x><div>Menu</div><article><h1>Title {0}</h1><p>text {0}</p><form>inner</form></article></form></body>"
    assert articles_of(spark, [around.format(i) for i in range(4)]) == [f"Title {i}\ntext {i}" for i in range(4)]
    plain = "<form><div>Menu</div><div><p>a first paragraph {0}</p><p>and a second one</p></div><fieldset>choose</fieldset></form>"
    assert wrappers.extract(plain.format(1)) == "Menu\na first paragraph 1\nand a second one"
    assert wrappers.extract("<article><p>text of the page</p><form><p>Your mail</p></form></article>") == "text of the page"
    assert wrappers.extract("<div>text</div><form hidden><article>x</article></form>") == "text"
    assert wrappers.extract("<form><label>User</label><input><button>Log in</button></form>") == ""


def test_formulas_titles_and_invisible_characters():
    assert wrappers.extract("<article><p>so <math><mi>a</mi><mo>+</mo><msup><mi>b</mi><mn>2</mn></msup><annotation>tex</annotation></math> holds</p></article>") == "so a+b2 holds"
    assert wrappers.extract("<title>Site</title><p>a\u200bb c\ufeffd\u00a0\n e</p>") == "a\u200bb c\ufeffd e"


LAYOUTS = [
    "<div class='content-sidebar-wrap'><main>{}</main></div>", "<main class='content no-sidebar'>{}</main>", "<article class='post comments-open'>{}</article>",
    "<div id='page' class='site has-sidebar'><p>{}</p></div>", "<div class='sidebar'><main>{}</main></div>", "<main class='overlay'>{}</main>", "<div class='widget'><p>{}</p></div>",
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_names_of_layouts_keep_the_article(layout):
    page = layout.format("words <b>here</b>") + "<nav>Menu</nav>"
    assert wrappers.extract(page) == "words here"


def test_comments_stay_out():
    assert wrappers.extract("<article>a</article><section id=comments><article>b</article></section>") == "a"
    assert wrappers.extract("<p>a</p><div class='comments'><p>b</p></div><div class='user-comments'>c</div>") == "a"


def test_region_keeps_titles_leads_and_positions(spark):
    body = "long text {0} " * 30
    beside = "<body><div>Home</div><div id=content><h1>Title {0}</h1><p class=lead>Lead {0}</p><div class=body>" + body + "</div></div></body>"
    long = [" ".join(body.format(i).split()) for i in range(6)]
    assert articles_of(spark, [beside.format(i) for i in range(6)]) == [f"Title {i}\nLead {i}\n{long[i]}" for i in range(6)]
    later = "<body><div>logo</div><h1>News</h1><div><p>" + body + "</p></div></body>"
    assert articles_of(spark, [later.format(i) for i in range(6)]) == long


def test_articles_without_their_marks(spark):
    """The same pages with plain elements in place of the marks: their wrappers find the same articles."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = pages.groupBy(urlfilter.host_of(F.col("url")).alias("h")).count().where("count >= 3").select("h")
    pages = pages.join(hosts, urlfilter.host_of(F.col("url")) == hosts["h"], "left_semi")
    plain = pages.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    want, got = (by_id(wrappers.extract_articles(x), "page_id") for x in (pages, plain))
    assert len(want) > 100 and all(got[i]["text"] == want[i]["text"] for i in want)


def test_wrappers_do_not_depend_on_the_order_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("html", F.regexp_replace("html", "<(p|h1)>", "<$1 class='$1'>"))
    odd = [(i, "http://h.org/", "<div>" + "".join(f"<{t}>{i}</{t}>" for t in x) + "</div>") for i, x in enumerate((["p", "table"], ["ul", "p"], ["table", "ul", "p", "ol"], ["ol", "p", "table"]))]
    pages = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    found = [sorted(map(tuple, wrappers.infer_wrappers(x).collect())) for x in (pages.coalesce(1), pages.repartition(7), pages.orderBy(F.desc("page_id")).repartition(3, "page_id"))]
    assert found[0] == found[1] == found[2] and len(found[0]) > 10


def test_alignment_is_a_longest_common_subsequence():
    pick = random.Random(4)
    for _ in range(300):
        a, b = ([pick.choice("abc") for _ in range(pick.randrange(8))] for _ in "ab")
        got = wrappers.common_subsequence(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p < q and r < s for (p, r), (q, s) in zip(got, got[1:]))
        assert len(got) == max(n for n in range(9) for x in combinations(a, n) if list(x) in [list(y) for y in combinations(b, n)])


def test_deep_and_wide_pages(spark):
    pages = ["<div>" * 10_000 + f"deep {i}" + "</div>" * 10_000 for i in range(3)]
    pages += ["".join(f"<p class={'abcdefgh'[j % 8]}{'xyzuv'[j % 5]}>t{j}</p>" for j in range(100_000)), "<div class=sidebar>" * 10_000 + "x", "<b>" * 10_000 + "y" + "</i></b>" * 10_000]
    got = articles_of(spark, pages)
    assert got[:3] == ["deep 0", "deep 1", "deep 2"] and got[3] == "\n".join(f"t{j}" for j in range(100_000)) and got[4:] == ["x", "y"]


# WARC


def test_revisits(spark):
    full = lambda i, url, ts, etag, **h: (i, url, ts, "response", {"etag": etag, "content-length": "9", "x": "old", **h} if etag else {"x": "old"}, f"d{i}")
    again = lambda i, url, ts, etag, digest=None: (i, url, ts, "revisit", {"etag": etag, "content-length": "0", "x": "new", "y": "1"} if etag else {"y": "1"}, digest)
    rows = [
        full("a", "http://www.Ex.org/p/?utm_source=1#f", 100, '"1"'), full("b", "https://ex.org:443/p", 90_000, '"2"'), full("c", "http://ex.org/p", 90_000, '"1"'),
        again("r1", "http://ex.org/p", 200, 'W/"1"'), again("r2", "http://ex.org/p", 100, '"1"'), again("r3", "http://ex.org/p", 200_000, '"2"'), again("r4", "http://ex.org/p", 95_000, None),
        again("r5", "http://ex.org/q", 5, '"1"'), again("r6", None, 5, '"1"'), again("r7", "http://ex.org/p", None, '"1"'), again("r8", "http://ex.org/p", 95_000, None, "dc"),
        ("m", "http://ex.org/p", 300, "metadata", None, None), ("r9", "http://ex.org/p", 200, "revisit", None, None),
    ]
    df = spark.createDataFrame(rows, "record_id string, url string, ts long, kind string, headers map<string,string>, payload_digest string").withColumn("canonical", F.lit("clash"))
    got = by_id(warc.resolve_revisits(df), "record_id")
    outcome = {k: (r["outcome"], r["response_id"], r["payload_digest"]) for k, r in got.items()}
    assert outcome == {
        "r1": ("resolved", "a", "da"), "r2": ("missing", None, None), "r3": ("mismatch", "c", None), "r4": ("unverified", "c", "dc"), "r5": ("missing", None, None),
        "r6": ("missing", None, None), "r7": ("missing", None, None), "r8": ("resolved", "c", "dc"), "r9": ("unverified", "a", "da"),
    }
    assert got["r1"]["merged_headers"] == {"etag": '"1"', "content-length": "9", "x": "new", "y": "1"}
    assert warc.resolve_revisits(df.where("false")).count() == 0


# lines


def test_line_dedup(spark, odd, empty, docs):
    df = odd.select("doc_id", "text", "n_words").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("z").alias("n_words")))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    keeper = {k: max(v, key=lambda d: (d is not None, d or 0)) for k, v in holders.items() if len(v) >= 3}
    want = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), d) == d]
        want[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = linededup.dedup_lines(df)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == want
    assert linededup.dedup_lines(empty).count() == 0


# language


def test_language_id(spark, odd, empty, docs):
    got = by_id(queries.op10_language_id(spark, SF))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["held_out"] == (crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    tested = [d for d, r in got.items() if r["held_out"]]
    assert sum(got[d]["lang_pred"] == truth[d] for d in tested) / len(tested) > 0.97
    model = langid.fit(docs)
    out = langid.identify(odd.withColumn("score", F.lit("clash")), model).collect()
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1 for r in out)
    assert langid.identify(empty, model).count() == 0
    nothing = langid.identify(odd, langid.fit(empty))
    assert nothing.where("lang_pred <> 'und' or score <> 0").count() == 0


def test_words_go_first_and_grams_get_shorter():
    rows = [("en", 0, "the", 9), ("de", 0, "der", 9), ("en", 3, "ing", 5), ("de", 3, "ung", 5), ("en", 1, "w", 3), ("de", 1, "z", 3)]
    totals = {(x, n): 20 for x in ("en", "de") for n in (0, 1, 3)}
    predict = langid.Model.of(rows, totals).scorer()
    assert predict(["the der the", "ring", "zung", "w", "z", "qqq"])[0] == ["en", "en", "de", "en", "de", "de"]
