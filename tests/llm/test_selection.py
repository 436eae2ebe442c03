"""Importance resampling, MinHash near-dedup and the source audit against plain versions of themselves."""

import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sphaera.llm import common, divergence, minhash, resample
from tests.llm.test_operators import ODD, docs, empty, odd  # noqa: F401

LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.fixture
def small_slices(monkeypatch):
    """Slices of a few bytes, so that words and runs of words meet their edges."""
    monkeypatch.setattr(common.byte_words, "__defaults__", (*common.byte_words.__defaults__[:-1], 7))


# resampling


def plain_counts(text, ngram, buckets):
    words = WORDS.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + k]) for k in range(1, ngram + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(crc32(r.encode()) % buckets for r in runs)


def plain_importance(rows, target, ngram, buckets, percent, min_words):
    own = [(d, *plain_counts(t, ngram, buckets)) for d, t in rows]
    s, t = Counter(), Counter()
    for _, _, c in own:
        s.update(c)
    for x in target:
        t.update(plain_counts(x, ngram, buckets)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    out = []
    for d, n, c in own:
        weight = sum(gain(b) * k for b, k in c.items()) // c.total() if c else 0
        h = int(sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    drawn = Counter()
    for i, r in enumerate(enough[: percent * len(enough) // 100]):
        drawn[(*r, i + 1)] += 1
    rest = Counter((*r, None) for r in out)
    for r in drawn:
        rest[(*r[:5], None)] -= 1
    return drawn + rest


@pytest.mark.parametrize("ngram,buckets,percent,min_words", [(1, 10_000, 10, 20), (3, 97, 60, 1), (2, 10_000, 100, 0)])
def test_importance(spark, odd, docs, ngram, buckets, percent, min_words):  # noqa: F811
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    target = ["the MIT license of a line", None, "", "word word"]
    got = resample.importance(rows, spark.createDataFrame([(t, "x") for t in target], "text string, id string"), ngram=ngram, buckets=buckets, percent=percent, min_words=min_words)
    want = plain_importance([tuple(r) for r in rows.collect()], target, ngram, buckets, percent, min_words)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_importance_of_nothing(odd, empty):  # noqa: F811
    assert resample.importance(empty, empty).count() == 0
    assert resample.importance(odd, empty).where("rank is not null").count() == 0
    own = resample.importance(odd, odd, min_words=0, percent=100).collect()
    assert sorted(r["rank"] for r in own) == list(range(1, len(ODD) + 1))
    assert resample.resample(odd, odd, min_words=0, percent=100).columns == odd.columns


def test_resampled_rows(odd):  # noqa: F811
    ids = [r["doc_id"] for r in resample.importance(odd, odd, min_words=1, percent=50).where("rank is not null").collect()]
    got = [r["doc_id"] for r in resample.resample(odd, odd, min_words=1, percent=50).collect()]
    assert set(got) == set(ids) and len(got) >= len(ids)


@pytest.mark.parametrize("ngram", [1, 2, 3])
def test_counts_do_not_depend_on_slices(small_slices, ngram):
    text = "One two, three ünïcode four five4 x y z  " * 9
    n, at, counts = resample.bucket_counts(text.encode(), ngram, 50)
    words, want = plain_counts(text, ngram, 50)
    assert n == words and dict(zip(at.tolist(), counts.tolist())) == dict(want)


def test_blocks_hold_the_matrix(odd, monkeypatch):  # noqa: F811
    blocks = resample.matrix(odd, "doc_id", "text", 1, 64).collect()
    rows = [(i, n, dict(zip(b["buckets"][s:e], b["counts"][s:e]))) for b in blocks for i, n, s, e in zip(b["ids"], b["n_words"], [0, *b["ends"]], b["ends"])]
    want = [(d, *plain_counts(t, 1, 64)) for d, t, *_ in ODD]
    assert sorted(map(repr, rows)) == sorted(repr((d, n, dict(sorted(c.items())))) for d, n, c in want)


def test_ranks_go_on_over_ranges(spark):
    rng = random.Random(3)
    rows = [(i % 700, 30, 30, 0, rng.choice([5, 5, 5, 5, rng.randrange(-40, 40)])) for i in range(4000)]
    scored = spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long, score long").repartition(5)
    got = resample.drawn(scored, percent=70, min_words=20).collect()
    want = sorted(rows, key=lambda r: (-r[4], r[0]))[:2800]
    assert [tuple(r)[:5] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 2801)) and len(got) == 4000


# near copies


def plain_components(rows, shingle, similarity=0.8):
    sets = []
    for _, t in rows:
        w = re.findall("[^ \t-\r]+", (t or "").translate(LOWER))
        sets.append({" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for x in holders.values() if len(x) > 1 for k, a in enumerate(x) for b in x[k + 1 :])
    for (a, b), n in common.items():
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            of[root(a)] = root(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for members in groups.values():
        known = [rows[i][0] for i in members if rows[i][0] is not None]
        least = min(known) if known else None
        out += [(rows[i][0], len(sets[i]), least, rows[i][0] == least) for i in members]
    return Counter(out)


@pytest.mark.parametrize("shingle", [2, 5])
def test_minhash_near_duplicates(odd, docs, shingle):  # noqa: F811
    rows = docs.select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    got = minhash.near_duplicates(rows, shingle=shingle)
    assert Counter(tuple(r) for r in got.collect()) == plain_components([tuple(r) for r in rows.collect()], shingle)


def test_minhash_of_nothing(odd, empty):  # noqa: F811
    assert minhash.near_duplicates(empty).count() == 0
    blank = minhash.near_duplicates(odd.where("trim(coalesce(text, '')) = ''")).collect()
    assert blank and all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] and r["kept"] for r in blank)


def test_minhash_at_the_threshold_and_in_chains(spark):
    """Families whose members differ by some replaced words, about the threshold; and texts of one to six words."""
    rng = random.Random(11)
    rows = []
    for family in range(40):
        words = [f"w{family}x{rng.randrange(10**6)}" for _ in range(rng.choice([12, 40, 150]))]
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 14))):
                copy[rng.randrange(len(copy))] = f"r{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                words = copy
    rows += [(len(rows) + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))) for i in range(300)]
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), shingle=2)
    assert Counter(tuple(r) for r in got.collect()) == plain_components(rows, 2)


def test_minhash_in_a_large_group(spark):
    """One text in thousands of near and exact copies, and another family that shares most of it."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(1500):
        copy = list(base if i % 3 else base[:60] + [f"o{k}" for k in range(30)])
        if i % 5:
            copy[rng.randrange(90)] = f"r{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), shingle=2)
    assert Counter(tuple(r) for r in got.collect()) == plain_components(rows, 2)


def test_bounds_of_the_posterior():
    """The bound is the posterior's: by sampling of the prior for a few counts, and by what it does to real pairs."""
    least = minhash.least_matches(miss=1e-3)
    rng = np.random.default_rng(0)
    t = minhash.SIMILARITY + (1 - minhash.SIMILARITY) / minhash.CHANCE
    for i in (0, 4, 9):
        n = 24 * (i + 1)
        above = lambda m: (rng.beta(m + 1, n - m + 1, 4_000_000) >= t).mean()
        assert above(least[i]) >= 0.9e-4 and above(least[i] - 1) <= 1.2e-4
    assert least == sorted(least) and minhash.least_matches(miss=1e-9) <= least
    x = rng.integers(0, 256, (20_000, 240), np.uint8)
    for likeness, low, high in ((0.8, 0.999, 1), (0.4, 0, 0.001)):
        y = np.where(rng.random(x.shape) < likeness, x, rng.integers(0, 256, x.shape, np.uint8))
        assert low <= minhash.agree_enough(x, y, minhash.least_matches(miss=1e-6 if low else 1e-2)).mean() <= high


# the audit of sources


def plain_divergence(rows, min_docs, ranks):
    holders, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = [t.translate(LOWER) for t in TERMS.findall(text)]
        holders[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in holders[lang].items() if n >= min_docs]
        v = len(kept)
        share = lambda c: (lambda n: {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + v) for t in kept})(sum(c[t] for t in kept))
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:ranks]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("tile,min_docs,ranks", [(256, 3, 200), (2, 1, 3), (3, 2, 50)])
def test_divergence(odd, docs, monkeypatch, tile, min_docs, ranks):  # noqa: F811
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = docs.select("lang", "source", "text", F.lit(1).alias("rank")).unionByName(odd.select("lang", "source", "text", F.lit(2).alias("rank")))
    got = divergence.divergence(rows, min_docs=min_docs, ranks=ranks).collect()
    want = plain_divergence([tuple(r)[:3] for r in rows.collect()], min_docs, ranks)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_divergence_of_nothing(odd, empty):  # noqa: F811
    assert divergence.divergence(empty).count() == 0
    bare = divergence.divergence(odd.withColumn("text", F.lit("1 2 3")), min_docs=1)
    assert {tuple(r) for r in bare.collect()} == plain_divergence([(r[2], r[3], "") for r in ODD], 1, 200)


def test_divergence_of_parts(spark, monkeypatch):
    """Terms handed on in small parts, batches that end within a term, pairs taken a few at a time."""
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 3)
    rng = random.Random(2)
    rows = [(rng.choice(["en", "de"]), f"s{rng.randrange(7)}", " ".join(rng.choice(["alpha", "Beta", "ümlaut", "d", "e1f"]) for _ in range(rng.randrange(30)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)
    spark.conf.set(common.BATCH_SETTING, "4")
    try:
        got = {tuple(r) for r in divergence.divergence(df).collect()}
    finally:
        spark.conf.set(common.BATCH_SETTING, "500")
    assert got == plain_divergence(rows, 3, 200)


def test_shares_are_exact_beyond_64_bits(spark):
    rows = [(0, 1, 1), (10**12, 10**12 + 7, 5), (3 * 10**13, 10**14, 10**9), (0, 10**15, 10**9), (123456789012, 987654321098765, 321)]
    df = spark.createDataFrame(rows, "n long, total long, kept long").withColumn("p", divergence.share(F.col("n"), F.col("total"), F.col("kept")))
    assert all(r["p"] == 1 + 1_000_000_000 * (r["n"] + 1) // (r["total"] + r["kept"]) for r in df.collect())
