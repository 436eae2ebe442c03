"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is a sequence of characters (code points). Of its k-mers, runs of k characters, the closed syncmers are
those whose smallest s-mer, by hash, stands at the first or the last place: whether a k-mer is one depends on
nothing around it, so an unchanged passage keeps its anchors wherever it moves. A fingerprint is the bottom
sketch of the anchors' hashes: its ``SKETCH`` smallest different ones, all of them where there are fewer.

Arrays of a text's length are made one from another, each in one pass: hashes of characters, of runs of two,
four and more characters by pairing an array with itself moved, and of those k-mers that are syncmers. An edited
text shares the anchors of the passage that it shares.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 12
S = 8
SKETCH = 64


def _bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) of arrays, with the value computed once: transform() binds the element of an array of one."""
    return F.flatten(F.transform(F.array(value), then))


def _runs(array: Column, length: int, pair: Callable[[Column, Column], Column], then: Callable[[Column], Column]) -> Column:
    """then(runs), where runs combines every ``length`` consecutive elements: runs of twice the length are pairs
    of runs, and those of other lengths pairs of overlapping ones. What starts too late has no meaning."""

    def grown(runs: Column, n: int) -> Column:
        if n == length:
            return then(runs)
        step = min(n, length - n)
        return _bind(F.transform(runs, lambda x, i: pair(x, F.get(runs, i + step))), lambda x: grown(x, n + step))

    return grown(array, 1)


def _syncmer_hashes(text: Column, k: int, s: int) -> Column:
    """array<bigint>: for each character, the 32-bit hash of the k-mer from there if it is a closed syncmer, else null.
    What starts too late for a k-mer has no meaning."""
    if not 1 <= s < k <= 2 * s:
        raise ValueError("k-mers need s-mers of at least half their length")
    w = k - s + 1

    def chosen(smers: Column) -> Column:
        def kmer(first: Column, i: Column) -> Column:
            last, between = F.get(smers, i + (w - 1)), [F.get(smers, i + j) for j in range(1, w - 1)]
            # The first and the last s-mer of a k-mer hold all of its characters.
            return F.when(F.least(first, last) == F.least(first, *between, last), F.shiftrightunsigned(F.xxhash64(first, last), 32))

        return F.transform(smers, kmer)

    return _bind(F.transform(F.split(text, ""), lambda c: F.xxhash64(c)), lambda c: _runs(c, s, lambda a, b: F.xxhash64(a, b), chosen))


def _anchor_hashes(text: Column, k: int, s: int) -> Column:
    """array<bigint>: the 32-bit hash of each k-mer that is a closed syncmer, null for the others; of a text of fewer
    characters, but not none, its own."""
    n = F.length(text)
    return F.when(n >= k, F.slice(_syncmer_hashes(text, k, s), F.lit(1), n - (k - 1))).otherwise(_short(text))


def _short(text: Column) -> Column:
    """The anchor of a text that has no k-mer."""
    whole = F.array(F.shiftrightunsigned(F.xxhash64(text), 32))
    return F.when(F.length(text) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _edited_hashes(hashes: Column, edited: Column, same: Column, k: int, s: int) -> Column:
    """_anchor_hashes() of an edited text from those of the text, with which it shares its first ``same`` characters:
    only k-mers that reach beyond those are looked at."""
    kept = F.greatest(same - (k - 1), F.lit(0))
    rest = F.substring(edited, kept + 1, F.lit((1 << 31) - 1))
    new = F.slice(_syncmer_hashes(rest, k, s), F.lit(1), F.greatest(F.length(rest) - (k - 1), F.lit(0)))
    return F.when(F.length(edited) >= k, F.concat(F.slice(hashes, F.lit(1), kept), new)).otherwise(_short(edited))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<pos, hash>> of the closed syncmers of a text; pos counts characters from 0 and hashes have 32
    bits. A text of fewer than k characters, but not none, is one anchor."""
    placed = F.transform(_anchor_hashes(text, k, s), lambda h, i: F.when(h.isNotNull(), F.struct(i.alias("pos"), h.alias("hash"))))
    return F.array_compact(placed)


def sketch(hashes: Column, size: int = SKETCH) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """The Jaccard similarity of two sets of anchors as their sketches tell it; two empty ones are alike."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def fingerprint_text(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, s: int = S, size: int = SKETCH) -> DataFrame:
    """docs with anchors and sketch; a null text counts as empty. Columns named like a result are replaced."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("anchors", "sketch")]
    out = docs.select(*kept, anchors(F.coalesce(F.col(text), F.lit("")), k, s).alias("anchors"))
    return out.withColumn("sketch", sketch(F.transform("anchors", lambda a: a["hash"]), size))


def matches(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with matches: where two anchor columns agree, as array<struct<shift, n>>, most frequent first.

    shift is the position in b less that in a; equal shifts are one moved passage. Anchors whose hash
    repeats within a text match at their first place.
    """
    keys = F.array_intersect(F.transform(a, lambda x: x["hash"]), F.transform(b, lambda x: x["hash"]))
    place = lambda c, h: F.filter(c, lambda x: x["hash"] == h)[0]["pos"]
    shifts = F.transform(keys, lambda h: place(b, h) - place(a, h))
    counted = F.transform(F.array_distinct(shifts), lambda d: F.struct((-F.size(F.filter(shifts, lambda x: x == d))).alias("m"), d.alias("shift")))
    return pairs.withColumn("matches", F.transform(F.sort_array(counted), lambda x: F.struct(x["shift"], (-x["m"]).alias("n"))))


def _bucket(id: Column, splits: list) -> Column:
    """How many of the sorted splits are at most id, found in two steps; a null id is in bucket 0."""
    step = max(1, math.isqrt(len(splits)))
    groups = [splits[i : i + step] for i in range(0, len(splits), step)]
    count = lambda array: F.size(F.filter(array, lambda x: x <= id))
    first = count(F.array(*[F.lit(g[0]) for g in groups]))
    own = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.greatest(first, F.lit(1)))
    return F.when(id.isNull() | (first == 0), 0).otherwise((first - 1) * step + count(own))


def next_to(docs: DataFrame, id: str = "doc_id", text: str = "text"):
    """(rows, window, own): rows in buckets of ascending id, to be read with ``lead`` over window.

    Buckets are ranges of the id between its quantiles. The first rows of each bucket stand, as guests, at
    the end of the bucket before it too, and those of the first one at the end of the last: the row after
    every own row is then in its bucket, and no task sees more than one bucket. Null ids come first; rows
    with one id are in the order of a hash of their text.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id).alias("id"))
    splits = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], F.lit(20 * n))).first()[0]
    splits = sorted(set(splits or []))
    bucket = _bucket(F.col(id), splits) if splits else F.lit(0)
    keyed = docs.withColumn("__bucket", bucket.cast("int")).withColumn("__tie", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    # One row for each bucket comes to the driver.
    first = {r["b"]: (r["low"], r["nulls"]) for r in ids.select(_bucket(F.col("id"), splits).cast("int").alias("b") if splits else F.lit(0).alias("b"), "id").groupBy("b").agg(F.min("id").alias("low"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()}
    order = sorted(first)
    guest = F.lit(None).cast("int")
    if order:
        lows, before = [None] * (order[-1] + 1), [0] * (order[-1] + 1)
        for i, b in enumerate(order):
            lows[b], before[b] = None if first[b][1] else first[b][0], order[i - 1]
        kind = docs.schema[id].dataType
        low = F.element_at(F.array(*[F.lit(x).cast(kind) for x in lows]), F.col("__bucket") + 1)
        guest = F.when(F.col(id).eqNullSafe(low), F.element_at(F.array(*map(F.lit, before)), F.col("__bucket") + 1))
    homes = F.filter(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("guest")), F.struct(guest.alias("b"), F.lit(True).alias("guest"))), lambda x: x["b"].isNotNull())
    rows = keyed.withColumn("__home", F.explode(homes)).withColumn("__b", F.col("__home.b")).withColumn("__guest", F.col("__home.guest")).drop("__home", "__bucket")
    window = Window.partitionBy("__b").orderBy("__guest", F.col(id).asc_nulls_first(), "__tie")
    return rows, window, ~F.col("__guest")


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, s: int = S, size: int = SKETCH) -> DataFrame:
    """Fingerprints of every text and of its edited text: its last quarter, rounded down to code points,
    replaced by as many first code points (or all) of the next document.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. A null
    text is empty, and empty texts have an empty fingerprint; an empty table stays empty. Rows with one id,
    and null ids, which come first, follow each other by a hash of their text; repeated rows come back as they
    came. Other columns are not looked at. A very long text takes some hundred bytes a character in its task.
    """
    docs = docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, window, own = next_to(docs, id, "text")
    n = F.length("text")
    rows = rows.withColumn("next", F.lead("text").over(window))
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut)))
    of = lambda hashes: sketch(F.array_compact(hashes), size)
    rows = rows.withColumn("hashes", _anchor_hashes(F.col("text"), k, s))
    edited = _edited_hashes(F.col("hashes"), F.col("edited"), n - cut, k, s)
    rows = rows.select(
        id, "__b", "__guest", "__tie", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), of(F.col("hashes")).alias("a"), of(edited).alias("e")
    )
    rows = rows.withColumn("x", F.lead("a").over(window)).where(own)
    return rows.select(
        id, "n_chars", "edited_sha256", fingerprint_text(F.col("a")).alias("fingerprint"), fingerprint_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e"), size).alias("near_edited"), likeness(F.col("a"), F.col("x"), size).alias("near_next"),
    )
