"""SimHash near-duplicate detection with covering locality-sensitive hashing.

Fingerprints of 64 bits link when they differ in at most ``radius`` bits. Candidate search follows the
covering construction: every bit position gets a vector of radius + 1 bits, and each of the
2^(radius+1) - 1 non-zero vectors v makes a mask of the positions whose vector has an odd product with v.
The vectors at up to ``radius`` differing positions span a proper subspace, so some v is orthogonal to
all of them and its mask covers none of them: every pair within the radius collides in some table.

Buckets that hold more than ``bucket_limit`` different fingerprints are not compared in one task. Their
members link through the points within half the radius instead: two fingerprints are at most 2m bits apart
if and only if a point lies within m bits of both, and no point has more than a fixed number of
fingerprints that near.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphaera.llm.common import Bloom, hash_of, join_hot, staged, with_arrow_columns

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
BUCKET_LIMIT = 32768
#: Buckets up to this size give every link; larger ones a spanning forest of theirs.
ALL_LINKS = 32


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED, distinct: bool = False) -> int:
    """The unsigned 64-bit SimHash of the word shingles of a whole text; no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    elif distinct and shingle == 1:
        hashes = [xxhash.xxh64_intdigest(w, seed) for w in set(words)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
        if distinct:
            hashes = list(set(hashes))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(
    df: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE, seed: int = SEED, distinct: bool = False
) -> DataFrame:
    """Add the SimHash of a text column as a signed bigint (null and empty texts: 0)."""

    def make():
        def work(texts):
            values = np.array([simhash(t, shingle, seed, distinct) for t in texts], dtype=np.uint64)
            return [pa.array(values.view(np.int64))]

        return work

    return with_arrow_columns(df, [text], [(out, T.LongType())], make)


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 masks of the covering tables, as unsigned integers."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(BITS)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        for v in range(1, 2 ** (radius + 1))
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius: all of a small bucket, a minimum spanning forest (Prim) of a larger one."""
    n, unsigned = len(values), values.view(np.uint64)
    if n <= ALL_LINKS:
        apart = np.bitwise_count(unsigned[:, None] ^ unsigned[None, :])
        i, j = np.nonzero(np.triu(apart <= radius, 1))
        return list(zip(i.tolist(), j.tolist()))
    far = BITS + 1
    best, parent = np.full(n, far, np.int16), np.zeros(n, np.int64)
    outside, at, kept = np.ones(n, bool), 0, []
    for _ in range(n):
        outside[at] = False
        best[at] = far + 1
        apart = np.bitwise_count(unsigned ^ unsigned[at]).astype(np.int16)
        closer = outside & (apart < best)
        best[closer] = apart[closer]
        parent[closer] = at
        at = int(np.argmin(best))
        if best[at] <= radius:
            kept.append((int(parent[at]), at))
    return kept


def _bucket_links(radius: int, limit: int):
    """Links of the buckets of one partition, read in order of the bucket; members of a bucket beyond the
    limit come out as (fp, null) instead. Memory holds one bucket up to the limit."""

    def run(batches):
        key, members, over = None, [], False
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def close(out):
            if over:
                out.extend((m, None) for m in members)
            elif len(members) > 1:
                values = np.array(members, np.int64)
                out.extend((members[i], members[j]) for i, j in _forest(values, radius))

        def table(out):
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=schema
            )

        for batch in batches:
            tables, buckets = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            fps = batch.column(2).to_numpy(zero_copy_only=False)
            n = len(fps)
            cuts = np.nonzero((tables[1:] != tables[:-1]) | (buckets[1:] != buckets[:-1]))[0] + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [n]))
            sizes = ends - starts
            # Only runs of two or more and the two at the edges of the batch need a look.
            look = np.nonzero((sizes > 1) | (starts == 0) | (ends == n))[0]
            out: list[tuple[int, int | None]] = []
            for s, e in zip(starts[look].tolist(), ends[look].tolist()):
                here = (int(tables[s]), int(buckets[s]))
                if here != key:
                    close(out)
                    key, members, over = here, [], False
                members.extend(fps[s:e].tolist())
                if len(members) > limit:
                    over = True
                if over:
                    close(out)
                    members = []
            yield table(out)
        out = []
        close(out)
        yield table(out)

    return run


def fingerprint_links(fps: DataFrame, fp: str = "fp", radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints exactly as "at most radius bits apart" does.

    Small buckets give every link, larger ones a spanning forest, very large ones links through shared
    points; the connected components are those of the full relation.
    """
    if radius % 2:
        raise ValueError("an even radius is needed for the links of very large buckets")
    masks = covering_masks(radius)
    keys = F.array([F.struct(F.lit(i).alias("t"), F.col(fp).bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
    rows = fps.select(F.col(fp), F.explode(keys).alias("x")).select("x.t", "x.k", F.col(fp))
    found = staged(
        rows.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(_bucket_links(radius, bucket_limit), "a long, b long"),
        "links",
    )
    near = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    hot = found.where("b is null").select("a").distinct()
    half = radius // 2
    flips = [0] + [sum(1 << i for i in c) for n in range(1, half + 1) for c in combinations(range(BITS), n)]
    points = F.transform(F.array([F.lit(_signed(x)) for x in flips]), lambda m: F.col("a").bitwiseXOR(m))
    reach = hot.select("a", F.explode(points).alias("z"))
    lowest = reach.groupBy("z").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    shared = reach.join(lowest, "z").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near.unionByName(shared).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components (node, component = smallest node) of links (a, b) with a < b.

    Large-star and small-star contraction: every round sends each node's larger (then smaller) neighbours
    to its smallest one, and the loop ends when a round changes nothing. Nodes without links do not appear.
    """
    edges = staged(links.select("a", "b").where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = staged(large.where("a <> b").distinct(), "large")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
        small = small.unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
        small = small.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        after = staged(small.distinct(), "small")
        if after.count() == edges.count() and after.exceptAll(edges).isEmpty():
            break
        edges = after
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """One row (id, fp, component_id) for each row of df; component_id is the smallest id reachable.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows come back as often as
    they came; a null id never becomes a component_id unless the whole component has none. Other columns
    of df are not looked at. Very long texts count with all of their shingles. An empty table gives an empty result.
    """
    base = staged(with_fingerprints(df.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "fp", shingle).drop("text"), "fingerprints")
    lowest = staged(base.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "distinct")
    groups = components(fingerprint_links(lowest, "fp", radius, bucket_limit))
    member = lowest.join(groups, lowest["fp"] == groups["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"), "low", "n")
    member = staged(member, "members")
    named = staged(member.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("c")), "named")
    # One fingerprint or component may have most of the rows.
    ids = staged(join_hot(member, named, "component", count="c").select("fp", "component_id", "n"), "ids")
    return join_hot(base, ids, "fp").select(F.col("id").alias(id), "fp", "component_id")


def fp_hex(column: Column) -> Column:
    """A signed bigint fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Distinct unsigned hashes of the word shingles, sorted; one hash for a shorter text, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64))


#: Min-hashes of a set, bands of them, and hashes in each band: two sets of similarity 0.8 agree in no band with
#: a probability of about 3e-5, of 0.85 with one below 1e-7; sets of similarity 0.5 agree in one of four pairs.
HASHES, BANDS, BAND_ROWS = 240, 80, 8
#: The most shingles whose frequency orders an index of first shingles. They order it and leave nothing out.
COMMON = 100_000
#: How many pairs of one text meet in a task that compares them.
PAIRS_IN_TASK = 256


def _mixing(hashes: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The odd factor of each min-hash, and which of them each band has."""
    factors = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) | 1 for i in range(hashes)], np.uint64)
    pick = np.random.Generator(np.random.PCG64(SEED))
    return factors, np.stack([pick.permutation(hashes)[:rows] for _ in range(bands)])


def _min_hashes(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least of the mixed hashes of a set, for each factor."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        mixed = shingles[i : i + 1024, None] * factors
        mixed ^= mixed >> np.uint64(32)
        mixed *= factors
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def _band_keys(shingles: np.ndarray, least: np.ndarray, members: np.ndarray) -> np.ndarray:
    """One key for each band of the min-hashes of a set; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    keys = np.arange(1, len(members) + 1, dtype=np.uint64)
    for column in least[members].T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _prefix(shingles: np.ndarray, known: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in an order that all sets share: those that are not known, then the known ones
    by rank. Two sets of this similarity have one of them in common."""
    n = len(shingles)
    at = np.searchsorted(known, shingles)
    at[at == len(known)] = 0
    common = known[at] == shingles if len(known) else np.zeros(n, bool)
    order = np.lexsort((shingles, np.where(common, rank[at] if len(known) else 0, -1)))
    return shingles[order[: n - math.ceil(similarity * n - 1e-6) + 1]]


def _words_digest(text: str | None) -> bytes:
    """A digest of the sequence of words."""
    return xxhash.xxh128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))


def candidate_pairs(rows: DataFrame, nodes: DataFrame, similarity: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """Distinct pairs (x, y) of digests for pairs of numbers, if their sizes allow them to be alike, with the
    columns carried of either, as x_... and y_...; x is the one that many have."""
    names = ("words", "size", *carried)
    end = lambda c: nodes.select(F.col("n").alias(c), *[F.col(n).alias(f"{c}_{n}") for n in names])
    rows = join_hot(rows.select("x", "y").distinct(), rows.select("x", "y").distinct().groupBy("x").agg(F.count("*").alias("c")).join(end("x"), "x"), "x", count="c")
    rows = rows.join(end("y"), "y").where("x_words <> y_words").where(F.least("x_size", "y_size") >= F.lit(similarity) * F.greatest("x_size", "y_size") - 1e-6)
    kept = [F.col(f"{e}_{n}") for e in "xy" for n in carried]
    rows = rows.select(F.col("x_words").alias("x"), F.col("y_words").alias("y"), *kept)
    return rows.dropDuplicates(["x", "y"])


def shingle_sets(source: DataFrame, nodes: DataFrame, ends: DataFrame, shingle: int) -> DataFrame:
    """(words, set) of the nodes whose numbers are in ends, written; source has (id, text) of all documents."""
    wanted = Bloom(nodes.join(ends, "n", "left_semi").select(hash_of(F.col("low")).alias("h")))

    def shingles():
        def work(texts, hashes):
            # Every row that has the id of a needed text; others of that id do no harm.
            asked = wanted.contains(np.array(hashes, np.int64))
            digests = [_words_digest(t) if yes else None for t, yes in zip(texts, asked)]
            return [pa.array(digests, pa.binary()), pa.array([_shingle_hashes(t, shingle).view(np.int64) if yes else None for t, yes in zip(texts, asked)], pa.list_(pa.int64()))]

        return work

    sets = with_arrow_columns(source.select("text", hash_of(F.col("id")).alias("h")), ["text", "h"], [("words", T.BinaryType()), ("set", T.ArrayType(T.LongType()))], shingles)
    return staged(sets.where(F.size("set") > 0).select("words", "set").dropDuplicates(["words"]), "sets")


def measured(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs with their similarity. A text that many others are compared with goes to several tasks."""
    degrees = staged(pairs.groupBy(F.col("x").alias("words")).agg(F.count("*").alias("n")), "degrees").withColumn("parts", F.ceil(F.col("n") / PAIRS_IN_TASK).cast("int"))
    dealt = join_hot(pairs.withColumnRenamed("x", "words"), degrees, "words").withColumnRenamed("words", "x")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int")).drop("parts")
    xs = sets.join(degrees.drop("n"), "words").select(F.col("words").alias("x"), F.col("set").alias("xs"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = dealt.join(sets.select(F.col("words").alias("y"), F.col("set").alias("ys")), "y").join(xs, ["x", "part"]).withColumn("common", F.size(F.array_intersect("xs", "ys")))
    union = F.size("xs") + F.size("ys") - F.col("common")
    return staged(found.select("x", "y", (F.col("common") / union).alias("likeness"), (F.col("common") >= similarity * union).alias("alike")), "measured")


def settled(found: DataFrame) -> DataFrame:
    links = found.where("alike").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return staged(components(links).withColumnRenamed("node", "words"), "components")


def crossing_pairs(lists: DataFrame, groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (x, y) of numbers of members of lists (t, x, y) that lie in several components, but for what cannot be
    alike: two of them that are have one of the first of their shingles in common, rare ones first, which unlike
    texts with a passage in common have not."""
    rows = lists.select("x", "y").distinct().join(groups.select(F.xxhash64("words").alias("y"), F.xxhash64("component").alias("of")), "y", "left")
    rows = staged(rows.select("x", "y", F.coalesce("of", "y").alias("of")), "rows")
    mixed = rows.groupBy("x").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.count("*").alias("c")).where("low <> high").select("x", "c")
    left = join_hot(rows, staged(mixed, "mixed"), "x", count="c").select("y", "of").distinct()
    left = staged(sets.withColumn("y", F.xxhash64("words")).join(left, "y").select("y", "of", "set"), "left")
    found = left.select(F.explode("set").alias("t")).groupBy("t").count().where("count > 2").orderBy(F.desc("count"), "t").limit(COMMON)
    common = lists.sparkSession.sparkContext.broadcast(found.select("t").toArrow().column("t").to_numpy()[::-1])

    def first_shingles(batches):
        order = np.argsort(common.value, kind="stable")
        known = common.value[order]
        for batch in batches:
            prefixes = [_prefix(x.values.to_numpy(), known, order, similarity) for x in batch.column(2)]
            at = pa.array(np.repeat(np.arange(len(prefixes)), list(map(len, prefixes))))
            tokens = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64), pa.int64())
            # How much of the set is left from this shingle on.
            rest = pa.array(np.concatenate([len(x) - np.arange(len(p)) for x, p in zip(batch.column(2), prefixes)]) if prefixes else np.zeros(0, np.int64), pa.int64())
            size = pa.array([len(x) for x in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([tokens, batch.column(0).take(at), batch.column(1).take(at), size.take(at), rest], names=["t", "y", "of", "size", "rest"])

    index = staged(left.select("y", "of", "set").mapInArrow(first_shingles, "t long, y long, of long, size long, rest long"), "index")
    mixed = index.groupBy("t").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.count("*").alias("c")).where("low <> high").select("t", "c")
    index = staged(join_hot(index, staged(mixed, "mixed"), "t", count="c"), "index")
    x, y = (index.select("t", F.col("y").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in ("of", "size", "rest")]) for e in "xy")
    # Of the first shingle that two alike sets have in common, as much is left in both as they must share.
    enough = F.least("x_rest", "y_rest") >= F.lit(similarity / (1.0 + similarity)) * (F.col("x_size") + F.col("y_size")) - 1e-6
    return staged(x.join(y, "t").where((F.col("x_of") < F.col("y_of")) & enough).select("x", "y").distinct(), "crossing")


def near_copy_groups(
    df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS,
    hashes: int = HASHES, bands: int = BANDS, band_rows: int = BAND_ROWS,
) -> DataFrame:
    """(id, h, words, group) of every row: documents whose sets of five-word shingles are alike share a group.

    h is a hash of the text, words a digest of its words and group the smallest such digest of the group. Exact
    copies (the same words) collapse first. Groups are the connected components of the pairs whose Jaccard
    similarity is at least ``similarity``, each computed in full. Candidates come from two sources:

    * SimHashes of the distinct words, through the covering tables.
    * Lists of texts that agree in a band of min-hashes, for the pairs that are alike but further apart than
      the radius. All members of a list are compared with its first one; then members of lists that are
      still in different components, if they have one of their first shingles in common, as all that are
      alike have. So no pair is left untested but those that are connected already.

    Nulls and texts without words are one exact copy. Very long texts are compared by all of their shingles.
    """
    source = df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))

    def make():
        mixing = _mixing(hashes, bands, band_rows)

        def work(texts):
            sets = [_shingle_hashes(t, shingle) for t in texts]
            return [
                pa.array([_words_digest(t) for t in texts], pa.binary()), pa.array([_signed(simhash(t, 1, SEED, True)) for t in texts], pa.int64()),
                pa.array(list(map(len, sets)), pa.int64()), pa.array([_band_keys(x, _min_hashes(x, mixing[0]), mixing[1]) for x in sets], pa.list_(pa.int64())),
            ]

        return work

    fields = [("words", T.BinaryType()), ("fp", T.LongType()), ("size", T.LongType()), ("keys", T.ArrayType(T.LongType()))]
    full = staged(with_arrow_columns(source, ["text"], fields, make).drop("text"), "prints")
    base = full.select("id", "words", "h")
    # Each distinct sequence of words is one node; lists name it by 64 bits of its digest. Nodes without words
    # are alike only to themselves.
    nodes = full.where("size > 0").groupBy("words").agg(F.min("id").alias("low"), *[F.first(c).alias(c) for c in ("fp", "size", "keys")])
    nodes = staged(nodes.withColumn("n", F.xxhash64("words")), "texts")

    # The covering tables.
    of = staged(nodes.groupBy("fp").agg(F.min("n").alias("x"), F.count("*").alias("c")), "fingerprints")
    near = fingerprint_links(of.select("fp"), "fp", radius)
    across = near.join(of.select(F.col("fp").alias("a"), "x"), "a").join(of.select(F.col("fp").alias("b"), F.col("x").alias("y")), "b")
    same = join_hot(nodes.select("fp", F.col("n").alias("y")), of, "fp", count="c")

    # The lists of the bands: only those of two or more members are kept.
    members = nodes.select(F.explode("keys").alias("t"), F.col("n").alias("y"))
    leads = staged(members.groupBy("t").agg(F.min("y").alias("x"), F.count("*").alias("c")).where("c > 1"), "leads")
    lists = staged(join_hot(members, leads, "t", count="c").where("x <> y").select("t", "x", "y"), "lists")
    met = staged(across.select("x", "y").unionByName(same.select("x", "y")).unionByName(lists.select("x", "y")).where("x <> y").distinct(), "met")
    tested = staged(candidate_pairs(met, nodes, similarity), "candidates")
    ends = met.select(F.col("x").alias("n")).unionByName(met.select(F.col("y").alias("n"))).distinct()
    sets = shingle_sets(source, nodes, ends, shingle)
    first = measured(tested, sets, similarity)
    groups = settled(first)
    pairs = crossing_pairs(lists, groups, sets, similarity)
    if not pairs.isEmpty():
        pairs = staged(candidate_pairs(pairs, nodes, similarity), "crossing")
        for ends in (("x", "y"), ("y", "x")):
            pairs = pairs.join(first.select(*[F.col(c).alias(e) for c, e in zip("xy", ends)]), ["x", "y"], "left_anti")
        groups = settled(first.select("x", "y", "alike").unionByName(measured(staged(pairs, "crossing"), sets, similarity).select("x", "y", "alike")))
    sizes = base.groupBy("words").agg(F.count("*").alias("c")).join(groups, "words", "left").select("words", "c", F.coalesce("component", "words").alias("group"))
    return join_hot(base, staged(sizes, "sizes"), "words", count="c").select(F.col("id").alias(id), "h", "words", "group")


def without_near_copies(df: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df that stay: of each group of near copies the document with the smallest id.

    Rows that repeat both id and words are one document and stay together; columns are those of df. Of the
    rows of df, only those whose id may have gone shuffle.
    """
    groups = staged(near_copy_groups(df, id, text, **options).select(F.col(id).alias("gone_id"), "h", "words", "group"), "groups")
    # Nulls sort before all ids, so a struct gives every group one smallest member.
    first = staged(groups.groupBy("group").agg(F.min(F.struct("gone_id", "words")).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    gone = join_hot(groups, first, "group").where(~F.struct("gone_id", "words").eqNullSafe(F.col("first")))
    gone = staged(gone.select("gone_id", F.col("h").alias("gone_h")).distinct(), "gone")
    maybe = Bloom(gone.select(hash_of(F.col("gone_id")).alias("h"))).maybe(hash_of(F.col(id)))
    some = df.where(maybe)
    same = some[id].eqNullSafe(gone["gone_id"]) & (F.xxhash64(some[text]) == gone["gone_h"])
    return df.where(~maybe).unionByName(some.join(gone, same, "left_anti"))
