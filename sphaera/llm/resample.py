"""Importance resampling towards a target distribution, over hashed word n-grams.

The corpus becomes a sparse matrix of documents by buckets once, written as CSR blocks: the ids, row pointers,
bucket numbers and counts of some hundred documents in one row. The sums of its columns, and of the target's
matrix, give both distributions and the gain of each bucket; the product of the matrix with the gains gives
every document's weight. Texts are read once and never shuffle, and no table has a row for each word.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sphaera.llm.common import byte_words, small_batches, staged

NGRAM = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: A block closes at so many entries, so at most a document's distinct buckets beyond.
BLOCK_ENTRIES = 1 << 18


def bucket_counts(text: bytes | None, ngram: int = NGRAM, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """Of a whole text: its number of words, and its features' distinct buckets, ascending, with their counts."""
    n_words, tail, parts = 0, [], []
    for words in byte_words(text):
        n_words += len(words)
        run = tail + words
        # Runs that end in this slice; the tail has been counted with the slice before.
        hashes = [crc32(b" ".join(run[i : i + k])) for k in range(2, ngram + 1) for i in range(max(0, len(tail) - k + 1), len(run) - k + 1)]
        found = np.fromiter(map(crc32, words), np.int64, len(words)) if not hashes else np.array([*map(crc32, words), *hashes], np.int64)
        parts.append(np.unique(found % buckets, return_counts=True))
        tail = run[max(0, len(run) - ngram + 1) :] if ngram > 1 else []
    if len(parts) == 1:
        return n_words, *parts[0]
    dense = np.zeros(buckets if parts else 0, np.int64)
    for at, counts in parts:
        dense[at] += counts
    at = np.nonzero(dense)[0]
    return n_words, at, dense[at]


def matrix(df: DataFrame, id: str, text: str, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """The documents-by-buckets matrix of df as CSR blocks: (ids, n_words, ends, buckets, counts), written. Row i of
    a block has the entries from ends[i - 1] (0 for the first) to ends[i]."""
    rows = small_batches(df).select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"))
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(rows.schema["id"].dataType))] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("n_words", "ends")]
        + [T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))]
    )
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches):
        def block(ids, rows):
            words, at, counts = zip(*rows)
            flat = [ids, pa.array(words, pa.int64()), pa.array(np.cumsum([len(x) for x in at])), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(counts))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(f.type.value_type)) for x, f in zip(flat, arrow)]
            return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(lists, arrow)], schema=arrow)

        for batch in batches:
            first, rows, entries = 0, [], 0
            for i in range(len(batch)):
                rows.append(bucket_counts(batch.column(1)[i].as_py(), ngram, buckets))
                entries += len(rows[-1][1])
                if entries > BLOCK_ENTRIES:
                    yield block(batch.column(0).slice(first, len(rows)), rows)
                    first, rows, entries = i + 1, [], 0
            if rows:
                yield block(batch.column(0).slice(first, len(rows)), rows)

    return staged(rows.mapInArrow(run, schema), "csr")


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The sum of each column: every task adds up its blocks, and one row a bucket reaches the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    sums = blocks.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of the target's to the corpus's smoothed share of each bucket."""
    n, s, t = len(source), source.astype(float), target.astype(float)
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + n) / ((s + 1.0) * (t.sum() + n)))).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the matrix times the gains, over the number of features, floored."""
    schema = T.StructType([T.StructField("id", blocks.schema["ids"].dataType.elementType), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids, words = (batch.column(c).slice(i, 1).flatten() for c in range(2))
                ends, at, counts = (batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in range(2, 5))
                up_to = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))])
                n = up_to(counts)
                mean = up_to(gain[at] * counts) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([ids.cast(arrow[0].type), words, pa.array(n), pa.array(np.where(n > 0, mean, 0))], schema=arrow)

    return blocks.select("ids", "n_words", "ends", "buckets", "counts").mapInArrow(run, schema)


def noise(id: Column, seed: int = SEED) -> Column:
    """A document's Gumbel noise, thousandfold and floored, from a hash of the seed and its id (null: no text)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored (id, n_words, n_features, weight, score) with rank: 1, 2, 3... for the given percentage of the documents
    with enough words, by descending score, then id, and null for all others.

    The driver sees how many documents have each score, of which there are at most some hundred thousand: gains and
    noise are thousandfold logarithms of numbers of 64 bits. The documents at or above the last score drawn are
    sorted by ranges; a rank is a place in its range after those of the ranges before.
    """
    enough = F.col("n_words") >= min_words
    seen = scored.where(enough).groupBy("score").agg(F.count("*").alias("n")).toArrow()
    score, n = (seen.column(c).to_numpy() for c in ("score", "n"))
    order = np.argsort(-score, kind="stable")
    total = np.cumsum(n[order])
    draw = int(percent * n.sum() // 100)
    if not draw:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    least = int(score[order][np.searchsorted(total, draw)])
    above = enough & (F.col("score") >= least)
    keys = [F.desc("score"), F.asc_nulls_first("id"), F.asc("n_features"), F.asc("weight")]
    ordered = scored.where(above).repartitionByRange(*keys).sortWithinPartitions(*keys)
    arrow = to_arrow_schema(ordered.schema, prefers_large_types=False)
    schema = T.StructType([*ordered.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def placed(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            columns = [x.cast(f.type) for x, f in zip(batch.columns, arrow)]
            place = pa.array(np.arange(before + 1, before + len(batch) + 1))
            before += len(batch)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(batch), part, np.int32)), place], names=schema.names)

    found = staged(ordered.mapInArrow(placed, schema), "places")
    # One row a partition.
    ranges = found.groupBy("part").agg(F.max("place").alias("n"))
    ranges = ranges.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    rank = F.col("before") + F.col("place")
    found = found.join(F.broadcast(ranges), "part").withColumn("rank", F.when(rank <= draw, rank))
    return scored.where(~above).withColumn("rank", F.lit(None).cast("long")).unionByName(found.select(*scored.columns, "rank"))


def importance(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text",
    ngram: int = NGRAM, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of docs; rank says which are drawn.

    Features are all runs of 1 to ngram words. Null and empty texts have none, weigh 0 and are never drawn when
    min_words is above 0. An empty target, or an empty docs, is a distribution of no features. Rows of one id are
    documents of their own that share their noise; ties go to the smaller id (nulls first), then to fewer features.
    Very long texts are taken in slices. Other columns of docs are not looked at.
    """
    own = matrix(docs, id, text, ngram, buckets)
    other = matrix(target.withColumn("__row", F.lit(0)), "__row", target_text, ngram, buckets)
    gain = gains(column_sums(own, buckets), column_sums(other, buckets))
    scored = staged(weights(own, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    return drawn(scored, percent, min_words).withColumnRenamed("id", id)


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that are drawn, with all of their columns. Rows that share an id stay together: they are
    drawn if one of them is."""
    ids = importance(docs, target, id, **options).where("rank is not null").select(F.col(id).alias("__drawn")).distinct()
    return docs.join(ids, docs[id].eqNullSafe(ids["__drawn"]), "left_semi")
