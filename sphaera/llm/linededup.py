"""Line deduplication with two Bloom filters.

A first pass hashes every long enough line. Segments of two filters, one for hashes seen once and one for
those seen again in another document, are built where the hashes meet; only the second one, of a bounded
size, goes back to the executors. Lines that it suspects, and no others, shuffle for the exact count of
documents and the choice of the document that keeps them. A full filter only means more suspects: the
result is exact at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphaera.llm.common import BLANKS, SEGMENT_BITS, Bloom, hash_of, staged, with_arrow_columns

MIN_CHARS = 20
MIN_DOCS = 3
BITS_PER_LINE = 12
#: 2^30 bits are 128 MB, the most that a filter takes in a task.
MAX_FILTER_BITS = 1 << 30
PROBES = 3


def line_key(line: str) -> bytes:
    return line.strip(BLANKS).encode("utf-8", "surrogatepass").lower()


def _keys(text: str | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key has at least min_chars code points."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        bare = line.strip(BLANKS)
        if len(bare) >= min_chars:
            out.append((i, bare.encode("utf-8", "surrogatepass").lower()))
    return out


def _probe(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of 64-bit hashes in a segment; the segment itself comes from their low bits."""
    return [((hashes >> np.uint64(s)) % np.uint64(bits)).astype(np.int64) for s in (43, 29, 15)][:PROBES]


def _hash_batches(min_chars: int):
    """For each batch of documents, its distinct line hashes and whether two documents of it share them."""

    def run(batches):
        for batch in batches:
            # A document is a doc_id: rows that repeat one count once.
            seen: dict = {}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for _, k in _keys(t, min_chars):
                    h = xxhash.xxh64_intdigest(k)
                    if seen.setdefault(h, i) != i:
                        seen[h] = _MANY
            hashes = np.fromiter(seen.keys(), np.uint64, len(seen))
            many = np.fromiter((v is _MANY for v in seen.values()), bool, len(seen))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(many)], names=["h", "many"]
            )

    return run


class _Many:
    """Stands for "more than one document"; equal to no id."""


_MANY = _Many()


def _build_segments(segments: int):
    """Read hashes in order of their segment and give the twice-seen filter of each."""

    def run(batches):
        segment, once, twice = None, None, None

        def given():
            packed = np.packbits(twice, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([packed], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            hashes = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            many = batch.column(2).to_numpy(zero_copy_only=False)
            for s in np.unique(own).tolist():
                if s != segment:
                    if segment is not None:
                        yield given()
                    segment, once, twice = s, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                at = own == s
                values, counts = np.unique(hashes[at], return_counts=True)
                again = np.isin(values, hashes[at][many[at]]) | (counts > 1)
                places = _probe(values, SEGMENT_BITS)
                again |= np.logical_and.reduce([once[p] for p in places])
                for p in places:
                    once[p] = True
                    twice[p[again]] = True
        if segment is not None:
            yield given()

    return run


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, key) of lines to drop: keys of at least min_chars code points in at least min_docs documents,
    for all their documents but the largest id. Rows with one id are one document; a null id is the
    smallest of all."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    hashes = staged(rows.mapInArrow(_hash_batches(min_chars), "h long, many boolean"), "hashes")
    lines = hashes.count()
    segments = 1
    while segments * SEGMENT_BITS < min(lines * BITS_PER_LINE, MAX_FILTER_BITS):
        segments *= 2
    low = F.col("h").bitwiseAND(F.lit(segments - 1)).alias("segment")
    dealt = hashes.select(low, "h", "many").repartition("segment").sortWithinPartitions("segment")
    built = dealt.mapInArrow(_build_segments(segments), "segment long, bits binary").collect()
    spark = docs.sparkSession
    twice = spark.sparkContext.broadcast({r["segment"]: bytes(r["bits"]) for r in built})

    def suspects():
        bits = {s: np.frombuffer(b, np.uint8) for s, b in twice.value.items()}

        def work(texts):
            found = []
            for t in texts:
                keys = list(dict.fromkeys(k for _, k in _keys(t, min_chars)))
                if keys:
                    h = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
                    own = (h & np.uint64(segments - 1)).astype(np.int64).tolist()
                    places = np.stack(_probe(h, SEGMENT_BITS), axis=1).tolist()
                    keys = [
                        k for k, s, p in zip(keys, own, places)
                        if s in bits and all(bits[s][x >> 3] >> (x & 7) & 1 for x in p)
                    ]
                found.append([k.decode("utf-8", "surrogatepass") for k in keys])
            return [pa.array(found, pa.list_(pa.string()))]

        return work

    found = with_arrow_columns(rows, ["text"], [("keys", T.ArrayType(T.StringType()))], suspects).where(F.size("keys") > 0)
    found = staged(found.select("id", F.explode("keys").alias("key")).distinct(), "suspects")
    # max() skips nulls, so a null id keeps a line only if it is alone.
    often = found.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    # Written first, so that both sides of the join shuffle for it alone and a very common line can be split.
    often = staged(often.select("key", "keeper"), "often")
    return found.join(often, "key").where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "key")


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with kept_text, n_lines (before) and n_dropped. A null or empty text is one empty line.

    Repeated rows come back as they came, and columns of docs named like a result are replaced; an empty table stays
    empty. Very long texts are taken whole, a line at a time in their task. Documents
    that lose no line stay where they are; only those that may lose one shuffle.
    """
    drops = repeated_lines(docs, id, text, min_chars, min_docs).groupBy("id").agg(F.collect_set("key").alias("__drop"))
    drops = staged(drops.withColumnRenamed("id", "__id"), "drops")
    loses = Bloom(drops.select(hash_of(F.col("__id")).alias("h")))
    some = docs.where(loses.maybe(hash_of(F.col(id))))
    some = some.join(drops, some[id].eqNullSafe(drops["__id"]), "left").drop("__id").withColumn("__h", F.lit(None).cast("long"))
    others = docs.withColumn("__drop", F.lit(None).cast("array<string>")).withColumn("__h", hash_of(F.col(id)))

    def make():
        def work(texts, gone, hashes):
            # Of the rows that were not joined, those that may lose a line are left to the ones that were.
            stay = np.array([h is None for h in hashes], bool)
            stay |= ~loses.contains(np.array([h or 0 for h in hashes], np.int64))
            kept, before, dropped = [], [], []
            for t, d, yes in zip(texts, gone, stay):
                lines = (t or "").split("\n") if yes else []
                left = lines
                if d:
                    out = {x.encode("utf-8", "surrogatepass") for x in d}
                    left = [x for x in lines if line_key(x) not in out]
                kept.append("\n".join(left))
                before.append(len(lines))
                dropped.append(len(lines) - len(left))
            return [pa.array(kept, pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64()), stay]

        return work

    fields = [("kept_text", T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())]
    both = (with_arrow_columns(rows, [text, "__drop", "__h"], fields, make, filtered=True) for rows in (some, others))
    return next(both).unionByName(next(both)).drop("__drop", "__h")

