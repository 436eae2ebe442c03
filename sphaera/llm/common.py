"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sphaera.staging import shared_dir, staged  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: letters and digits of ASCII and everything beyond ASCII, in text whose A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in text as it comes.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else, whatever the locale."""
    return F.translate(column, UPPER, UPPER.lower())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A key is hot if more than one in HOT_SHARE rows have it, and if it has more than HOT_ROWS rows, as long as there are
#: not more than HOT_KEYS such keys.
HOT_SHARE, HOT_ROWS, HOT_KEYS = 256, 1_000_000, 65_536


def hot_above(total: int) -> int:
    """How many rows a key may have to shuffle with the others of a table of so many rows. Fewer than HOT_KEYS keys can
    have more: HOT_ROWS rows, or in a table of more than HOT_ROWS * HOT_KEYS rows, a HOT_KEYS-th of it."""
    return min(total // HOT_SHARE, max(HOT_ROWS, total // HOT_KEYS))


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", count: str = "n") -> DataFrame:
    """left joined with right, which has one row a key, and in ``count`` how many rows of left have that key.

    The rows of hot keys stay where they are and meet a broadcast of those keys, under HOT_KEYS rows; all
    others shuffle. So no task gets more rows of one key than hot_above() says.
    """
    most = hot_above(right.agg(F.sum(count)).first()[0] or 0)
    hot = right.where(F.col(count) > most).drop(count)
    if hot.isEmpty():
        return left.join(right.drop(count), key, how)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(count) <= most).drop(count), key, how)
    return left.join(F.broadcast(hot), key).unionByName(rest)


SEGMENT_BITS = 1 << 20
#: 32 MB, the most bits of a Bloom filter that goes to a task.
MAX_BLOOM_BITS = 1 << 28
_PROBES = (43, 29, 15)


def hash_of(*columns: Column) -> Column:
    """A bigint for values of any type, nulls included."""
    return F.xxhash64(*[x for c in columns for x in (c, c.isNull())])


def _places(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(s)) % np.uint64(SEGMENT_BITS)).astype(np.int64) for s in _PROBES]


class Bloom:
    """A Bloom filter of bigint hashes that Spark builds and tasks share: 12 bits a key, at most MAX_BLOOM_BITS.

    A full one only means that more hashes pass, so what passes is to be joined in the end. Segments of the
    filter are built where their hashes meet; the driver gets the finished segments.
    """

    def __init__(self, keys: DataFrame, key: str = "h"):
        n, self.segments = keys.count(), 1
        while self.segments * SEGMENT_BITS < min(12 * n, MAX_BLOOM_BITS):
            self.segments *= 2

        def build(batches):
            segment, bits = None, None
            for batch in batches:
                own, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                for s in np.unique(own).tolist():
                    if s != segment:
                        if segment is not None:
                            yield given(segment, bits)
                        segment, bits = s, np.zeros(SEGMENT_BITS, bool)
                    for p in _places(h[own == s].view(np.uint64)):
                        bits[p] = True
            if segment is not None:
                yield given(segment, bits)

        def given(segment, bits):
            packed = np.packbits(bits, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([packed], pa.binary())], names=["segment", "bits"])

        dealt = keys.select(F.col(key).bitwiseAND(F.lit(self.segments - 1)).alias("segment"), F.col(key).alias("h"))
        table = dealt.repartition("segment").sortWithinPartitions("segment").mapInArrow(build, "segment long, bits binary").toArrow()
        self.bits = keys.sparkSession.sparkContext.broadcast(dict(zip(table.column("segment").to_pylist(), table.column("bits").to_pylist())))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """False for a hash only if none of the keys has it."""
        values = hashes.view(np.uint64)
        own, spots = values & np.uint64(self.segments - 1), _places(values)
        out = np.zeros(len(values), bool)
        for s, packed in self.bits.value.items():
            at = np.nonzero(own == np.uint64(s))[0]
            if len(at):
                bits = np.frombuffer(packed, np.uint8)
                out[at] = np.logical_and.reduce([bits[p[at] >> 3] >> (p[at] & 7) & 1 == 1 for p in spots])
        return out

    def maybe(self, hashes: Column) -> Column:
        """contains() as a Column."""

        @F.arrow_udf("boolean")
        def test(h: pa.Array) -> pa.Array:
            return pa.array(self.contains(h.to_numpy(zero_copy_only=False).astype(np.int64)))

        return test(hashes)


#: Rows that a task turns into Python values at once, and the most rows of an Arrow batch: texts are long, and
#: batches take memory outside the heap on both sides.
ROWS_AT_ONCE = 500
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def with_arrow_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[..., list]],
    filtered: bool = False,
) -> DataFrame:
    """Add columns that Python computes batch by batch; the columns of df pass through untouched.

    make() runs once in each task and returns a function that takes one list for each of inputs and
    returns one list (or Arrow array) for each of fields; with ``filtered``, also an array that says which rows
    stay. Columns of df that are named like a field are replaced. The session's Arrow batches become as small
    as these operators need them.
    """
    small_batches(df)
    names = [n for n, _ in fields]
    kept = df.select([F.col(f"`{c}`") for c in df.columns if c not in names or c in inputs])
    passed = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in passed] + [T.StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    inputs = list(inputs)

    def run(batches):
        work = make()
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, len(b), ROWS_AT_ONCE)):
            new = work(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs))
            stay = new.pop() if filtered else None
            old = [batch.column(batch.schema.get_field_index(c)) for c in passed]
            columns = [
                x.cast(f.type) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type)
                for x, f in zip(old + list(new), arrow)
            ]
            out = pa.RecordBatch.from_arrays(columns, schema=arrow)
            yield out if stay is None else out.filter(pa.array(stay))

    return kept.mapInArrow(run, schema)


#: The bytes of WORD, and of words without digits, in UTF-8 whose A-Z are lower case.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xFF]+")
TERM_BYTES = re.compile(rb"[a-z\x80-\xFF]+")
_BREAK = re.compile(rb"[^0-9a-z\x80-\xFF]")
SLICE_BYTES = 1 << 20


def byte_words(text: bytes | None, pattern: re.Pattern = WORD_BYTES, step: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a whole text, A-Z lower-cased, in lists of about ``step`` bytes of text: a very long text is never
    a single list of words. Slices end between words; null has none."""
    data, start = (text or b"").lower(), 0
    while start < len(data):
        cut = _BREAK.search(data, min(start + step, len(data)))
        end = cut.start() if cut else len(data)
        yield pattern.findall(data, start, end)
        start = end


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches are made as small as operators on texts need them."""
    if int(df.sparkSession.conf.get(BATCH_SETTING)) > ROWS_AT_ONCE:
        df.sparkSession.conf.set(BATCH_SETTING, str(ROWS_AT_ONCE))
    return df


#: A table of at most so many short rows may be broadcast.
BROADCAST_ROWS = 200_000


def join_counted(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with a table of short rows, one a key, that is broadcast up to BROADCAST_ROWS rows; beyond,
    there are so many keys that a shuffle deals them evenly."""
    few = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if few else right, list(on), how)
