"""Benchmark decontamination: find the word windows of benchmark items in training documents.

The windows of the items go to the executors as a hash table, blocks of at most ``block_windows`` windows and
``block_bytes`` bytes; a larger benchmark is dealt over several passes, so that the table stays bounded.
A worker makes the table of a block once. Documents are scanned once a pass: words become hashes, windows
become rolling hashes compared in bulk, and every hit is verified word by word before it counts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphaera.llm.common import WORD, ascii_lower, staged, with_arrow_columns

WINDOW = 10
#: The most windows of a block, and about the most bytes of their words and items.
BLOCK_WINDOWS, BLOCK_BYTES = 200_000, 16_000_000
_WORDS = re.compile(WORD)
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def item_windows(benchmark: DataFrame, id: str, text: str, window: int = WINDOW) -> DataFrame:
    """(n, words, items): every distinct window of the items with the items that have it. A window is
    ``window`` consecutive words; an item of fewer words, but not none, is one window. A null item id is
    named "null"."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    rows = benchmark.select(F.coalesce(F.col(id).cast("string"), F.lit("null")).alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, window))).alias("words"))
    return rows.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.size("words").alias("n"), "words", "items")


class _Block:
    """The windows of one block as an Arrow table (n, words, items), and the index that a worker makes of it."""

    def __init__(self, rows: pa.Table):
        self.rows, self._index = rows, None

    def index(self) -> _Index:
        if self._index is None:
            columns = [self.rows.column(c).to_pylist() for c in ("n", "words", "items")]
            self._index = _Index(zip(*columns))
        return self._index


class _Index:
    """The windows of one block: vocabulary, rolling hashes by length, words and items for verification."""

    def __init__(self, rows):
        self.number: dict[str, int] = {}
        by_length: dict[int, list] = {}
        for n, words, items in rows:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)
            by_length.setdefault(n, []).append((ids, items))
        self.lengths = []
        for n, found in sorted(by_length.items()):
            hashes = self.rolled(np.array([w for ids, _ in found for w in ids], np.uint64), n)[::n]
            table: dict[int, list] = {}
            for h, entry in zip(hashes.tolist(), found):
                table.setdefault(h, []).append(entry)
            self.lengths.append((n, np.unique(hashes), table))

    @staticmethod
    def rolled(ids: np.ndarray, n: int) -> np.ndarray:
        m = len(ids) - n + 1
        out = np.zeros(max(m, 0), np.uint64)
        for i in range(n):
            out *= _FACTOR
            out += ids[i : i + m]
            out ^= out >> np.uint64(29)
        return out

    def scan(self, words: list[str]) -> tuple[np.ndarray, set[str]]:
        """Positions inside hits, and the items that hit."""
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        hit, items = np.zeros(len(words), bool), set()
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, known, table in self.lengths:
            if len(ids) < n:
                continue
            # Only windows whose words all occur in the benchmark can hit.
            starts = np.nonzero(unknown[n:] == unknown[:-n])[0]
            if not len(starts):
                continue
            hashes = self.rolled(ids, n)[starts]
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            for k in np.nonzero(known[at] == hashes)[0].tolist():
                s = int(starts[k])
                here = tuple(ids[s : s + n].tolist())
                for entry, of in table[int(hashes[k])]:
                    if entry == here:
                        hit[s : s + n] = True
                        items.update(of)
        return np.nonzero(hit)[0], items


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with n_words, hits (positions of words inside any occurrence of a window, in order), and items
    (ids of the items with occurring windows, sorted as strings).

    Null texts have no words; an item without words has no window. Repeated rows and ids come back as they
    came; columns of docs that are named like a result are replaced; an empty table of either kind gives no
    hits. Very long texts are scanned whole, in a task that holds their words.
    """
    windows = staged(item_windows(benchmark, item_id, item_text, window), "windows")
    length = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))
    sizes = windows.agg(F.count("*").alias("n"), F.sum(length("words") + length("items")).alias("bytes")).first()
    blocks = max(1, -(-sizes["n"] // block_windows), -(-(sizes["bytes"] or 0) // block_bytes))
    part = F.pmod(F.xxhash64("words"), F.lit(blocks))
    out = docs
    for b in range(blocks):
        # One block is bounded, whatever the benchmark; only a single window can be larger.
        block = docs.sparkSession.sparkContext.broadcast(_Block(windows.where(part == b).toArrow()))

        def make(block=block, first=b == 0):
            table = block.value.index()

            def work(texts, *before):
                counts, hits, items = [], [], []
                for i, t in enumerate(texts):
                    words = _WORDS.findall((t or "").translate(_ASCII_LOWER))
                    found, names = table.scan(words)
                    if not first:
                        found = np.union1d(found, np.array(before[0][i], np.int64))
                        names |= set(before[1][i])
                    counts.append(len(words))
                    hits.append(found)
                    items.append(sorted(names))
                return [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]

            return work

        fields = [("n_words", T.LongType()), ("hits", T.ArrayType(T.LongType())), ("items", T.ArrayType(T.StringType()))]
        out = with_arrow_columns(out, [text] if b == 0 else [text, "hits", "items"], fields, make)
        if b + 1 < blocks:
            out = staged(out, "scan")
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, max_hit_share: float = 0.0, **options) -> DataFrame:
    """The documents of which at most max_hit_share of the words are hit; columns are those of docs."""
    clash = {"n_words", "hits", "items"} & set(docs.columns)
    aside = docs.withColumnsRenamed({c: f"__{c}" for c in clash})
    found = contamination(aside, benchmark, **options)
    clean = found.where(F.size("hits") <= F.lit(max_hit_share) * F.col("n_words"))
    return clean.select(*aside.columns).toDF(*docs.columns)


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Cut the hit words, from the first character of each run to the last, out of the result of contamination()."""

    def make():
        def work(texts, hits):
            out = []
            for t, h in zip(texts, hits):
                if t is None or not h:
                    out.append(t)
                    continue
                spans = [m.span() for m in _WORDS.finditer(t.translate(_ASCII_LOWER))]
                runs = np.split(np.array(h), np.nonzero(np.diff(h) > 1)[0] + 1)
                parts, at = [], 0
                for run in runs:
                    parts.append(t[at : spans[run[0]][0]])
                    at = spans[run[-1]][1]
                out.append("".join([*parts, t[at:]]))
            return [pa.array(out, pa.string())]

        return work

    return with_arrow_columns(found, [text, "hits"], [("clean_text", T.StringType())], make)


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)
