"""How far the sources of a language are apart: a chi-square-like divergence of their smoothed term shares.

For every ordered pair of sources of a language, f(p, q) is summed over all terms of the language. An inverted index
saves the work of terms that a source lacks. A pair starts at the number of terms times f of two zero counts. How
often a source has each count corrects that, for all of its partners, as if they lacked its terms; and only a term
that both have emits a correction of its own, from the posting list of the term:

    f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

All arithmetic is in integers, so the sum is exact in any order.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphaera.llm.common import TERM_BYTES, byte_words, join_counted, small_batches, staged

MIN_DOCS = 3
RANKS = 200
SCALE = 1_000_000_000
#: Terms that a task holds before it hands their counts on.
HELD_TERMS = 200_000
#: Sources of one language are paired in tiles of so many by so many.
TILE = 256
#: Pairs of postings that a task takes at once.
PAIRS_AT_ONCE = 1 << 20


def term_counts(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): how often each group has a term and in how many of its documents. The row of a
    group with a null term has its number of documents, so that groups without terms are there too."""
    rows = small_batches(df).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))], F.col(text).cast("binary").alias("text"))

    def run(batches):
        groups: dict[tuple[str, str], list] = {}
        held = 0

        def given():
            for (lang, source), (n, docs, rows) in groups.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1)), pa.array([None, *terms], pa.binary()),
                     pa.array([0, *n.values()], pa.int64()), pa.array([rows, *map(docs.__getitem__, terms)], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = groups.setdefault((lang, source), [Counter(), Counter(), 0])
                before, seen = len(own[0]), set()
                for terms in byte_words(text, TERM_BYTES):
                    own[0].update(terms)
                    seen.update(terms)
                own[1].update(seen)
                own[2] += 1
                held += len(own[0]) - before
                if held > HELD_TERMS:
                    yield from given()
                    groups.clear()
                    held = 0
        yield from given()

    found = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)) by long division in steps of 1,000, exact beyond 64 bits of product."""
    over, rest = total + kept, n + 1
    digits = [F.call_function("div", rest, over)]
    for _ in range(3):
        rest = (rest % over) * 1000
        digits.append(F.call_function("div", rest, over))
    return 1 + digits[0] * SCALE + digits[1] * 1_000_000 + digits[2] * 1_000 + digits[3]


def spread(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _changes(columns: list) -> np.ndarray:
    """The rows that differ from the one before in any of the columns."""
    differ = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in columns]
    return np.nonzero(np.logical_or.reduce(differ))[0] + 1


def _add_terms(tile: np.ndarray, batch: pa.RecordBatch, at_once: int) -> None:
    """Add to a tile what whole terms of it correct: all pairs of postings of a term, so many at once."""
    term = np.zeros(len(batch), np.int64)
    term[_changes([batch.column(3)])] = 1
    term = np.cumsum(term)
    s_side, t_side, at, p, p0 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4, 9))
    s, t = np.nonzero(s_side)[0], np.nonzero(t_side)[0]
    first = np.searchsorted(term[t], np.arange(term[-1] + 2))
    many = (first[1:] - first[:-1])[term[s]]
    ends = np.cumsum(many)
    i = 0
    while i < len(s):
        begun = ends[i] - many[i]
        j = max(i + 1, int(np.searchsorted(ends, begun + at_once, side="right")))
        x = np.repeat(s[i:j], many[i:j])
        within = np.arange(len(x)) - np.repeat(ends[i:j] - many[i:j] - begun, many[i:j])
        y = t[np.repeat(first[term[s[i:j]]], many[i:j]) + within]
        np.add.at(tile, (at[x], at[y]), _spread(p[x], p[y]) - _spread(p[x], p0[y]) - _spread(p0[x], p[y]) + _spread(p0[x], p0[y]))
        i = j


def _tile_sums(side: int, at_once: int):
    """(lang, s, t, value): for each tile, what the terms that both sources have add to the value of s against t.

    Rows come in the order of their tile and then of their term. A task holds one tile and the postings of one
    batch, with those of the term that it ends in.
    """

    def run(batches):
        left, tile, at_tile = None, None, None

        def given():
            s, t = np.nonzero(tile)
            lang, a, b = at_tile
            value, s, t = tile[s, t], s + a * side, t + b * side
            pair = s != t
            columns = [pa.array([lang] * int(pair.sum()), pa.string()), pa.array(s[pair].astype(np.int32)), pa.array(t[pair].astype(np.int32)), pa.array(value[pair])]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "s", "t", "value"])

        def taken(batch):
            nonlocal tile, at_tile
            edges = [0, *_changes(batch.columns[:3]).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:]):
                here = tuple(batch.column(i)[a].as_py() for i in range(3))
                if here != at_tile:
                    if tile is not None:
                        yield given()
                    at_tile, tile = here, np.zeros((side, side), np.int64)
                _add_terms(tile, batch.slice(a, b - a), at_once)

        for batch in batches:
            if left is not None and len(left):
                batch = pa.concat_batches([left, batch])
            cuts = _changes(batch.columns[:4]) if len(batch) else []
            whole = int(cuts[-1]) if len(cuts) else 0
            left = batch.slice(whole)
            if whole:
                yield from taken(batch.slice(0, whole))
        if left is not None and len(left):
            yield from taken(left)
        if tile is not None:
            yield given()

    return run


def divergence(
    df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, ranks: int = RANKS
) -> DataFrame:
    """(lang, source, part, item, value, rank) of the groups (lang, source) of df.

    part ``pair``: item is each other source of the language, value the divergence of the group from it. part ``term``:
    item is a term that the group has more of than its language as a whole, value f of its share against the
    language's, up to ``ranks`` of them. Ranks go by descending value, then by item. Only terms in at least min_docs
    documents of a language count for it.

    Nulls in any of the three columns are empty strings; texts without terms make groups without terms. Every row is a
    document, repeated or not. Very long texts are taken in slices. An empty table gives an empty result; other columns
    are not looked at. A value fits 64 bits, as shares add up to about 10^9.
    """
    counts = staged(term_counts(df, lang, source, text), "counts")
    of_term = Window.partitionBy("lang", "term")
    rows = counts.where("term is not null").withColumns({"term_docs": F.sum("docs").over(of_term), "term_n": F.sum("n").over(of_term), "lead": F.min("source").over(of_term) == F.col("source")})
    postings = staged(rows.where(F.col("term_docs") >= min_docs).select("lang", "source", "term", "n", "term_n", "lead"), "postings")

    # One row for each group; pairs of these are the result.
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("lead").alias("kept"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").fillna(0, ["total", "kept"])
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumns({
        "lang_total": F.sum("total").over(of_lang), "kept": F.sum("kept").over(of_lang), "sources": F.count("*").over(of_lang).cast("int"),
        "at": F.row_number().over(of_lang.orderBy("source")) - 1,
    })
    p0 = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
    groups = staged(groups.withColumn("p0", p0), "groups")
    priced = join_counted(postings, groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    # What a pair has if neither source had a term that the other has.
    other = groups.select("lang", F.col("at").alias("b"), F.col("p0").alias("q0"))
    each = F.explode(F.sequence(F.lit(0), F.col("sources") - 1)).alias("b")
    start = join_counted(groups.select("lang", F.col("at").alias("a"), "p0", "kept", each).where("a <> b"), other, ["lang", "b"])
    start = start.select("lang", F.col("a").alias("s"), F.col("b").alias("t"), F.coalesce(F.col("kept") * spread(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    alike = priced.groupBy("lang", F.col("at").alias("a"), "p", "p0", "sources").agg(F.count("*").alias("m"))
    alone = join_counted(alike.select("lang", "a", "p", "p0", "m", each).where("a <> b"), other, ["lang", "b"])
    p, p0, q0, m = (F.col(c) for c in ("p", "p0", "q0", "m"))
    alone = alone.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("s"), F.col("b").alias("t"), (m * (spread(p, q0) - spread(p0, q0))).alias("value")),
        F.struct(F.col("b").alias("s"), F.col("a").alias("t"), (m * (spread(q0, p) - spread(q0, p0))).alias("value")),
    )).alias("x")).select("lang", "x.*")

    # What the terms that both have correct. A posting goes to all tiles of its block of sources.
    own, last = F.floor(F.col("at") / TILE).cast("int"), F.floor((F.col("sources") - 1) / TILE).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), last),
        lambda x: F.when(x == own, F.array(F.struct(own.alias("s_block"), own.alias("t_block"), F.lit(True).alias("s_side"), F.lit(True).alias("t_side")))).otherwise(
            F.array(F.struct(own.alias("s_block"), x.alias("t_block"), F.lit(True).alias("s_side"), F.lit(False).alias("t_side")), F.struct(x.alias("s_block"), own.alias("t_block"), F.lit(False).alias("s_side"), F.lit(True).alias("t_side")))
        ),
    )
    dealt = priced.where("sources > 1").select("lang", "term", F.explode(F.flatten(tiles)).alias("x"), (F.col("at") % TILE).alias("at"), "p", "p0")
    dealt = dealt.select("lang", "x.s_block", "x.t_block", "term", "x.s_side", "x.t_side", "at", "p", "p0")
    both = dealt.repartition("lang", "term").sortWithinPartitions("lang", "s_block", "t_block", "term").mapInArrow(_tile_sums(TILE, PAIRS_AT_ONCE), "lang string, s int, t int, value long")

    value = start.unionByName(alone).unionByName(both).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    name = lambda at, c: groups.select("lang", F.col("at").alias(at), F.col("source").alias(c))
    pairs = join_counted(join_counted(value, name("s", "source"), ["lang", "s"]), name("t", "item"), ["lang", "t"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    q = share(F.col("term_n"), F.col("lang_total"), F.col("kept"))
    terms = priced.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), spread(F.col("p"), F.col("q")).alias("value"))
    # Tasks keep their own first ranks before anything shuffles.
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.unionByName(terms)
