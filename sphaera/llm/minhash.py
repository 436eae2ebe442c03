"""MinHash near-duplicate detection with sequential Bayesian verification.

Texts that agree in a band of min-hashes are candidates. A candidate pair's signatures are then compared batch by
batch of hashes. After each batch, the posterior of the pair's similarity, given how many of the hashes agree, bounds
how probable it still is that the pair reaches the threshold; a pair for which that falls below the chosen miss
probability goes. Those that survive all batches are verified on their full sets of shingles, so that no pair
links by an estimate.

Candidates come to the task as pairs, never as groups: the members of a band's list meet its first one, and members
that are then in different components meet where they share one of their first shingles, which alike sets must.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphaera.llm.common import join_hot, staged, with_arrow_columns
from sphaera.llm.simhash import (
    BAND_ROWS, BANDS, HASHES, _band_keys, _min_hashes, _mixing, _shingle_hashes, _words_digest, candidate_pairs, crossing_pairs, measured, settled, shingle_sets,
)

SHINGLE = 5
SIMILARITY = 0.8
#: Probability with which a pair at the threshold is pruned, over all batches.
MISS = 1e-6
#: Hashes of a signature that are compared at once.
BATCH = 24
#: Values of one byte of a min-hash: two different sets agree in it by chance as often as one in so many.
CHANCE = 256


def least_matches(hashes: int = HASHES, batch: int = BATCH, similarity: float = SIMILARITY, miss: float = MISS) -> list[int]:
    """How many of the first batch, 2 batch, ... hashes must agree for a pair to stay.

    With a uniform prior, the chance that hashes agree is, after m of n did, a Beta(m + 1, n - m + 1); that it reaches
    t is as probable as at most m successes in n + 1 trials of probability t. The least m for which this is not below
    the miss probability of a batch stays. A byte of a min-hash also agrees by chance.
    """
    t = similarity + (1.0 - similarity) / CHANCE
    looks = range(batch, hashes + 1, batch)
    least = []
    for n in looks:
        below = 0.0
        for m in range(n + 1):
            below += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
            if below >= miss / len(looks):
                least.append(m)
                break
    return least


def agree_enough(x: np.ndarray, y: np.ndarray, least: list[int], batch: int = BATCH) -> np.ndarray:
    """Which rows of two tables of signatures stay after all batches; later batches look at those that are left."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for i, enough in enumerate(least):
        part = slice(i * batch, (i + 1) * batch)
        matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= enough]
    out = np.zeros(len(x), bool)
    out[alive] = True
    return out


def sift(pairs: DataFrame, hashes: int = HASHES, similarity: float = SIMILARITY, miss: float = MISS) -> DataFrame:
    """The pairs (x, y) whose signatures x_sig and y_sig leave them a chance to be alike."""
    least = least_matches(hashes, BATCH, similarity, miss)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, hashes) for i in (2, 3))
            stay = agree_enough(x, y, least)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(stay)) for i in range(2)], names=["x", "y"])

    return pairs.select("x", "y", "x_sig", "y_sig").mapInArrow(run, "x binary, y binary")


def near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, miss: float = MISS,
    hashes: int = HASHES, bands: int = BANDS, band_rows: int = BAND_ROWS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of df.

    A document's set is its distinct shingles of words (A-Z lower-cased, parted by ASCII white space); fewer words are
    one shingle, no words and null an empty set, which is alike to none: such a document is a component of its own.
    Documents whose sets have a Jaccard similarity of at least ``similarity`` link; component_id is the smallest id
    reachable and kept says whether it is the row's own. A null id is never a component_id unless all ids of the
    component are null. Rows that repeat an id are documents like any other. Very long texts count with all their
    shingles. Other columns are not looked at; an empty table gives an empty result.
    """
    source = df.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def make():
        factors, members = _mixing(hashes, bands, band_rows)

        def work(texts):
            sets = [_shingle_hashes(t, shingle) for t in texts]
            least = [_min_hashes(x, factors) for x in sets]
            return [
                pa.array([_words_digest(t) for t in texts], pa.binary()), pa.array(list(map(len, sets)), pa.int64()),
                pa.array([x.astype(np.uint8).tobytes() for x in least], pa.binary()), pa.array([_band_keys(x, h, members) for x, h in zip(sets, least)], pa.list_(pa.int64())),
            ]

        return work

    fields = [("words", T.BinaryType()), ("size", T.LongType()), ("sig", T.BinaryType()), ("keys", T.ArrayType(T.LongType()))]
    full = staged(with_arrow_columns(source, ["text"], fields, make).drop("text"), "prints")
    # Each distinct sequence of words is one node, named by 64 bits of its digest until pairs are told apart in full.
    nodes = full.where("size > 0").groupBy("words").agg(F.min("id").alias("low"), *[F.first(c).alias(c) for c in ("size", "sig", "keys")])
    nodes = staged(nodes.withColumn("n", F.xxhash64("words")), "nodes")
    members = nodes.select(F.explode("keys").alias("t"), F.col("n").alias("y"))
    leads = staged(members.groupBy("t").agg(F.min("y").alias("x"), F.count("*").alias("c")).where("c > 1"), "leads")
    lists = staged(join_hot(members, leads, "t", count="c").where("x <> y").select("t", "x", "y"), "lists")

    met = staged(lists.select("x", "y").distinct(), "met")
    sets = shingle_sets(source, nodes, met.select(F.col("x").alias("n")).unionByName(met.select(F.col("y").alias("n"))).distinct(), shingle)
    likely = lambda pairs: staged(sift(candidate_pairs(pairs, nodes, similarity, ("sig",)), hashes, similarity, miss), "likely")
    first = measured(likely(met), sets, similarity).select("x", "y", "alike")
    groups = settled(first)
    pairs = crossing_pairs(lists, groups, sets, similarity)
    if not pairs.isEmpty():
        groups = settled(first.unionByName(measured(likely(pairs), sets, similarity).select("x", "y", "alike")))

    texts = full.groupBy("words").agg(F.count("*").alias("c"), F.min("id").alias("low"), F.first("size").alias("size"))
    texts = staged(texts.join(groups, "words", "left").select("words", "c", "low", "size", F.coalesce("component", "words").alias("group")), "members")
    named = staged(texts.groupBy("group").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "named")
    texts = staged(join_hot(texts, named, "group", count="n").select("words", "c", "component_id"), "texts")
    out = join_hot(full.select("id", "words", "size"), texts, "words", count="c")
    out = out.withColumn("component_id", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id), F.col("size").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
