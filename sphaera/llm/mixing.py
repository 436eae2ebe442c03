"""Mixing documents to target weights by iterative proportional fitting.

Token counts are raked to target shares of several dimensions at once: each round scales the weights so that
one dimension after the other meets its targets, until all of them do. Documents are then drawn with the calibrated
probabilities of their cell, by a hash of their id, so that the draw can be repeated.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphaera.llm.common import staged

#: The most rounds, and the share of all tokens by which a marginal may miss its target in the last one.
ROUNDS = 200
TOLERANCE = 1e-12
#: The most cells that are fitted in one task.
CELLS_IN_TASK = 100_000
TEMPERATURE = 0.5
WHITE_SPACE_WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WHITE_SPACE_WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A stand-in for a topic where the table has none: the register of a text, by its form and length."""
    pipes = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))), F.lit(0))
    return F.when(tokens == 0, "empty").when(pipes * 20 >= tokens, "table").when(tokens < 50, "note").when(tokens < 500, "page").otherwise("long")


def tempered(cells: DataFrame, dim: str, tokens: str = "tokens", power: float = TEMPERATURE) -> DataFrame:
    """Target shares (value, share) of a dimension: its token shares, flattened by a power and scaled to 1."""
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum(tokens).cast("double").alias("n")).where("n > 0")
    flat = sums.withColumn("share", F.pow("n", F.lit(power)))
    total = flat.agg(F.sum("share")).first()[0] or 1.0
    return flat.select("value", (F.col("share") / F.lit(total)).alias("share"))


def _fit_in_task(goals: list[str], total: float, tolerance: float, rounds: int):
    """The rounds of rake() over a bounded table of cells, in numpy: (__n, codes of each dimension, weight and goals)."""

    def run(batches):
        import pandas as pd

        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).sort_values("__n", ignore_index=True)
        weight = rows["__tokens"].to_numpy(np.float64).copy()
        dims = [(rows[f"__code_{d}"].to_numpy(), rows[f"__goal_{d}"].to_numpy(np.float64)) for d in goals]
        for _ in range(rounds):
            off = 0.0
            for code, goal in dims:
                now = np.bincount(code, weight)[code]
                off = max(off, float(np.max(np.abs(now - goal), where=now > 0, initial=0.0)))
                weight = np.divide(weight * goal, now, out=np.zeros_like(weight), where=now > 0)
            if off <= tolerance * total:
                break
        yield pd.DataFrame({"__n": rows["__n"], "weight": weight})

    return run


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], tokens: str = "tokens", tolerance: float = TOLERANCE, rounds: int = ROUNDS,
    cells_in_task: int = CELLS_IN_TASK,
) -> DataFrame:
    """cells with weight, the fitted number of tokens of each cell, which sum to those of cells.

    targets gives (value, share) for each dimension; a value that it lacks gets no weight. Null is a value
    of its own. A cell without tokens has weight 0. The fit ends with the first round in which no marginal
    was further from its target than ``tolerance`` of all tokens, or, where the targets contradict each
    other and no weights meet them all, after ``rounds`` rounds.

    Cells are combinations of values, not documents. Up to ``cells_in_task`` of them are fitted in one task;
    beyond that each round is a job of its own: marginals are partial aggregates, the round is written and
    the driver sees one number of it. Both give the same weights.
    """
    total = cells.agg(F.sum(tokens).cast("double")).first()[0] or 0.0
    out = cells.withColumn("weight", F.col(tokens).cast("double"))
    for dim, target in targets.items():
        goal = target.select(F.col("value").alias("__value"), (F.col("share") * F.lit(total)).alias(f"__goal_{dim}"))
        out = out.join(goal, F.col(dim).eqNullSafe(F.col("__value")), "left").drop("__value").fillna(0.0, [f"__goal_{dim}"])
    out = staged(out, "rake")
    if not total:
        return out.select(*cells.columns, "weight")
    if out.count() <= cells_in_task:
        # Codes of values and cells: dense, in their own order. The window sees bounded rows.
        code = lambda *by: F.dense_rank().over(Window.orderBy(*[F.col(d).asc_nulls_first() for d in by])) - 1
        coded = out.withColumns({"__n": code(*targets).cast("long"), **{f"__code_{d}": code(d).cast("long") for d in targets}})
        coded = staged(coded.withColumn("__tokens", F.col("weight")).drop("weight").coalesce(1), "coded")
        columns = ["__n", "__tokens", *[f"__{k}_{d}" for d in targets for k in ("code", "goal")]]
        fitted = coded.select(*columns).coalesce(1).mapInPandas(_fit_in_task(list(targets), total, tolerance, rounds), "__n long, weight double")
        return coded.join(fitted, "__n").select(*cells.columns, "weight")
    for _ in range(rounds):
        off = F.lit(0.0)
        for dim in targets:
            now, goal = F.col("__now"), F.col(f"__goal_{dim}")
            sums = out.groupBy(F.col(dim).alias("__v")).agg(F.sum("weight").alias("__now"))
            out = out.join(sums, F.col(dim).eqNullSafe(F.col("__v")))
            off = F.greatest(off, F.when(now > 0, F.abs(now - goal)).otherwise(0.0))
            out = out.withColumn("__off", off).withColumn("weight", F.when(now > 0, F.col("weight") * goal / now).otherwise(0.0)).drop("__v", "__now")
            off = F.col("__off")
        out = staged(out, "rake")
        if (out.agg(F.max("__off")).first()[0] or 0.0) <= tolerance * total:
            break
        out = out.drop("__off")
    return out.select(*cells.columns, "weight")


def uniform(id: Column) -> Column:
    """A number from 0 up to 1, the same for the same id on every engine that has MD5. Null is like "null"."""
    return F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    docs: DataFrame, dims: tuple[str, ...], tokens: str, targets: dict[str, DataFrame] | None = None, rate: float = 1.0,
    id: str = "doc_id", tolerance: float = TOLERANCE, rounds: int = ROUNDS,
) -> DataFrame:
    """docs with weight (fitted tokens for each token), probability and copies.

    ``rate`` is the number of tokens to expect for each token of docs. A document's expected copies are
    rate times weight: it has their whole part for sure and is drawn for the rest, so that the expected mix
    meets the targets even where rare documents must repeat. probability is that of at least one copy.
    Documents without tokens have weight 0. targets default to tempered token shares. Columns of docs named
    like a result are replaced; repeated rows are drawn alike. Nulls in a dimension are a value of their own; texts, very
    long ones too, count by their tokens alone. An empty table stays empty.
    """
    results = ("weight", "probability", "copies")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results])
    cells = staged(kept.groupBy(*dims).agg(F.sum(tokens).alias("tokens")), "cells")
    targets = targets or {d: tempered(cells, d) for d in dims}
    fitted = rake(cells, targets, "tokens", tolerance, rounds).select(
        *[F.col(d).alias(f"__{d}") for d in dims], F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0).alias("weight")
    )
    fitted = staged(fitted, "weights")
    same = reduce(lambda a, b: a & b, [kept[d].eqNullSafe(fitted[f"__{d}"]) for d in dims])
    out = kept.join(fitted, same).drop(*[f"__{d}" for d in dims])
    # Rounded to what the fit can tell, so that a certain document is certain.
    out = out.withColumn("probability", F.round(F.col("weight") * F.lit(float(rate)), 7))
    whole = F.floor("probability")
    draw = F.when(uniform(F.col(id)) < F.col("probability") - whole, 1).otherwise(0)
    out = out.withColumn("copies", (whole + draw).cast("long"))
    return out.withColumn("probability", F.least("probability", F.lit(1.0)))
