"""Group numbers for atoms: contacts within a group are not computed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sphaera.functions.selection import parse_selections

KEY = ["structure_id", "ball_id"]


def _dense(atoms: DataFrame, names: list[str]) -> DataFrame:
    """Number the distinct values of names in each structure by where they first appear."""
    first = atoms.groupBy("structure_id", *names).agg(F.min("ball_id").alias("__first"))
    # One row for each group: few, whatever the number of atoms.
    rank = F.row_number().over(Window.partitionBy("structure_id").orderBy("__first")) - 1
    ranked = first.select("structure_id", *[F.col(n).alias(f"__{n}") for n in names], rank.cast("long").alias("grp")).withColumnRenamed("structure_id", "__sid")
    on = [atoms["structure_id"] == ranked["__sid"]] + [atoms[n].eqNullSafe(ranked[f"__{n}"]) for n in names]
    return atoms.drop("grp").join(ranked, reduce(lambda a, b: a & b, on)).drop("__sid", *[f"__{n}" for n in names])


def chain_groups(atoms: DataFrame) -> DataFrame:
    """atoms with grp, one number a chain."""
    return _dense(atoms, ["chain_id"])


def residue_groups(atoms: DataFrame) -> DataFrame:
    """atoms with grp, one number a residue (chain, sequence number and insertion code)."""
    return _dense(atoms, ["chain_id", "res_seq", "i_code"])


def selection_group(selections: list[str]) -> Column:
    """The number of the first selection that an atom matches; each other atom has one of its own, so that it
    has contacts with all others."""
    found = [F.when(s, i) for i, s in enumerate(parse_selections(selections))]
    return F.coalesce(*found, F.lit(len(found)) + F.col("ball_id")).cast("long")


def selection_groups(atoms: DataFrame, selections: list[str]) -> DataFrame:
    return atoms.withColumn("grp", selection_group(selections))
