"""The network of a tessellation: its edges, where three cells meet, and its vertices, where four do.

An edge or vertex is named by its balls in ascending order; null stands for the accessible surface and
comes last. Edges and vertices of one name are one row, the one with the least length or position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(bounds: DataFrame) -> DataFrame:
    """(structure_id, ball_indices of 3, length, is_on_sas)."""
    inner = F.transform("pieces", lambda s: F.struct(s["c"].alias("c"), (s["hi"] - s["lo"]).alias("length")))
    outer = F.transform("arcs", lambda g: F.struct(F.lit(None).cast("long").alias("c"), (g["length"] * F.col("disc_r")).alias("length")))
    rows = bounds.select("structure_id", "a", "b", F.explode(F.concat(inner, outer)).alias("e"))
    rows = rows.select("structure_id", F.array_sort(F.array("a", "b", "e.c")).alias("ball_indices"), "e.length")
    rows = rows.groupBy("structure_id", "ball_indices").agg(F.min("length").alias("length"))
    return rows.withColumn("is_on_sas", F.element_at("ball_indices", -1).isNull())


def vertices(bounds: DataFrame) -> DataFrame:
    """(structure_id, ball_indices of 4, x, y, z, is_on_sas)."""

    def ends(s):
        line = [s[n].alias(n) for n in ("c", "dist", "n1", "n2")]
        return F.array(F.struct(*line, s["lo_c"].alias("by"), s["lo"].alias("t")), F.struct(*line, s["hi_c"].alias("by"), s["hi"].alias("t")))

    rows = bounds.select("*", F.explode(F.flatten(F.transform("pieces", ends))).alias("p"))
    p1 = F.col("p.dist") * F.col("p.n1") - F.col("p.t") * F.col("p.n2")
    p2 = F.col("p.dist") * F.col("p.n2") + F.col("p.t") * F.col("p.n1")
    place = F.struct(*[(F.col(f"m{c}") + p1 * F.col(f"e1{c}") + p2 * F.col(f"e2{c}")).alias(c) for c in "xyz"])
    rows = rows.select("structure_id", F.array_sort(F.array("a", "b", "p.c", "p.by")).alias("ball_indices"), place.alias("at"))
    rows = rows.groupBy("structure_id", "ball_indices").agg(F.min("at").alias("at"))
    return rows.select("structure_id", "ball_indices", "at.*", F.element_at("ball_indices", -1).isNull().alias("is_on_sas"))
