"""Polygons of contact faces, for drawing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.functions.geometry import TAU

ANGLE_STEP = 0.5


def faces(bounds: DataFrame, angle_step: float = ANGLE_STEP) -> DataFrame:
    """(structure_id, a, b, outer_points, barycenter, normal): the corners of each face in order around it,
    with points at least every angle_step radians along its arcs. Faces of under three points are left out."""
    corner = lambda p1, p2: F.struct(p1.alias("p1"), p2.alias("p2"))
    on_circle = lambda t: corner(F.col("disc_r") * F.cos(t), F.col("disc_r") * F.sin(t))
    pieces = F.transform("pieces", lambda s: corner(s["dist"] * s["n1"] - s["lo"] * s["n2"], s["dist"] * s["n2"] + s["lo"] * s["n1"]))
    starts = F.transform("arcs", lambda g: on_circle(g["start"]))
    n = lambda g: F.when(F.size("pieces") == 0, F.lit(math.ceil(TAU / angle_step))).otherwise(F.floor(g["length"] / angle_step)).cast("int")
    between = F.flatten(
        F.transform("arcs", lambda g: F.when(n(g) > 1, F.transform(F.sequence(F.lit(1), n(g) - 1), lambda i: on_circle(g["start"] + g["length"] * i / n(g)))).otherwise(F.slice(starts, 1, 0)))
    )
    rows = bounds.withColumn("corners", F.concat(pieces, starts)).withColumn("points", F.concat("corners", between))
    mean = lambda c: F.aggregate("corners", F.lit(0.0), lambda acc, p: acc + p[c]) / F.size("corners")
    whole = F.size("pieces") == 0
    rows = rows.withColumn("c1", F.when(whole, 0.0).otherwise(mean("p1"))).withColumn("c2", F.when(whole, 0.0).otherwise(mean("p2")))
    turned = F.array_sort(F.transform("points", lambda p: F.struct(F.atan2(p["p2"] - F.col("c2"), p["p1"] - F.col("c1")).alias("t"), p["p1"].alias("p1"), p["p2"].alias("p2"))))
    space = lambda p1, p2: F.struct(*[(F.col(f"m{c}") + p1 * F.col(f"e1{c}") + p2 * F.col(f"e2{c}")).alias(c) for c in "xyz"])
    return rows.where(F.size("points") >= 3).select(
        "structure_id", "a", "b", F.transform(turned, lambda p: space(p["p1"], p["p2"])).alias("outer_points"), space(F.col("c1"), F.col("c2")).alias("barycenter"),
        F.struct(F.col("ux").alias("x"), F.col("uy").alias("y"), F.col("uz").alias("z")).alias("normal"),
    )
