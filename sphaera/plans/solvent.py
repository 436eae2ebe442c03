"""Pseudo-solvent: spheres on the exposed surface of atoms, weighted by the volume of their cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sphaera.functions.exposure import free_points
from sphaera.functions.icosahedron import SphereTree, sphere_points
from sphaera.operators.overlap import KEY
from sphaera.operators.periodic import PeriodicBox
from sphaera.plans.tessellation import tessellate
from sphaera.staging import staged

DEPTH = 2
#: Balls whose points are looked at together, at most 2,562 of each.
BALLS_AT_ONCE = 256


class SolventError(ValueError):
    """Parameters or balls that no solvent can be made for."""


def validate(balls: DataFrame, probe: float, volume_probe: float) -> None:
    """Raise on a parameter, or the first ball, that is not a finite number, and on radii that are not positive."""
    if not 0 < float(probe) < float("inf"):
        raise SolventError(f"probe must be finite and positive: {probe}")
    if not 0 <= float(volume_probe) < float("inf"):
        raise SolventError(f"volume_probe must be finite and not negative: {volume_probe}")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    place, radius = finite("x") & finite("y") & finite("z"), finite("r") & (F.col("r") > 0)
    reason = F.when(~place, "coordinates must be finite").when(~radius, "radius must be finite and positive")
    bad = balls.withColumn("reason", reason).where("reason is not null")
    first = bad.agg(F.min("ball_id").alias("at"), F.min_by("reason", "ball_id").alias("reason")).first()
    if first["at"] is not None:
        raise SolventError(f"ball {first['at']}: {first['reason']}")


def sample_points(balls: DataFrame, contacts: DataFrame, cells: DataFrame, probe: float, depth: int = DEPTH) -> DataFrame:
    """Points on the enlarged sphere of each exposed ball that are nearer to it than to every ball in
    contact with it, surface to surface: (structure_id, parent_index, k, x, y, z)."""
    exposed = cells.where("sas_area > 0").select("structure_id", F.col("index").alias("ball_id"))
    place = balls.select(*KEY, "x", "y", "z", "r")
    ends = F.array(F.struct(F.col("id_a").alias("ball_id"), F.col("id_b").alias("other")), F.struct(F.col("id_b").alias("ball_id"), F.col("id_a").alias("other")))
    half = contacts.select("structure_id", F.explode(ends).alias("e")).select("structure_id", "e.*")
    others = half.join(place.select("structure_id", F.col("ball_id").alias("other"), *[F.col(c).alias(f"o{c}") for c in "xyzr"]), ["structure_id", "other"])
    around = others.groupBy(*KEY).agg(F.collect_list(F.struct("ox", "oy", "oz", "or")).alias("near"))
    rows = place.join(exposed, KEY, "left_semi").join(around, KEY, "left").select(*KEY, "x", "y", "z", "r", "near")
    schema = T.StructType([rows.schema["structure_id"], *T._parse_datatype_string("parent_index long, k int, x double, y double, z double").fields])
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches):
        tree = SphereTree(depth)
        for batch in (b.slice(i, BALLS_AT_ONCE) for b in batches for i in range(0, len(b), BALLS_AT_ONCE)):
            column = lambda i: batch.column(i).to_numpy(zero_copy_only=False)
            centre, r = np.stack([column(i) for i in (2, 3, 4)], axis=1), column(5)
            near = batch.column(6)
            flat = near.flatten()
            owner = np.repeat(np.arange(len(batch)), near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            other = [flat.field(f"o{c}").to_numpy(zero_copy_only=False) for c in "xyzr"]
            free, _ = free_points(tree, centre, r, probe, owner, np.stack(other[:3], axis=1), other[3])
            ball, point = np.nonzero(free)
            at = centre[ball] + tree.points[point] * (r[ball] + probe)[:, None]
            own = pa.array(ball)
            columns = [batch.column(0).take(own), batch.column(1).take(own), pa.array(tree.k[point]), *map(pa.array, at.T)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def solvent_spheres(balls: DataFrame, probe: float = 1.4, volume_probe: float = 0.0, depth: int = DEPTH, box: PeriodicBox | None = None) -> DataFrame:
    """(structure_id, x, y, z, radius, weight, parent_index) of solvent spheres around balls.

    Weights are the volumes of the solvent's cells in a tessellation of balls, their radii changed from
    probe to volume_probe, and solvent together; 0 for one without a cell. In a periodic box, balls in
    contact with an image are compared where they are, not where the image is.
    """
    validate(balls, probe, volume_probe)
    keyed = balls if "structure_id" in balls.columns else balls.withColumn("structure_id", F.lit(0))
    keyed = keyed.select(*KEY, *[F.col(c).cast("double").alias(c) for c in "xyzr"])
    first = tessellate(keyed, probe, box).kept()
    points = staged(sample_points(keyed, first.contacts, first.cells, float(probe), depth), "points")
    # Solvent ids follow those of the balls of the structure: k counts less than `per` on each ball.
    per = len(sphere_points(depth))
    most = keyed.groupBy("structure_id").agg((F.max("ball_id") + 1).alias("n"))
    points = points.join(most, "structure_id").withColumn("ball_id", F.col("n") + F.col("parent_index") * per + F.col("k")).drop("n", "k")
    shrunk = keyed.withColumn("r", F.greatest(F.col("r") - float(probe) + float(volume_probe), F.lit(0.01)))
    both = shrunk.unionByName(points.select(*KEY, "x", "y", "z", F.lit(float(probe) + float(volume_probe)).alias("r")))
    weights = tessellate(both, 0.0, box).cells.select("structure_id", F.col("index").alias("ball_id"), F.col("volume").alias("weight"))
    out = points.join(weights, KEY, "left")
    return out.select("structure_id", "x", "y", "z", F.lit(float(probe)).alias("radius"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "parent_index")
