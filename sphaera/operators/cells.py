"""Cells: accessible surface area and volume of each ball, from its contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphaera.functions.geometry import PI, exact_sum
from sphaera.operators.contacts import SUMS
from sphaera.operators.overlap import KEY


def half_contacts(rows: DataFrame) -> DataFrame:
    """The two ends of each contact, and the spheres that only have neighbours, with nulls. The end at an image is its
    ball's, as the contact across the other side of the box is the same one."""
    common = ["area", "arc_length"]
    ends = F.array(
        F.struct(F.col("a").alias("ball_id"), *common, F.col("solid_angle_a").alias("solid"), F.col("pyramid_volume_a").alias("volume")),
        F.struct(F.col("b").alias("ball_id"), *common, F.col("solid_angle_b").alias("solid"), F.col("pyramid_volume_b").alias("volume")),
    )
    return rows.select("structure_id", F.explode(ends).alias("e")).select("structure_id", "e.*").where("ball_id is not null")


def summaries(rows: DataFrame) -> DataFrame:
    """Per ball that has neighbours: number of contacts, and arc length, solid angles and volumes, by sign."""
    plus = lambda c: exact_sum(F.greatest(F.col(c), F.lit(0.0)))
    minus = lambda c: exact_sum(F.greatest(-F.col(c), F.lit(0.0)))
    return half_contacts(rows).groupBy(*KEY).agg(
        F.count("area").alias("n_contacts"), exact_sum(F.col("arc_length")).alias("arc_length"),
        plus("solid").alias("solid_plus"), minus("solid").alias("solid_minus"), plus("volume").alias("volume_plus"), minus("volume").alias("volume_minus"),
    )


def summaries_of_halves(sums: DataFrame) -> DataFrame:
    """summaries() from what contacts.half_sums() has."""
    total = lambda n: (F.sum(f"{n}_whole").cast("double") / float(1 << 20) + F.sum(f"{n}_rest").cast("double") / float(1 << 48)).alias(n)
    return sums.groupBy(*KEY).agg(F.sum("n_contacts").alias("n_contacts"), *map(total, SUMS))


def _measures() -> tuple[Column, Column]:
    """Accessible area and volume of a ball with contacts."""
    r, net = F.col("r"), F.col("solid_plus") - F.col("solid_minus")
    inner = F.col("volume_plus") - F.col("volume_minus")
    open_area = F.when(net > 0, (4.0 * PI - net) * r * r).otherwise(-net * r * r)
    open_volume = open_area * r / 3.0 + inner
    seen = (F.col("arc_length") > 0) & (F.abs(net) > 1e-10) & (open_volume <= 4.0 / 3.0 * PI * r * r * r)
    return F.when(seen, open_area).otherwise(0.0), F.when(seen, open_volume).otherwise(inner)


def cells(spheres: DataFrame, rows: DataFrame, detached_without_contacts: bool = False) -> DataFrame:
    """(structure_id, index, sas_area, volume) of every ball that has a contact or no neighbour at all; the
    latter, hidden ones included, keep their whole sphere. A ball with neighbours but no contact has no cell,
    unless detached_without_contacts. rows are those of contacts.measured()."""
    return cells_of(spheres, summaries(rows), detached_without_contacts)


def cells_of(spheres: DataFrame, summed: DataFrame, detached_without_contacts: bool = False) -> DataFrame:
    """cells() from summaries()."""
    out = spheres.select(*KEY, "r").join(summed, KEY, "left")
    if not detached_without_contacts:
        out = out.where("n_contacts is null or n_contacts > 0")
    area, volume = _measures()
    whole = F.col("r") * F.col("r") * (4.0 * PI)
    alone = F.coalesce("n_contacts", F.lit(0)) == 0
    return out.select(
        "structure_id", F.col("ball_id").alias("index"), F.when(alone, whole).otherwise(area).alias("sas_area"),
        F.when(alone, whole * F.col("r") / 3.0).otherwise(volume).alias("volume"),
    )


def totals(balls: DataFrame, contact: DataFrame, cell: DataFrame) -> DataFrame:
    """One row a structure: numbers of balls, contacts and cells, and the three totals."""
    sid = F.col("structure_id") if "structure_id" in balls.columns else F.lit(0)
    parts = [
        balls.select(sid.alias("structure_id")).groupBy("structure_id").agg(F.count("*").alias("num_balls")),
        contact.groupBy("structure_id").agg(F.count("*").alias("num_contacts"), exact_sum(F.col("area")).alias("total_contact_area")),
        cell.groupBy("structure_id").agg(F.count("*").alias("num_cells"), exact_sum(F.col("sas_area")).alias("total_sas_area"), exact_sum(F.col("volume")).alias("total_volume")),
    ]
    out = parts[0].join(parts[1], "structure_id", "left").join(parts[2], "structure_id", "left")
    zero = {"num_contacts": 0, "num_cells": 0, "total_contact_area": 0.0, "total_sas_area": 0.0, "total_volume": 0.0}
    return out.fillna(zero).select("structure_id", "num_balls", "num_contacts", "num_cells", "total_sas_area", "total_volume", "total_contact_area")


def per_ball(balls: DataFrame, cell: DataFrame) -> DataFrame:
    """Every ball with sas_area and volume, null where it has no cell."""
    keyed = balls if "structure_id" in balls.columns else balls.withColumn("structure_id", F.lit(0))
    measures = cell.select("structure_id", F.col("index").alias("ball_id"), "sas_area", "volume")
    return keyed.join(measures, KEY, "left")
