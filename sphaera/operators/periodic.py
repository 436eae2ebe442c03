"""Periodic boxes: images of spheres and removal of repeated contacts."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphaera.staging import staged

#: Image 0 is the sphere itself; the 26 others follow in ascending order of their shifts.
SHIFTS = [(0, 0, 0)] + [s for s in product((-1, 0, 1), repeat=3) if s != (0, 0, 0)]
#: Images n and 27 - n are opposite; the first thirteen stand for both where a sphere meets its own images.
LAST_FORWARD = 13
#: The most structures whose extents are broadcast.
STRUCTURES = 100_000


@dataclass(frozen=True)
class PeriodicBox:
    """Three lattice vectors."""

    a: tuple[float, float, float]
    b: tuple[float, float, float]
    c: tuple[float, float, float]

    @classmethod
    def from_corners(cls, low, high) -> PeriodicBox:
        return cls((high[0] - low[0], 0.0, 0.0), (0.0, high[1] - low[1], 0.0), (0.0, 0.0, high[2] - low[2]))

    @classmethod
    def from_vectors(cls, a, b, c) -> PeriodicBox:
        return cls(tuple(map(float, a)), tuple(map(float, b)), tuple(map(float, c)))

    @classmethod
    def from_dict(cls, box: dict) -> PeriodicBox:
        """From {"corners": two points} or {"vectors": three vectors}."""
        for key, n, make in (("corners", 2, cls.from_corners), ("vectors", 3, cls.from_vectors)):
            if key in box:
                points = [tuple(map(float, p)) for p in box[key]]
                if len(points) != n or any(len(p) != 3 for p in points):
                    raise ValueError(f"a periodic box needs {n} {key} of three numbers each")
                return make(*points)
        raise ValueError('a periodic box needs "corners" or "vectors"')

    def inverse(self) -> list[tuple[float, ...]]:
        """Rows that take a point to its coordinates along the three vectors."""
        return [tuple(map(float, row)) for row in np.linalg.inv(np.array([self.a, self.b, self.c]).T)]

    def heights(self) -> list[float]:
        """How far opposite sides are apart, along each vector."""
        return [float(1.0 / np.linalg.norm(row)) for row in np.array(self.inverse())]

    def shift(self, s: tuple[int, int, int]) -> tuple[float, float, float]:
        return tuple(s[0] * self.a[i] + s[1] * self.b[i] + s[2] * self.c[i] for i in range(3))


def reaches(spheres: DataFrame, *more: Column) -> DataFrame:
    """Of each structure, the least and largest coordinates, the largest radius, and more aggregates."""
    return spheres.groupBy("structure_id").agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))], F.max("r").alias("most"), *more)


def images_within(rows: DataFrame, box: PeriodicBox) -> DataFrame:
    """images() of spheres that come with their structure's reaches(). Those that are too far are left out before there
    are rows for them."""
    move = lambda s: F.struct(*[F.lit(float(d)).alias(f"d{c}") for c, d in zip("xyz", box.shift(s))])
    moves = F.array(*[F.struct(F.lit(i).alias("image"), move(s).alias("d")) for i, s in enumerate(SHIFTS)])

    def near(m: Column) -> Column:
        inside = F.lit(True)
        for c in "xyz":
            at = F.col(c) + m["d"][f"d{c}"]
            inside = inside & at.between(F.col(f"low{c}") - 2.0 * F.col("most"), F.col(f"high{c}") + 2.0 * F.col("most"))
        return (m["image"] == 0) | inside

    kept = [c for c in rows.columns if c not in ("x", "y", "z")]
    rows = rows.select("*", F.explode(F.filter(moves, near)).alias("m"))
    return rows.select(*kept, *[(F.col(c) + F.col(f"m.d.d{c}")).alias(c) for c in "xyz"], "m.image")


def images(spheres: DataFrame, box: PeriodicBox) -> DataFrame:
    """The 27 images of every sphere with their number, but for those too far from all spheres to touch one."""
    found = staged(reaches(spheres), "reaches")
    # Spark would choose by the size of the files, and the spheres of small ones can be too many to broadcast.
    few = found.limit(STRUCTURES + 1).count() <= STRUCTURES
    rows = spheres.join(F.broadcast(found) if few else found.hint("merge"), "structure_id")
    return images_within(rows, box).select(*spheres.columns, "image")


def first_of_pair(found: DataFrame, merge_inner: bool) -> DataFrame:
    """One contact for each unordered pair of balls among those with images; the first one by a, plane
    offset and image stays. With merge_inner, contacts within the box count as well and go first where
    they come first; otherwise they all stay."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    group = F.lit(False) if merge_inner else F.col("bimage") != 0
    order = F.struct("a", "h", "bimage", "b")
    rows = found.withColumns({"lo": low, "hi": high, "edge": group, "ord": order})
    kept = [c for c in found.columns if c != "structure_id"]
    best = rows.groupBy("structure_id", "lo", "hi", "edge").agg(F.min_by(F.struct(*kept), "ord").alias("x"))
    return best.select("structure_id", F.col("lo").alias("a_id"), F.col("hi").alias("b_id"), "x.*")
