"""Images of spheres in a periodic box."""

import random

from sphaera.operators import overlap, periodic
from sphaera.operators.periodic import PeriodicBox

BOX = PeriodicBox.from_corners((0, 0, 0), (30, 30, 30))


def _balls(spark):
    rng = random.Random(3)
    rows = [(s, i, *[rng.uniform(-2, 30) for _ in range(3)], rng.choice((0.4, 1.2, 2.0))) for s in range(2) for i in range(40)]
    return spark.createDataFrame(rows, "structure_id long, ball_id long, x double, y double, z double, r double")


def test_images_too_far_have_no_rows(spark):
    """They are left out of the array before there are rows for them, and it is the structures that are broadcast, not the images."""
    spheres = overlap.spheres_of(_balls(spark), 0.0)
    far = spheres.where("x < 1 or x > 29")
    got = periodic.images(far, BOX)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(filter(" in plan and "strategy=broadcast" in got._jdf.queryExecution().optimizedPlan().toString()
    low, high = {}, {}
    rows = far.collect()
    for s in (0, 1):
        own = [r for r in rows if r["structure_id"] == s]
        most = 2 * max(r["r"] for r in own)
        for c in "xyz":
            low[s, c], high[s, c] = min(r[c] for r in own) - most, max(r[c] for r in own) + most
    want = set()
    for r in rows:
        for i, shift in enumerate(periodic.SHIFTS):
            at = {c: r[c] + v for c, v in zip("xyz", BOX.shift(shift))}
            if i == 0 or all(low[r["structure_id"], c] <= at[c] <= high[r["structure_id"], c] for c in "xyz"):
                want.add((r["structure_id"], r["ball_id"], i, *at.values()))
    assert {(r["structure_id"], r["ball_id"], r["image"], r["x"], r["y"], r["z"]) for r in got.collect()} == want
