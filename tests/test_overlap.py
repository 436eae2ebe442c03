"""The overlap join against brute force: spheres of very different sizes, crowded cells, boxes of any shape."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from sphaera.operators import overlap
from sphaera.operators.overlap import overlaps, spheres_of
from sphaera.operators.periodic import SHIFTS, PeriodicBox
from sphaera.plans.tessellation import tessellate

SLACK = 1e-10


def table(spark, balls):
    rows = [(s, i, *map(float, b)) for s, structure in enumerate(balls) for i, b in enumerate(structure)]
    return spheres_of(spark.createDataFrame(rows, "structure_id long, ball_id long, x double, y double, z double, r double").repartition(5))


def brute(balls, box=None):
    out = set()
    for s, structure in enumerate(balls):
        p, r = np.array([b[:3] for b in structure]), np.array([b[3] for b in structure])
        for n, shift in enumerate(SHIFTS if box else [(0, 0, 0)]):
            moved = p + (np.array(box.shift(shift)) if box else 0.0)
            d2 = ((p[:, None] - moved[None]) ** 2).sum(axis=2)
            a, b = np.nonzero(d2 + SLACK < (r[:, None] + r[None]) ** 2)
            out |= {(s, i, j, n) for i, j in zip(a.tolist(), b.tolist()) if n or i != j}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("structure_id", "a", "b", "bimage").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def sizes(rng, n, spread, least=0.6, most=2.5):
    return np.column_stack([rng.uniform(0, spread, (n, 3)), rng.uniform(least, most, n)])


def mixed(rng):
    """Radii over five powers of two, some of them inside one another; and structures of one size, one ball, none."""
    many = np.vstack([sizes(rng, 250, 40.0), sizes(rng, 40, 40.0, 3.0, 9.0), sizes(rng, 4, 40.0, 20.0, 30.0), sizes(rng, 60, 40.0, 0.01, 0.3)])
    return [many - [11.0, 11.0, 11.0, 0.0], sizes(rng, 60, 12.0, 1.0, 1.0), sizes(rng, 1, 5.0), sizes(rng, 80, 15.0)]


def test_radii_of_many_sizes(spark):
    balls = mixed(np.random.default_rng(1))
    spheres = table(spark, balls)
    want = brute(balls)
    assert found(overlaps(spheres)) == want
    some = spheres.where("ball_id % 7 = 2").select("structure_id", "ball_id")
    assert found(overlaps(spheres, None, some)) == {r for r in want if r[1] % 7 == 2}


@pytest.mark.parametrize("box", [
    PeriodicBox.from_corners((0, 0, 0), (40, 40, 40)), PeriodicBox.from_vectors((41, 0, 0), (7, 39, 0), (-9, 5, 37)),
    PeriodicBox.from_corners((0, 0, 0), (6, 50, 3.5)), PeriodicBox.from_vectors((14, 2, 1), (0, 13, 3), (5, -4, 60)),
])
def test_boxes_of_any_shape(spark, box):
    """Also boxes that are shorter than a sphere is wide, and balls that lie up to two boxes off."""
    balls = mixed(np.random.default_rng(2))[1:] + [np.vstack([sizes(np.random.default_rng(3), 60, 60.0, 0.5, 3.0) - [30.0, 30.0, 30.0, 0.0], [[5.0, 5.0, 5.0, 11.0]]])]
    spheres = table(spark, balls)
    want = brute(balls, box)
    assert found(overlaps(spheres, box)) == want
    some = spheres.where("ball_id % 5 = 1").select("structure_id", "ball_id")
    assert found(overlaps(spheres, box, some)) == {r for r in want if r[1] % 5 == 1}


def test_crowded_cells_are_split(spark, monkeypatch):
    """Cells with more rows than the limit meet block by block, with the same pairs."""
    monkeypatch.setattr(overlap, "CELL_ROWS", 20)
    rng = np.random.default_rng(4)
    balls = [np.vstack([sizes(rng, 150, 6.0), sizes(rng, 100, 30.0), [[3.0, 3.0, 3.0, 40.0]]])]
    spheres = table(spark, balls)
    (classed,), many = overlap._with_classes(spheres)
    assert many
    stays, calls, on = overlap._split(overlap._stays(classed, None), overlap._calls(classed, None, half=True), many)
    assert on[-2:] == ["a_block", "b_block"]
    assert stays.groupBy(*on).count().agg(F.max("count")).first()[0] <= 3 * 20
    assert calls.groupBy(*on).count().agg(F.max("count")).first()[0] <= 3 * 20
    assert found(overlaps(spheres)) == brute(balls)


def test_one_large_ball_among_many_small(spark):
    """100,000 small balls and one of a hundred times their radius: few candidates for each pair that overlaps, and
    no cell that has more rows than a block may."""
    rng = np.random.default_rng(5)
    small = np.column_stack([rng.uniform(0, 300, (100_000, 3)), np.full(100_000, 1.5)])
    large = np.array([150.0, 150.0, 150.0, 150.0])
    df = spark.createDataFrame([(0, i, *map(float, b)) for i, b in enumerate(np.vstack([small, [large]]))], "structure_id long, ball_id long, x double, y double, z double, r double")
    spheres = spheres_of(df.repartition(16))
    (classed,), many = overlap._with_classes(spheres)
    assert many
    stays, calls, on = overlap._split(overlap._stays(classed, None), overlap._calls(classed, None, half=True), many)
    sizes_of = lambda df, n: df.groupBy(*on).agg(F.count("*").alias(n))
    both = sizes_of(stays, "m").join(sizes_of(calls, "n"), on)
    candidates, most = both.agg(F.sum(F.col("m") * F.col("n")), F.max("m")).first()
    got = overlaps(spheres)
    pairs = got.where("a < b").count()
    assert candidates <= 20 * pairs and most <= 3 * overlap.CELL_ROWS
    near = ((small[:, :3] - large[:3]) ** 2).sum(axis=1) + SLACK < (small[:, 3] + large[3]) ** 2
    assert got.where("a = 100000").count() == int(near.sum())
    some = rng.choice(100_000, 300, replace=False)
    d2 = ((small[some, None, :3] - small[None, :, :3]) ** 2).sum(axis=2) + SLACK
    want = {(int(some[i]), int(j)) for i, j in zip(*np.nonzero(d2 < 9.0)) if some[i] != j}
    picked = spark.createDataFrame([(int(i),) for i in some], "a long")
    assert {(r["a"], r["b"]) for r in got.join(F.broadcast(picked), "a").where("b < 100000").collect()} == want


def test_contacts_in_a_box_do_not_depend_on_where_it_is_cut(spark):
    """Areas and cells of a periodic set are the same after all balls moved by one vector and back into the box."""
    rng = np.random.default_rng(6)
    box = PeriodicBox.from_vectors((18, 0, 0), (4, 17, 0), (-3, 5, 19))
    inside = rng.uniform(0, 1, (90, 3))
    r = rng.uniform(1.0, 2.2, 90)
    frame = np.array([box.a, box.b, box.c])
    results = []
    for move in (0.0, 0.37):
        at = ((inside + move) % 1.0) @ frame
        df = spark.createDataFrame([(i, *map(float, p), float(x)) for i, (p, x) in enumerate(zip(at, r))], "ball_id long, x double, y double, z double, r double")
        t = tessellate(df, 1.0, box).kept()
        areas = t.contacts_full.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.sum("area").alias("area"))
        results.append(({(x["i"], x["j"]): x["area"] for x in areas.collect()}, {x["index"]: (x["sas_area"], x["volume"]) for x in t.cells.collect()}))
    (areas, cells), (moved_areas, moved_cells) = results
    assert areas.keys() == moved_areas.keys() and all(areas[k] == pytest.approx(moved_areas[k], abs=1e-6) for k in areas)
    assert cells.keys() == moved_cells.keys() and all(cells[k] == pytest.approx(moved_cells[k], abs=1e-6) for k in cells)


def test_own_images(spark):
    """One ball in a box that is narrower than it: its cell is what its own images leave."""
    box = PeriodicBox.from_corners((0, 0, 0), (3, 9, 9))
    df = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 2.0)], "ball_id long, x double, y double, z double, r double")
    t = tessellate(df, 0.0, box)
    (contact,) = t.contacts.collect()
    assert contact["area"] == pytest.approx(np.pi * (4 - 2.25))
    (cell,) = t.cells.collect()
    cap = np.pi * 0.5**2 * (3 * 2 - 0.5) / 3
    assert cell["volume"] == pytest.approx(4 / 3 * np.pi * 8 - 2 * cap) and cell["sas_area"] == pytest.approx(4 * np.pi * 4 - 2 * (2 * np.pi * 2 * 0.5))
    assert len(list(product(range(3), repeat=3))) == len(SHIFTS)
