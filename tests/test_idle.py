"""neighbours and lines that cut nothing are left out before contacts are made, and contacts stay those of all lines."""

import numpy as np
import pytest

from sphaera.functions import clipping
from sphaera.operators import cells, contacts
from sphaera.plans.tessellation import tessellate
from tests.test_rough import _sorted, _spheres

NAMES = ("b", "area", "arc_length", "solid_angle_a", "pyramid_volume_b")


@pytest.mark.parametrize("kind", ["plain", "inner", "lattice"])
def test_idle_neighbours_have_no_contact(kind):
    s = _spheres(kind)
    less = s.without_idle()
    alive, lines = clipping.find_lines(s, s.pairs)
    want = _sorted([(rows, *[c[n] for n in NAMES]) for rows, c in clipping._contacts(s, s.pairs, alive, lines, False)])
    alive, lines = clipping.find_lines(less, less.pairs)
    got = _sorted([(rows, *[c[n] for n in NAMES]) for rows, c in clipping._contacts(less, less.pairs, alive, lines, False)])
    assert len(less.id) < 0.8 * len(s.id)
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-9


def test_few_lines_are_cut():
    """Each disc that was left had its pieces made from all lines that reached what the six nearest ones left of it."""
    s = _spheres("plain").without_idle()
    alive, lines = clipping.find_lines(s, s.pairs)
    _, here, few = clipping.cutting_lines(s, s.pairs[s.ordinary[s.owner[s.pairs]]])
    assert here.sum() >= 0.9 * len(here)
    assert len(few.pair) < 0.5 * len(lines.pair)


def test_cells_are_summed_in_tasks(spark):
    """A ball had two rows for each contact; now it has one for each task that makes any of those, with the same sums."""
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 2}", i, *map(float, rng.uniform(0, 9, 3)), float(rng.choice((0.4, 1.3, 1.7)))) for i in range(240)]
    balls = spark.createDataFrame(rows, "structure_id string, ball_id long, x double, y double, z double, r double")
    t = tessellate(balls, 1.4)
    halves = contacts.half_sums(t.neighbourhoods).cache()
    assert halves.count() == halves.select("structure_id", "ball_id").distinct().count() <= 240
    want = cells.cells(t.spheres, contacts.measured(t.neighbourhoods)).orderBy("structure_id", "index").collect()
    got = cells.cells_of(t.spheres, cells.summaries_of_halves(halves)).orderBy("structure_id", "index").collect()
    assert got == want and len(got) > 100


def test_cells_of_centres_that_are_cut_away(spark):
    """A small ball whose centre lies beyond the plane of a large one, and beyond that of another one which the first makes idle."""
    rows = [(0, 0.0, 0.0, 0.0, 1.0), (1, 1.9, 0.0, 0.0, 2.5), (2, 1.5, 1.2, 0.0, 2.2), (3, -1.2, 0.3, 0.1, 0.7), (4, 0.2, -1.4, 0.3, 0.9), (5, 0.1, 0.2, 1.6, 1.1)]
    balls = spark.createDataFrame(rows, "ball_id long, x double, y double, z double, r double")
    got = {r["index"]: r for r in tessellate(balls, 0.0).cells.collect()}
    at = np.random.default_rng(1).uniform(-3.5, 5.0, (2_000_000, 3))
    power = np.stack([((at - np.array(p)) ** 2).sum(axis=1) - r * r for _, *p, r in rows])
    inside, nearest = power.min(axis=0) < 0, power.argmin(axis=0)
    for i in range(len(rows)):
        volume = (inside & (nearest == i)).mean() * 8.5**3
        assert abs((got[i]["volume"] if i in got else 0.0) - volume) < 0.08, i
