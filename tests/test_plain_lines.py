"""lines of planes that are far from parallel come from the rough look, without an exact one; and rounding without decimal numbers."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sphaera.functions import clipping, geometry, search


def _spheres(x, y, z, r):
    n = len(x)
    zero = np.zeros(n, np.int64)
    table = pa.table({"structure_id": zero, **{p: zero for p in search.PLACE[1:]}, "ball_id": np.arange(n), "x": x, "y": y, "z": z, "r": r, "grp": pa.nulls(n, pa.int64()), "image": zero.astype(np.int32), "mine": np.ones(n, bool)})
    return clipping.Spheres(pa.Table.from_batches(search.neighbourhoods(table)).combine_chunks().to_batches()[0])


def _case(kind):
    rng = np.random.default_rng(11)
    x, y, z = rng.uniform(0, 14, (3, 300))
    r = rng.choice((2.6, 3.0, 3.5), 300)
    if kind == "in a row":
        # Planes are all but parallel.
        y, z = rng.uniform(0, 0.02, (2, 300))
    if kind == "just touching":
        # Discs are tiny, and lines pass close by their rims.
        x, y, z = (np.round(c / 2.5) * 2.5 for c in (x, y, z))
        x, r = x + rng.uniform(0, 1e-7, 300), rng.choice((1.25 + 1e-8, 1.25 + 1e-6, 2.5, 3.0), 300)
    if kind == "within":
        x, y, z, r = (np.concatenate((c, c[:90] + m)) for c, m in ((x, 0.1), (y, 0.0), (z, 0.0), (r, 0.0)))
        r[300:] *= rng.choice((0.3, 1.0, 1.05), 90)
    return _spheres(x, y, z, r)


KINDS = pytest.mark.parametrize("kind", ["plain", "in a row", "just touching", "within"])


def _sorted(rows):
    rows = np.concatenate([np.stack([np.asarray(x, float) for x in r]) for r in rows], axis=1)
    return rows[:, np.lexsort(rows[::-1])]


@KINDS
def test_lines_are_those_of_an_exact_look(kind):
    s = _case(kind)
    _, lines = clipping.find_lines(s, s.pairs)
    here = s.pairs[lines.pair]
    want = _sorted([(s.owner[here], s.id[here], s.id[lines.entry], lines.dist)])
    got = _sorted([(rows, c["b"], c["c"], c["dist"]) for rows, c in clipping.line_columns(s)])
    assert got.shape == want.shape and np.abs(got - want).max(initial=0.0) < 1e-9


@KINDS
def test_no_disc_that_is_cut_away_for_sure_is_left(kind):
    s = _case(kind)
    alive, _ = clipping.find_lines(s, s.pairs)
    rough = clipping.rough_look(s)
    looked = np.concatenate((rough.left, clipping._spared(s, rough)))
    assert len(np.unique(looked)) == len(looked) and np.isin(s.pairs[alive], looked).all()


def test_most_lines_have_no_exact_look(monkeypatch):
    """All neighbours whose lines might cross a disc, and those that cut one away, had one."""
    s, met, inner, whole = _case("plain"), [], clipping._cuts, clipping._crossing
    monkeypatch.setattr(clipping, "_cuts", lambda s, pairs, pair, entry: (met.append(len(pair)), inner(s, pairs, pair, entry))[1])
    monkeypatch.setattr(clipping, "_crossing", lambda s, pairs, *most: (met.append(s.count[s.owner[pairs]].sum()), whole(s, pairs, *most))[1])
    rows = sum(len(r) for r, _ in clipping.line_columns(s))
    assert sum(met) < 0.02 * rows


def test_neighbours_are_in_the_order_of_all_keys():
    """Most were compared by four keys each."""
    rng = np.random.default_rng(3)
    for n, most, steps in ((1, 1, 1), (5000, 90, 4), (5000, 90, 100000), (150000, 140000, 3)):
        a, h = np.sort(rng.integers(0, most, n)) + 7, rng.integers(-steps, steps, n) / 50 + 0.0
        image, ball = rng.integers(0, 3, n).astype(np.int32), rng.integers(0, 500, n)
        got, want = (np.stack([x[by] for x in (a, h, image, ball)]) for by in (search._by_offset(a, h, image, ball), np.lexsort((ball, image, h, a))))
        assert (got == want).all()


def test_numbers_are_rounded_as_by_decimal_numbers(spark):
    rng = np.random.default_rng(5)
    odd = [0.0, -0.0, 0.00005, -0.00005, 0.12345, -0.12345, 2.00015, 1.00005, 1e-300, -1e-9, 99999.99995, 123456.78905, 1e5 + 0.00005, 3.3e12, -1.5e17, 1e300, math.inf, -math.inf, math.nan, None]
    values = odd + (rng.integers(-40000, 40000, 3000) / 1e4 + rng.choice((0.00005, 0.00005 - 1e-12, 0.00005 + 1e-15, 0.00002), 3000)).tolist()
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (2, 3, 4):
        plain = F.round("x", places) + F.lit(0.0)
        assert rows.where(~plain.eqNullSafe(geometry.rounded(F.col("x"), places))).count() == 0
