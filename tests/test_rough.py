"""A rough look at a disc tells which neighbours are worth an exact one, and changes no line and no contact."""

import numpy as np
import pyarrow as pa
import pytest

from sphaera.functions import clipping, search


def _table(kind):
    rng = np.random.default_rng(7)
    if kind == "lattice":
        # Rows of spheres: many planes are parallel, and many meet in one point.
        x, y, z = (c.ravel().astype(float) * 2.5 for c in np.meshgrid(*[np.arange(7)] * 3))
        r = np.full(len(x), 3.0)
    else:
        x, y, z = rng.uniform(0, 20, (3, 500))
        r = rng.choice((2.6, 3.0, 3.5), 500)
    if kind == "inner":
        # Equal spheres, and spheres within others.
        x, y, z = (np.concatenate((c, c[:60])) for c in (x, y, z))
        r = np.concatenate((r, r[:30], r[30:60] * 0.4))
    n = len(x)
    columns = {"structure_id": np.repeat((0, 1), (n // 3, n - n // 3)), **{p: np.zeros(n, np.int64) for p in ("px", "py", "pz")}, "ball_id": np.arange(n), "x": x, "y": y, "z": z, "r": r}
    return pa.table(columns | {"grp": pa.array(np.arange(n) // 10), "image": np.zeros(n, np.int32), "mine": np.arange(n) % 7 != 3})


def _spheres(kind):
    return clipping.Spheres(pa.Table.from_batches(search.neighbourhoods(_table(kind))).combine_chunks().to_batches()[0])


def _sorted(rows):
    rows = np.concatenate([np.stack([np.asarray(x, float) for x in r]) for r in rows], axis=1)
    return rows[:, np.lexsort(rows[::-1])]


KINDS = pytest.mark.parametrize("kind", ["plain", "inner", "lattice"])


@KINDS
def test_lines_are_those_of_an_exact_look(kind):
    s = _spheres(kind)
    _, lines = clipping.find_lines(s, s.pairs)
    here = s.pairs[lines.pair]
    want = _sorted([(s.owner[here], s.id[here], s.id[lines.entry], lines.dist)])
    got = _sorted([(rows, c["b"], c["c"], c["dist"]) for rows, c in clipping.line_columns(s)])
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-9


@KINDS
def test_contacts_are_those_of_all_lines(kind):
    s = _spheres(kind)
    alive, lines = clipping.find_lines(s, s.pairs)
    names = ("b", "area", "arc_length", "solid_angle_a", "pyramid_volume_b")
    want = _sorted([(rows, *[c[n] for n in names]) for rows, c in clipping._contacts(s, s.pairs, alive, lines, False)])
    got = _sorted([(rows, *[c[n] for n in names]) for rows, c in clipping.contact_columns(s, False)])
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-7


def test_few_neighbours_have_an_exact_look(monkeypatch):
    """F6, F9 and F11 to F14: each disc that was left met all neighbours of its sphere exactly, whatever its nearest lines left of it."""
    s, met, inner = _spheres("plain"), [], clipping._cuts
    monkeypatch.setattr(clipping, "_cuts", lambda s, pairs, pair, entry: (met.append(len(pair)), inner(s, pairs, pair, entry))[1])
    list(clipping.contact_columns(s, False))
    assert sum(met) < 0.4 * (s.count[s.owner[s.pairs]] - 1).sum()


@KINDS
def test_all_pairs_of_a_small_place_are_those_of_its_cells(kind, monkeypatch):
    rows = lambda: pa.Table.from_batches(search.neighbourhoods(_table(kind))).sort_by([("structure_id", "ascending"), ("a", "ascending")]).to_pylist()
    monkeypatch.setattr(search, "CANDIDATES", 500)
    small = rows()
    monkeypatch.setattr(search, "SMALL", 0)
    assert small == rows()
