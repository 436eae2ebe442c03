"""The look at a disc's first neighbours changes no line, and spares many discs the others."""

import numpy as np
import pyarrow as pa

from sphaera.functions import clipping, search


def _spheres(n=500, side=20.0):
    rng = np.random.default_rng(5)
    columns = {"structure_id": np.zeros(n, np.int64), **{p: np.zeros(n, np.int64) for p in ("px", "py", "pz")}, "ball_id": np.arange(n)}
    columns |= {c: rng.uniform(0, side, n) for c in "xyz"} | {"r": rng.choice((2.6, 3.0, 3.5), n)}
    table = pa.table(columns | {"grp": pa.nulls(n, pa.int64()), "image": np.zeros(n, np.int32), "mine": np.ones(n, bool)})
    return clipping.Spheres(pa.Table.from_batches(search.neighbourhoods(table)).combine_chunks().to_batches()[0])


def test_lines_are_those_of_all_neighbours_at_once():
    s = _spheres()
    alive, lines = clipping.find_lines(s, s.pairs)
    want_alive, want = clipping._crossing(s, s.pairs)
    assert (alive == want_alive).all()
    for name in ("pair", "entry", "dist", "n1", "n2"):
        assert (getattr(lines, name) == getattr(want, name)).all()


def test_discs_that_the_first_neighbours_cut_away_do_not_meet_the_others(monkeypatch):
    """F4 to F8 and F10 to F15: each pair met all neighbours of its sphere, those cut away by one of the first as well."""
    s, met, inner = _spheres(), [], clipping._crossing
    monkeypatch.setattr(clipping, "_crossing", lambda s, pairs, most=None: (met.append((len(pairs), most)), inner(s, pairs, most))[1])
    clipping.find_lines(s, s.pairs)
    assert sum(n for n, most in met if most is None) < 0.7 * len(s.pairs)
    assert all(n * min(most or 1 << 30, int(s.count.max())) <= clipping.LOOK for n, most in met)


def test_nearest_lines_are_the_nearest():
    rng = np.random.default_rng(2)
    count = np.array([3, 0, 40, 7, 13])
    pair = np.repeat(np.arange(5), count)
    lines = clipping.Lines(pair, np.arange(len(pair)), rng.normal(size=len(pair)), rng.normal(size=len(pair)), rng.normal(size=len(pair)))
    rows = np.array([0, 1, 2, 4])
    dist, _, _, valid = lines.nearest(rows, 5)
    for i, row in enumerate(rows):
        assert sorted(dist[i][valid[i]]) == sorted(lines.dist[pair == row])[: clipping.NEAREST]
