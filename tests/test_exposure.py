"""Points of spheres that no neighbour is nearer to, against all comparisons."""

import numpy as np
import pytest

from sphaera.functions.exposure import free_points
from sphaera.functions.icosahedron import SphereTree, sphere_points


def brute(points, centre, r, probe, owner, other, other_r):
    out = np.ones((len(centre), len(points)), bool)
    for e, b in enumerate(owner):
        at = centre[b] + points * (r[b] + probe)
        out[b] &= ~(np.linalg.norm(at - other[e], axis=1) - other_r[e] <= np.linalg.norm(at - centre[b], axis=1) - r[b])
    return out


@pytest.mark.parametrize("depth", range(5))
def test_free_points(depth):
    """Neighbours of many sizes, near and far, at the same place, and around all of a ball; balls without any."""
    rng = np.random.default_rng(depth)
    n = 30
    centre, r = rng.uniform(0, 9, (n, 3)), rng.uniform(0.8, 2.5, n)
    owner = np.repeat(np.arange(n - 2), 14)
    other = centre[owner] + rng.normal(0, 2.0, (len(owner), 3))
    other_r = rng.choice([0.3, 1.0, 1.7, 4.0], len(owner), p=[0.3, 0.4, 0.25, 0.05])
    other[:3] = centre[owner[:3]]
    other_r[:3] = r[owner[:3]] + [-0.2, -0.1, -0.3]
    other[20], other_r[20] = centre[owner[20]], r[owner[20]]
    tree = SphereTree(depth)
    got, compared = free_points(tree, centre, r, 1.4, owner, other, other_r)
    assert (got == brute(tree.points, centre, r, 1.4, owner, other, other_r)).all()
    assert 0 < got.sum() < got.size and got[-2:].all() and not got[owner[20]].any()
    if depth == 4:
        assert compared < 0.1 * len(tree.points) * len(owner)


def test_tree_has_all_points():
    for depth in range(5):
        tree = SphereTree(depth)
        assert sorted(tree.k.tolist()) == list(range(len(sphere_points(depth)))) and np.allclose(tree.points, np.array(sphere_points(depth))[tree.k])
        for middle, radius, low, high in tree.levels:
            assert low[0] == 0 and high[-1] == len(tree.points) and (low[1:] == high[:-1]).all()
