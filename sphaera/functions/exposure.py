"""Which points on spheres lie nearer to their own ball than to every neighbour, surface to surface, in numpy.

A neighbour is nearer to the points of a cap. The points of a sphere are leaves of a tree of triangles: a cap takes or
leaves whole triangles, and only those that its edge crosses are looked at further, down to single points.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from sphaera.functions.icosahedron import SphereTree

# Tasks get this module with their code and need not find it where they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Angles by which a triangle must be within a cap, or out of it, to be taken whole.
SLACK = 1e-9


def free_points(tree: SphereTree, centre: np.ndarray, r: np.ndarray, probe: float, owner: np.ndarray, other: np.ndarray, other_r: np.ndarray) -> tuple[np.ndarray, int]:
    """For each ball (centre n x 3, radius r), which of the tree's points on its sphere enlarged by probe no neighbour
    takes: owner is the ball that a neighbour (other m x 3, other_r) belongs to. Also how many triangles and
    points were compared with caps."""
    n, size = len(centre), len(tree.points)
    v = other - centre[owner]
    d = np.sqrt((v * v).sum(axis=1))
    far = r[owner] + probe
    # The cosine of the cap's angle; neighbours at the same place take all points or none.
    reach = d * d + far * far - (other_r + probe) ** 2
    cosine = np.where(d > 0, reach / np.where(d > 0, 2.0 * far * d, 1.0), np.where(reach <= 0, -2.0, 2.0))
    angle = np.arccos(np.clip(cosine, -1.0, 1.0)) + np.where(cosine <= -1.0, 1.0, 0.0)
    toward = v / np.where(d > 0, d, 1.0)[:, None]
    taken = np.zeros((n, size), bool)
    compared = 0
    entry = np.repeat(np.nonzero(cosine <= 1.0 + SLACK)[0], len(tree.levels[0][0]))
    node = np.tile(np.arange(len(tree.levels[0][0])), len(entry) // len(tree.levels[0][0]))
    for level, (middle, radius, low, high) in enumerate(tree.levels):
        # Empty triangles, and those that other caps have taken, need no look.
        before = np.concatenate((np.zeros((n, 1), np.int64), np.cumsum(taken, axis=1)), axis=1)
        own = owner[entry]
        left = (high - low)[node] > before[own, high[node]] - before[own, low[node]]
        entry, node, own = entry[left], node[left], own[left]
        compared += len(entry)
        apart = np.arccos(np.clip((toward[entry] * middle[node]).sum(axis=1), -1.0, 1.0))
        inside = apart + radius[node] <= angle[entry] - SLACK
        marks = np.zeros((n, size + 1), np.int64)
        np.add.at(marks, (own[inside], low[node[inside]]), 1)
        np.add.at(marks, (own[inside], high[node[inside]]), -1)
        taken |= np.cumsum(marks, axis=1)[:, :-1] > 0
        crossed = ~inside & (apart - radius[node] <= angle[entry] + SLACK)
        entry, node = entry[crossed], node[crossed]
        if level + 1 < len(tree.levels):
            entry, node = np.repeat(entry, 4), (node[:, None] * 4 + np.arange(4)).ravel()
    low, high = tree.levels[-1][2], tree.levels[-1][3]
    many = (high - low)[node]
    entry, point = np.repeat(entry, many), np.repeat(low[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    own = owner[entry]
    at = centre[own] + tree.points[point] * (r[own] + probe)[:, None]
    length = lambda x: np.sqrt((x * x).sum(axis=1))
    nearer = length(at - other[entry]) - other_r[entry] <= length(at - centre[own]) - r[own]
    taken[own[nearer], point[nearer]] = True
    return ~taken, compared + len(entry)
