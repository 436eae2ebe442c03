"""Points spread over a sphere: the corners of an icosahedron whose faces are split again and again."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np

MAX_DEPTH = 4


def clamp_depth(depth: int) -> int:
    return max(0, min(int(depth), MAX_DEPTH))


def _subdivided(depth: int) -> tuple[list[tuple[float, float, float]], list[list[tuple[int, int, int]]]]:
    """The points, and the faces of each level; those that face i is split into are 4 i to 4 i + 3 of the next.

    The faces of the icosahedron are the triples of corners at the shortest distance from each other, so
    they need no table.
    """
    golden = (1 + math.sqrt(5)) / 2

    def unit(v):
        n = math.sqrt(sum(x * x for x in v))
        return tuple(x / n for x in v)

    points = [unit(v) for a in (1.0, -1.0) for b in (golden, -golden) for v in ((b, a, 0.0), (a, 0.0, b), (0.0, b, a))]
    edge = min(math.dist(p, q) for p, q in combinations(points, 2)) * 1.0001
    levels = [[t for t in combinations(range(12), 3) if all(math.dist(points[i], points[j]) <= edge for i, j in combinations(t, 2))]]
    for _ in range(clamp_depth(depth)):
        middle: dict[tuple[int, int], int] = {}

        def between(i, j):
            key = (min(i, j), max(i, j))
            if key not in middle:
                middle[key] = len(points)
                points.append(unit(tuple(x + y for x, y in zip(points[i], points[j]))))
            return middle[key]

        split = []
        for a, b, c in levels[-1]:
            ab, bc, ca = between(a, b), between(b, c), between(c, a)
            split += [(a, ab, ca), (b, bc, ab), (c, ca, bc), (ab, bc, ca)]
        levels.append(split)
    return points, levels


def sphere_points(depth: int) -> list[tuple[float, float, float]]:
    """12, 42, 162, 642 or 2562 unit vectors; depths beyond 4 count as 4."""
    return _subdivided(depth)[0]


class SphereTree:
    """The points in an order in which each face of each level has a run of them, from ``low`` to ``high``, which lie
    within the angle ``radius`` of ``middle``. A point belongs to the first face of the last level that has it."""

    def __init__(self, depth: int):
        points, levels = _subdivided(depth)
        owner: dict[int, int] = {}
        for i, face in enumerate(levels[-1]):
            for k in face:
                owner.setdefault(k, i)
        #: The number of each point in sphere_points().
        self.k = np.array(sorted(range(len(points)), key=lambda k: (owner[k], k)))
        self.points = np.array(points)[self.k]
        faces = np.array([owner[k] for k in self.k.tolist()])
        self.levels = []
        for level, own in enumerate(levels):
            size = 4 ** (len(levels) - 1 - level)
            low, high = (np.searchsorted(faces, np.arange(len(own)) * size + end) for end in (0, size))
            middle = np.zeros((len(own), 3))
            radius = np.zeros(len(own))
            for i, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
                if b > a:
                    mean = self.points[a:b].sum(axis=0)
                    middle[i] = mean / np.linalg.norm(mean)
                    radius[i] = np.arccos(np.clip(self.points[a:b] @ middle[i], -1.0, 1.0)).max()
            self.levels.append((middle, radius, low, high))
