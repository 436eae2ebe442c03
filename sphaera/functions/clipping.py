"""Contacts of a batch of spheres with their neighbours, in numpy.

The part of a disc within several half-planes is a sum over its boundary: the uncovered arcs of the circle
and the surviving piece of each line. So there is no polygon to cut: every line keeps an interval, every
line removes an angle, and area, arc length and solid angles are sums of those. All pairs of a batch go
through each step together, in blocks of bounded size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from sphaera.functions.geometry import EPSILON, TAU

# Tasks get this module with their code and need not find it where they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Below this, a piece of a line or an arc is a rounding error of one that is not there.
SLIVER = 1e-9
#: Lines whose directions differ by less are parallel.
PARALLEL = 1e-11
#: Lines of the first, rough look at a disc.
NEAREST = 6
#: Neighbours, nearest plane first, that cut most of the discs away that are cut away as a whole.
FIRST = 8
#: Spheres whose numbers of neighbours differ by less may go together.
BIN = 16
#: Candidates (pair and neighbour) that are looked at together: arrays of this size stay in the cache of a core.
LOOK = 1 << 15
#: Candidates that may have lines at once, of pairs that have an exact look at all.
BLOCK = 1 << 18
#: Places of lines whose pieces are found together, for the same reason.
PIECES = 1 << 13
#: Spheres with more neighbours have no rough look at all of them.
MOST = 512
#: How far a rough distance may be off, for a disc of radius 1; and the least squared sine that counts between directions.
ROUGH = 1e-6
#: The least sine between planes that are far from parallel, whose rough distance is off by rounding alone; and the least radius of
#: a disc whose lines a rough look tells.
PLAIN = 0.03
LEAST_DISC = 1e-3
#: The least sine between planes whose line is told with half as many digits, and how far that may be off, for a sphere of radius 1.
FLAT = 0.02
COARSE = 2e-4
#: Candidates whose lines are found together, for the same reason as LOOK.
LINES = 1 << 13
#: Lines of a disc, nearest first, make others idle: one for so many neighbours, but at least three.
PER_ROUND = 4
#: The square of a distance that no neighbour has.
FAR = 1e18
#: The least area of a contact.
LEAST_AREA = 1e-12


class Spheres:
    """A batch of rows (a, ax, ay, az, ar, agrp, near) as flat arrays: one entry for each neighbour."""

    def __init__(self, batch: pa.RecordBatch):
        near = batch.column(batch.schema.get_field_index("near"))
        offsets = near.offsets.to_numpy()
        self.begin, self.count = offsets[:-1] - offsets[0], np.diff(offsets)
        flat = near.flatten()
        entry = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
        sphere = lambda name: batch.column(batch.schema.get_field_index(name))
        self.owner = np.repeat(np.arange(len(batch)), self.count)
        self.id, self.image, self.h, self.r = entry("b"), entry("bimage"), entry("h"), entry("br")
        self.own_id = sphere("a").to_numpy(zero_copy_only=False)
        self.own_r = sphere("ar").to_numpy(zero_copy_only=False)[self.owner]
        self.at = np.stack([sphere(f"a{c}").to_numpy(zero_copy_only=False) for c in "xyz"])[:, self.owner]
        # Neighbours as seen from their sphere.
        self.v = np.stack([entry(f"b{c}") for c in "xyz"]) - self.at
        self.d2 = (self.v * self.v).sum(axis=0)
        self.d = np.sqrt(self.d2)
        groups, mine = flat.field("bgrp"), sphere("agrp").take(pa.array(self.owner))
        same = groups.is_valid().to_numpy(False) & mine.is_valid().to_numpy(False) & (groups.fill_null(0).to_numpy() == mine.fill_null(0).to_numpy())
        cosine = np.divide(self.h, self.own_r, out=np.ones_like(self.h), where=self.own_r > 0)
        self.disc_r = self.own_r * np.sqrt(np.maximum(0.0, 1.0 - cosine * cosine))
        #: Entries whose contact is to be constructed: each pair once, but none within a group. Of a sphere's own images,
        #: n and 27 - n are opposite and give the same contact.
        own = self.own_id[self.owner]
        self.pairs = np.nonzero(((own < self.id) | (own == self.id) & (self.image <= 13)) & ~same & (self.disc_r > 0) & (self.d > 0))[0]

    def without_idle(self) -> Spheres:
        """The same without idle neighbours: those that cut nothing which another one does not cut away, by more than rounding.

        Where the disc in a neighbour's plane is beyond one other plane, it has no contact, and what the other plane leaves of the
        sphere lies on one side of it: on the near one, if the point does that lies furthest from the other plane.
        """
        keep = self._kept()
        out = copy(self)
        out.count = np.bincount(self.owner[keep], minlength=len(self.count))
        out.begin = np.cumsum(out.count) - out.count
        for name in ("owner", "id", "image", "h", "r", "own_r", "d2", "d", "disc_r"):
            setattr(out, name, getattr(self, name)[keep])
        out.at, out.v = self.at[:, keep], self.v[:, keep]
        out.pairs = (np.cumsum(keep) - 1)[self.pairs[keep[self.pairs]]]
        return out

    def _kept(self) -> np.ndarray:
        """Which entries are not idle for sure, by a look at the ``FIRST`` neighbours of each sphere, nearest plane first."""
        keep = np.ones(len(self.id), bool)
        within = (self.r + EPSILON > self.own_r) & (self.d2 < (self.r - self.own_r) ** 2 + EPSILON) | (self.d <= 0)
        #: Spheres that lie within no neighbour.
        self.ordinary = np.bincount(self.owner, within, len(self.count)) == 0
        at = np.nonzero(self.ordinary[self.owner] & (self.disc_r > LEAST_DISC))[0]
        unit = self.v / np.where(self.d > 0, self.d, 1.0)
        for k in range(FIRST):
            # Where there are fewer, the first one is looked at again.
            own = self.owner[at]
            first = (self.begin + np.where(self.count > k, k, 0))[own]
            cosine = sum(x[at] * x[first] for x in unit)
            sine = np.sqrt(np.maximum(1.0 - cosine * cosine, 0.0))
            h, slack = self.h[at], ROUGH * (1.0 + self.own_r[at])
            idle = (self.h[first] - cosine * h < -sine * self.disc_r[at] - slack) & (-cosine * self.own_r[at] < h - slack) & (first != at)
            keep[at[idle]] = False
            at = at[~idle]
        return keep


def _basis(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unit vectors at right angles to u (3 x n) and each other; the first is u crossed with the axis
    along which it is shortest."""
    x, y, z = u
    ax, ay, az = np.abs(u)
    on_x, zero = (ax <= ay) & (ax <= az), np.zeros_like(x)
    on_y = ~on_x & (ay <= az)
    e1 = np.where(on_x, (zero, z, -y), np.where(on_y, (-z, zero, x), (y, -x, zero)))
    e1 = e1 / np.sqrt((e1 * e1).sum(axis=0))
    return e1, np.cross(u, e1, axis=0)


class Lines:
    """The lines that cross the discs of some pairs: for each, the pair's number, the entry of the neighbour,
    and {p : p.n = dist} in the basis of the pair's plane, of which the disc keeps the side p.n < dist. They
    are in the order of pairs and of neighbours, nearest plane first, which decides between equal lines."""

    def __init__(self, pair, entry, dist, n1, n2):
        self.pair, self.entry, self.dist, self.n1, self.n2 = pair, entry, dist, n1, n2
        self.spans = None

    def where(self, keep: np.ndarray) -> Lines:
        keep = np.flatnonzero(keep)
        return Lines(*(x.take(keep) for x in (self.pair, self.entry, self.dist, self.n1, self.n2)))

    def rank(self, n_pairs: int) -> tuple[np.ndarray, np.ndarray]:
        """How many lines each pair has, and the place of each line among those of its pair."""
        count = np.bincount(self.pair, minlength=n_pairs)
        return count, np.arange(len(self.pair)) - (np.cumsum(count) - count)[self.pair]

    def padded(self, rows: np.ndarray, n_pairs: int, width: int):
        """(entry, dist, n1, n2, valid), each with a row for each of the pairs ``rows`` and width columns."""
        if self.spans is None:
            count = np.bincount(self.pair, minlength=n_pairs)
            self.spans = np.cumsum(count) - count, count
        begin, count = (x[rows][:, None] for x in self.spans)
        place = np.arange(width)
        valid = place < count
        if not len(self.pair):
            return np.full(valid.shape, -1), *[np.zeros(valid.shape)] * 3, valid
        at = np.minimum(begin + place, len(self.pair) - 1)
        return (*(np.where(valid, x[at], empty) for x, empty in ((self.entry, -1), (self.dist, 0.0), (self.n1, 0.0), (self.n2, 0.0))), valid)

    def nearest(self, rows: np.ndarray, n_pairs: int):
        """(dist, n1, n2, valid) of the ``NEAREST`` lines nearest to the centre, for each of the pairs ``rows``."""
        count, _ = self.rank(n_pairs)
        begin, count = (np.cumsum(count) - count)[rows], count[rows]
        at, valid = np.zeros((len(rows), NEAREST), np.int64), np.zeros((len(rows), NEAREST), bool)
        low = -1
        for width in (NEAREST, 12, 18, 24, 36, max(37, int(count.max(initial=0)))):
            here = np.nonzero((count > low) & (count <= width))[0]
            low = width
            if not len(here) or not len(self.dist):
                continue
            there = np.arange(width) < count[here][:, None]
            lines = np.minimum(begin[here][:, None] + np.arange(width), len(self.dist) - 1)
            if width > NEAREST:
                first = np.argpartition(np.where(there, self.dist[lines], np.inf), NEAREST - 1, axis=1)[:, :NEAREST]
                lines, there = (np.take_along_axis(x, first, axis=1) for x in (lines, there))
            at[here], valid[here] = lines, there
        return (*(np.where(valid, x[at] if len(x) else 0.0, 0.0) for x in (self.dist, self.n1, self.n2)), valid)


@dataclass
class Rough:
    """A rough look at the discs of some pairs, by the cosines between the directions of neighbours. It names the neighbours that
    are worth an exact look; only distances of planes that are far from parallel count as they are."""

    #: Pairs that one neighbour seems to cut away as a whole, and its entry; those that it does for sure are left out.
    gone: np.ndarray
    by: np.ndarray
    #: Pairs that are left, with the distance of each neighbour's line, infinite where there is none, and the sine of its angle.
    left: np.ndarray
    dist: np.ndarray
    sine: np.ndarray | None
    #: Pairs that take an exact look at all neighbours.
    other: np.ndarray


def rough_look(s: Spheres) -> Rough:
    """The rough look at s.pairs, without sines."""
    looks = list(rough_blocks(s))
    most = max(x.dist.shape[1] for x in looks)
    dist = [np.pad(x.dist, ((0, 0), (0, most - x.dist.shape[1])), constant_values=np.inf) for x in looks]
    gone, by, left, other = (np.concatenate([getattr(x, n) for x in looks]) for n in ("gone", "by", "left", "other"))
    return Rough(gone, by, left, np.concatenate(dist), None, other)


def rough_blocks(s: Spheres, sines: bool = False) -> Iterator[Rough]:
    """The rough look at s.pairs in blocks; with sines, also those. Pairs of spheres that lie within another one take the exact
    look."""
    first, many = np.unique(s.owner[s.pairs], return_index=True, return_counts=True)[1:] if len(s.pairs) else (s.pairs, s.pairs)
    own = s.owner[s.pairs[first]]
    ordinary = s.count[own] <= MOST
    within = (s.r + EPSILON > s.own_r) & (s.d2 < (s.r - s.own_r) ** 2 + EPSILON) | (s.d <= 0)
    ordinary[np.isin(own, s.owner[within])] = False
    none = s.pairs[:0]
    yield Rough(none, none, none, np.zeros((0, 1)), None, s.pairs[~np.repeat(ordinary, many)])
    first, many, own = first[ordinary], many[ordinary], own[ordinary]
    # Spheres with about as many neighbours and pairs go together, so that little is padding.
    order = np.lexsort((many, s.count[own] // BIN))
    first, many, own = first[order], many[order], own[order]
    upto = np.searchsorted(s.count[own] // BIN, s.count[own] // BIN, "right")
    # The last row stands for a neighbour that is not there.
    missing = len(s.id)
    unit = np.ascontiguousarray(np.append(s.v / np.where(s.d > 0, s.d, 1.0), np.zeros((3, 1)), axis=1).T)
    h, r = np.append(s.h, np.inf), np.append(s.r, 0.0)
    power = s.d2 - s.r * s.r
    ones = np.ones_like(power)
    # The product of two of these is how far two spheres are from one being within the other, as a square.
    mine = np.stack((*(-2.0 * s.v), ones, power, 2.0 * s.r), axis=1)
    theirs = np.concatenate((np.stack((*s.v, power, ones, s.r), axis=1), [[0.0, 0.0, 0.0, FAR, 0.0, 0.0]]))
    i = 0
    while i < len(own):
        some = many[i : upto[i]]
        room = 2 * LOOK // (int(s.count[own[i]]) // BIN * BIN + BIN)
        j = i + max(1, int(np.searchsorted(np.arange(1, len(some) + 1) * some, room, "right")))
        here, n = own[i:j], many[i:j]
        width = int(s.count[here].max())
        begin = s.begin[here][:, None]
        place = np.arange(width)
        entry = np.where(place < s.count[here][:, None], begin + place, missing)
        column = np.arange(int(n[-1]))
        pair = s.pairs[first[i:j][:, None] + np.minimum(column, n[:, None] - 1)]
        cosine = unit.take(pair, axis=0) @ unit.take(entry, axis=0).transpose(0, 2, 1)
        apart = mine.take(pair, axis=0) @ theirs.take(entry, axis=0).transpose(0, 2, 1)
        # A sphere is no neighbour of its own disc.
        row = np.arange(pair.size) * width
        itself = row + (pair - begin).ravel()
        apart.reshape(-1)[itself] = np.inf
        cosine.reshape(-1)[itself] = 0.0
        sine = np.multiply(cosine, cosine)
        np.subtract(1.0, sine, out=sine)
        dist = np.multiply(cosine, s.h[pair][:, :, None], out=cosine)
        np.subtract(h[entry][:, None, :], dist, out=dist)
        # Of nearly parallel planes the distance is too small, but has its sign: no line is missed.
        np.sqrt(np.maximum(sine, ROUGH, out=sine), out=sine)
        np.divide(dist, sine, out=dist)
        dist.reshape(-1)[itself] = np.inf
        nearest, closest = dist.argmin(axis=2).ravel(), apart.argmin(axis=2).ravel()
        dist, sine, apart = (x.reshape(-1, width) for x in (dist, sine, apart))
        low, disc_r = dist.reshape(-1)[row + nearest], s.disc_r[pair].ravel()
        cut = low <= -disc_r
        # Such a disc lies in the neighbour too, so that overlaps the disc and both spheres.
        sure = (low < -disc_r - ROUGH * (1.0 + disc_r)) & (sine.reshape(-1)[row + nearest] > PLAIN) & (disc_r > LEAST_DISC)
        tight = ROUGH * (1.0 + s.d2[pair].ravel())
        odd = np.nonzero(apart.reshape(-1)[row + closest] < tight)[0]
        if len(odd):
            # One within its neighbour is cut away by that; one that holds it is not cut by it.
            swallows = (apart[odd] < tight[odd][:, None]) & (r[entry[odd // len(column)]] + ROUGH > s.r[pair.ravel()[odd]][:, None])
            any_ = swallows.any(axis=1)
            nearest[odd[any_]], cut[odd[any_]], sure[odd[any_]] = swallows[any_].argmax(axis=1), True, False
        real = (column < n[:, None]).ravel()
        dead, alive = np.nonzero(real & cut & ~sure)[0], np.nonzero(real & ~cut)[0]
        pair = pair.ravel()
        gone = pair[dead]
        yield Rough(gone, s.begin[s.owner[gone]] + nearest[dead], pair[alive], dist[alive], sine[alive] if sines else None, none)
        i = j


def _spared(s: Spheres, rough: Rough) -> np.ndarray:
    """The pairs for an exact look at all neighbours: the other ones, and those that are not cut away after all."""
    alive, _ = _cuts(s, rough.gone, np.arange(len(rough.gone)), rough.by)
    return np.concatenate((rough.other, rough.gone[alive]))


def find_lines(s: Spheres, pairs: np.ndarray) -> tuple[np.ndarray, Lines]:
    """Which of the pairs' discs are not cut away as a whole, and the lines of those.

    One neighbour is enough to cut a disc away, so a look at the ``FIRST`` ones spares many pairs the others.
    """
    rows = np.arange(len(pairs))
    alive = np.zeros(len(pairs), bool)
    for i in range(0, len(rows), LOOK // FIRST):
        some = rows[i : i + LOOK // FIRST]
        alive[some] = _crossing(s, pairs[some], FIRST)[0]
    rows = np.nonzero(alive)[0]
    step = max(1, LOOK // max(1, int(s.count.max(initial=1))))
    found = [Lines(rows[:0], rows[:0], *[np.zeros(0)] * 3)]
    for i in range(0, len(rows), step):
        some = rows[i : i + step]
        alive[some], lines = _crossing(s, pairs[some])
        lines.pair = some[lines.pair]
        found.append(lines)
    return alive, Lines(*(np.concatenate([getattr(x, n) for x in found]) for n in ("pair", "entry", "dist", "n1", "n2")))


def _joined(found: list[Lines]) -> Lines:
    if not found:
        return Lines(*[np.zeros(0, np.int64)] * 2, *[np.zeros(0)] * 3)
    return Lines(*(np.concatenate([getattr(x, n) for x in found]) for n in ("pair", "entry", "dist", "n1", "n2")))


def plain_lines(s: Spheres, look: Rough):
    """Of the pairs that a rough look left, with sines: (number of pair, entry, dist) of the lines of those whose lines it tells
    for sure, as find_lines() has them; and the other pairs.

    A line that is sure to cross a disc lies, where it does, in both spheres and the neighbour, so those overlap.
    """
    pairs, dist = look.left, look.dist
    disc_r = s.disc_r[pairs]
    slack = ROUGH * (1.0 + disc_r)
    here = dist <= (disc_r + slack)[:, None]
    at, count = np.flatnonzero(here), np.count_nonzero(here, axis=1)
    pair = np.repeat(np.arange(len(pairs)), count)
    dist, sine = dist.reshape(-1)[at], look.sine.reshape(-1)[at]
    doubtful = (sine < PLAIN) | (np.abs(dist) > np.repeat(disc_r - slack, count))
    sure = disc_r > LEAST_DISC
    sure[pair[doubtful]] = False
    entry = at + np.repeat(s.begin[s.owner[pairs]] - np.arange(len(pairs)) * look.dist.shape[1], count)
    if not sure.all():
        keep = np.repeat(sure, count)
        pair, entry, dist = pair[keep], entry[keep], dist[keep]
    return pair, entry, dist, pairs[~sure]


def relevant_lines(s: Spheres, rough: Rough) -> tuple[np.ndarray, Lines]:
    """The pairs that a rough look left of which something is left, and only those lines that can matter, as _relevant()
    tells from left_lines(): only these and the nearest ones have an exact look."""
    pairs = rough.left
    alive = np.zeros(len(pairs), bool)
    width = min(NEAREST, rough.dist.shape[1])
    step = max(1, 4 * LOOK // max(1, rough.dist.shape[1]))
    found = []
    for i in range(0, len(pairs), step):
        some, dist = pairs[i : i + step], rough.dist[i : i + step]
        begin, disc_r = s.begin[s.owner[some]], s.disc_r[some]
        slack = ROUGH * (1.0 + disc_r)
        place = np.argpartition(dist, width - 1, axis=1)[:, :width]
        pair, column = np.nonzero(np.take_along_axis(dist, place, axis=1) <= (disc_r + slack)[:, None])
        here, lines = _cuts(s, some, pair, begin[pair] + place[pair, column])
        rows = np.nonzero(here)[0]
        _, *nearest = lines.padded(rows, len(some), width)
        region = Region(rows, *nearest, disc_r)
        rows, reach = rows[region.any], region.reach[region.any]
        pair, place = np.nonzero(dist[rows] <= (reach + slack[rows])[:, None])
        pair = rows[pair]
        here = np.zeros(len(some), bool)
        here[rows] = True
        still, lines = _cuts(s, some, pair, begin[pair] + place)
        here &= still
        alive[i : i + step] = here
        lines = lines.where(here[lines.pair])
        lines = lines.where(region.touched(lines))
        lines.pair += i
        found.append(lines)
    return alive, _joined(found)


def cutting_lines(s: Spheres, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, Lines]:
    """Of pairs of ordinary spheres: those whose discs no one or two neighbours cut away by more than rounding, whether something may be
    left of each, and the lines of these but idle ones. A look with half as many digits chooses lines, exact ones are made of those."""
    pairs = pairs[np.argsort(s.count[s.owner[pairs]], kind="stable")]
    many = s.count[s.owner[pairs]]
    unit = (s.v / np.where(s.d > 0, s.d, 1.0)).astype(np.float32)
    h = s.h.astype(np.float32)
    found, before = [(pairs[:0],) * 3], 0
    i = 0
    while i < len(pairs):
        j = i + max(1, LINES // int(many[i]))
        here, pair, entry = _chosen(s, unit, h, pairs[i:j], many[i:j])
        i = j
        found.append((here, pair + before, entry))
        before += len(here)
    kept, pair, entry = map(np.concatenate, zip(*found))
    return kept, *_cuts(s, kept, pair, entry)


def _chosen(s: Spheres, unit: np.ndarray, h: np.ndarray, pairs: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some pairs, in the order of how many neighbours their spheres have: those that may have a contact, and by number of pair and
    entry the neighbours whose lines may matter to these."""
    own, width, least = s.owner[pairs], int(many[-1]), int(many[0])
    u = s.v[:, pairs] / s.d[pairs]
    e1, e2 = (e.astype(np.float32) for e in _basis(u))
    u = u.astype(np.float32)
    disc_r, slack = s.disc_r[pairs].astype(np.float32), (COARSE * s.own_r[pairs]).astype(np.float32)
    # A row for each place among the neighbours, so that numpy's inner loops go over pairs.
    entry = s.begin[own] + np.arange(width)[:, None]
    np.minimum(entry, len(s.id) - 1, out=entry)
    x, y, z = (c.take(entry) for c in unit)

    def dot(e):
        out = x * e[0]
        out += y * e[1]
        out += z * e[2]
        return out

    dist, n1, n2 = dot(u), dot(e1), dot(e2)
    dist *= h.take(pairs)
    np.subtract(h.take(entry), dist, out=dist)
    sine = n1 * n1
    sine += n2 * n2
    np.sqrt(sine, out=sine)
    # Planes that are nearly parallel leave the whole disc, or none of it, or have an exact look.
    flat = sine < FLAT
    flats = flat.any()
    if flats:
        near = flat & (np.abs(dist) <= disc_r * sine + slack)
        dist[flat] = np.copysign(np.float32(np.inf), dist[flat])
        sine[flat] = 1.0
    dist /= sine
    n1 /= sine
    n2 /= sine
    itself = pairs - s.begin[own], np.arange(len(pairs))
    if flats:
        near[itself] = False
        near[least:] &= np.arange(least, width)[:, None] < many
        dist[near] = np.inf
    dist[itself] = np.inf
    dist[least:][np.arange(least, width)[:, None] >= many] = np.inf
    left = np.flatnonzero(dist.min(axis=0) >= -disc_r - slack)
    pairs, disc_r, slack = pairs[left], disc_r[left], slack[left]
    dist, n1, n2, entry = (v.take(left, axis=1) for v in (dist, n1, n2, entry))
    near = near.take(left, axis=1) if flats else None
    outside = dist >= disc_r + slack
    # As long as they may be.
    half = np.sqrt(np.maximum(disc_r * disc_r + 4.0 * slack * (disc_r + slack) - dist * dist, 0.0))
    idle, cost = outside, dist.copy()
    with np.errstate(invalid="ignore"):
        for _ in range(min(max(width // PER_ROUND, 3), 12)):
            column = np.arange(dist.shape[1])
            at = cost.argmin(axis=0)
            by, by1, by2 = (v[at, column] for v in (dist, n1, n2))
            facing = n1 * by1
            facing += n2 * by2
            apart = n1 * by2
            apart -= n2 * by1
            np.abs(apart, out=apart)
            apart *= half
            # Lines that pass through the disc only where the nearest one cuts it away, for sure.
            beyond = dist * facing - apart > by + slack
            beyond &= ~outside
            beyond[at, column] = False
            # Whether they leave the point of the circle that the nearest one leaves as far as it can: so they cut nothing of what it
            # leaves, or all.
            facing *= disc_r
            facing += dist
            idle = idle | beyond & (facing > slack)
            cost[at, column] = np.inf
            cost[idle] = np.inf
            cut = (beyond & (facing < -slack)).any(axis=0)
            if cut.any():
                here = np.flatnonzero(~cut)
                pairs, disc_r, slack = pairs[here], disc_r[here], slack[here]
                dist, n1, n2, entry, cost, half, idle, outside = (v.take(here, axis=1) for v in (dist, n1, n2, entry, cost, half, idle, outside))
                near = near.take(here, axis=1) if flats else None
    chosen = ~idle | near if flats else ~idle
    pair, at = np.nonzero(np.ascontiguousarray(chosen.T))
    return pairs, pair, entry.take(at * len(pairs) + pair)


def _crossing(s: Spheres, pairs: np.ndarray, most: int | None = None) -> tuple[np.ndarray, Lines]:
    """find_lines() with the first ``most`` neighbours of each sphere alone, or with all."""
    own, d, h, disc_r, b_r, a_r = s.owner[pairs], s.d[pairs], s.h[pairs], s.disc_r[pairs], s.r[pairs], s.own_r[pairs]
    u = s.v[:, pairs] / d
    e1, e2 = _basis(u)
    width = int(s.count[own].max())
    width = width if most is None else min(width, most)
    # A row for each place among the neighbours, so that numpy's inner loops go over pairs.
    place = np.arange(width)[:, None]
    entry = s.begin[own] + place
    there = (place < s.count[own]) & (entry != pairs)
    entry = np.minimum(entry, len(s.id) - 1)
    along = sum(s.v[i][entry] * u[i] for i in range(3))
    d2, r = s.d2[entry], s.r[entry]
    to_b = d2 - 2.0 * d * along + d * d
    to_disc = d2 - 2.0 * h * along + h * h
    there &= (to_b + EPSILON < (r + b_r) ** 2) & (to_disc + EPSILON < (r + disc_r) ** 2)
    pair, column = np.nonzero(np.ascontiguousarray(there.T))
    entry, k, to_b = entry[column, pair], along[column, pair], to_b[column, pair]
    r, n = s.r[entry], s.d[entry]
    v = s.v[:, entry]
    v1, v2 = (v * e1[:, pair]).sum(axis=0), (v * e2[:, pair]).sum(axis=0)
    contains = lambda d2, inner: (r + EPSILON > inner) & (d2 < (r - inner) ** 2 + EPSILON)
    swallowed = contains(to_b, b_r[pair]) | contains(s.d2[entry], a_r[pair])
    beyond = h[pair] * k / n - s.h[entry]
    w = np.sqrt(v1 * v1 + v2 * v2)
    crosses = w >= n * 1e-12
    safe = np.where(crosses, w, 1.0)
    dist = -beyond * n / safe
    outside = np.where(crosses, dist <= -disc_r[pair], beyond > EPSILON)
    alive = np.bincount(pair, swallowed | outside, len(pairs)) == 0
    keep = crosses & (dist < disc_r[pair]) & alive[pair]
    return alive, Lines(pair, entry, dist, v1 / safe, v2 / safe).where(keep)


def _cuts(s: Spheres, pairs: np.ndarray, pair: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, Lines]:
    """Of candidates (the number of one of pairs, and the entry of a neighbour): which pairs' discs none cuts away as a whole,
    and the lines in those. Candidates are in the order of pairs and of neighbours."""
    own, d, h, disc_r, b_r, a_r = s.owner[pairs], s.d[pairs], s.h[pairs], s.disc_r[pairs], s.r[pairs], s.own_r[pairs]
    u = s.v[:, pairs] / d
    e1, e2 = _basis(u)
    v = [x[entry] for x in s.v]
    k = sum(v[i] * u[i][pair] for i in range(3))
    d2, r, h, d, disc_r, b_r = s.d2[entry], s.r[entry], h[pair], d[pair], disc_r[pair], b_r[pair]
    to_b = d2 - 2.0 * d * k + d * d
    to_disc = d2 - 2.0 * h * k + h * h
    there = (to_b + EPSILON < (r + b_r) ** 2) & (to_disc + EPSILON < (r + disc_r) ** 2)
    if not there.all():
        pair, entry, k, d2, r, h, disc_r, b_r, to_b = (x[there] for x in (pair, entry, k, d2, r, h, disc_r, b_r, to_b))
        v = [x[there] for x in v]
    n = s.d[entry]
    v1, v2 = (sum(x * y[pair] for x, y in zip(v, e)) for e in (e1, e2))
    contains = lambda d2, inner: (r + EPSILON > inner) & (d2 < (r - inner) ** 2 + EPSILON)
    swallowed = contains(to_b, b_r) | contains(d2, a_r[pair])
    beyond = h * k / n - s.h[entry]
    w = np.sqrt(v1 * v1 + v2 * v2)
    crosses = w >= n * 1e-12
    safe = np.where(crosses, w, 1.0)
    dist = -beyond * n / safe
    outside = np.where(crosses, dist <= -disc_r, beyond > EPSILON)
    alive = np.bincount(pair, swallowed | outside, len(pairs)) == 0
    keep = crosses & (dist < disc_r) & alive[pair]
    return alive, Lines(pair, entry, dist, v1 / safe, v2 / safe).where(keep)


def pieces(dist, n1, n2, valid, disc_r, names=True):
    """What remains of each line: from lo to hi along n turned left, which column ends it at either end (-1:
    the circle; only with names), and whether anything does. Of equal lines the first one stays."""
    # A row for each line, so that numpy's inner loops go over discs.
    dist, n1, n2, valid = (np.ascontiguousarray(x.T) for x in (dist, n1, n2, valid))
    half = np.sqrt(np.maximum(disc_r**2 - dist * dist, 0.0))
    lo, hi = -half, half.copy()
    if not names:
        _clip(dist, n1, n2, valid, lo, hi)
        return *(np.ascontiguousarray(x.T) for x in (lo, hi)), None, None, np.ascontiguousarray((valid & (hi - lo > SLIVER)).T)
    lo_by, hi_by = np.full(dist.shape, -1, np.int32), np.full(dist.shape, -1, np.int32)
    kappa, gamma, by = np.empty_like(dist), np.empty_like(dist), np.empty_like(dist)
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(len(dist)):
            np.multiply(n1, n2[j], out=kappa)
            np.subtract(kappa, np.multiply(n2, n1[j], out=by), out=kappa)
            np.multiply(n1, n1[j], out=gamma)
            along = np.add(gamma, np.multiply(n2, n2[j], out=by), out=gamma)
            flat = np.abs(kappa, out=by) < PARALLEL
            flat[j] = False
            if flat.any():
                flat &= valid[j]
                at, of = np.nonzero(flat)
                beyond = dist[j, of] - along[at, of] * dist[at, of]
                gone = (beyond < -PARALLEL) | (beyond <= PARALLEL) & (along[at, of] > 0) & (j < at)
                hi[at[gone], of[gone]] = -np.inf
            np.subtract(dist[j], np.multiply(along, dist, out=gamma), out=gamma)
            left = kappa < 0
            t = np.divide(gamma, kappa, out=gamma)
            # Neither a line itself nor one that is not there or runs along cuts it.
            t[j] = np.nan
            t[:, ~valid[j]] = np.nan
            t[flat] = np.nan
            up = left & (t > np.add(lo, EPSILON, out=by))
            down = ~left & (t < np.subtract(hi, EPSILON, out=by))
            np.copyto(lo, t, where=up)
            np.copyto(hi, t, where=down)
            if names:
                np.copyto(lo_by, j, where=up)
                np.copyto(hi_by, j, where=down)
    return tuple(np.ascontiguousarray(x.T) for x in (lo, hi, lo_by, hi_by, valid & (hi - lo > SLIVER)))


def _clip(dist, n1, n2, valid, lo, hi):
    """pieces() without names, a row for each line: lo and hi are cut in place."""
    # A line that is not there cuts at no number, which fmax and fmin pass over. There is no masked copy here: those are slow.
    nothing = np.where(valid, 0.0, np.nan)
    kappa, t, by = np.empty_like(dist), np.empty_like(dist), np.empty_like(dist)
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(len(dist)):
            np.multiply(n1, n2[j], out=kappa)
            np.subtract(kappa, np.multiply(n2, n1[j], out=by), out=kappa)
            np.multiply(n1, n1[j], out=t)
            along = np.add(t, np.multiply(n2, n2[j], out=by), out=t)
            np.abs(kappa, out=by)
            by[j] = 1.0
            flat = None
            if by.min() < PARALLEL:
                flat = by < PARALLEL
                parallel = flat & valid[j]
                at, of = np.nonzero(parallel)
                beyond = dist[j, of] - along[at, of] * dist[at, of]
                gone = (beyond < -PARALLEL) | (beyond <= PARALLEL) & (along[at, of] > 0) & (j < at)
                hi[at[gone], of[gone]] = -np.inf
            np.multiply(along, dist, out=by)
            np.subtract(dist[j] + nothing[j], by, out=by)
            np.divide(by, kappa, out=t)
            t[j] = np.nan
            if flat is not None:
                t[flat] = np.nan
            # Infinite where the other line does not cut this end.
            np.divide(-np.inf, kappa, out=kappa)
            np.fmax(lo, np.minimum(t, kappa, out=by), out=lo)
            np.fmin(hi, np.maximum(t, kappa, out=by), out=hi)


def arcs(dist, n1, n2, valid, disc_r):
    """The uncovered arcs of the circle (start, length, whether it is one); all of it without lines."""
    n, width = dist.shape
    start, length = np.zeros((n, width + 1)), np.zeros((n, width + 1))
    none = ~valid.any(axis=1)
    length[none, 0] = TAU
    if not width or none.all():
        return start, length, length > SLIVER
    half = np.arccos(np.clip(np.where(valid, dist, 0.0) / disc_r[:, None], -1.0, 1.0))
    at = np.where(valid, np.mod(np.arctan2(n2, n1) - half, TAU), np.inf)
    order = np.argsort(at, axis=1)
    at, wide, valid = (np.take_along_axis(x, order, axis=1) for x in (at, 2.0 * half, valid))
    first = np.where(none, 0.0, at[:, 0])
    at = np.where(valid, at - first[:, None], 0.0)
    # Angles count from the start of the first span; the furthest end may reach around into the beginning.
    around = np.where(valid, at + wide, 0.0).max(axis=1) - TAU
    end = np.maximum(wide[:, 0], around)
    for j in range(1, width):
        start[:, j] = first + end
        length[:, j] = np.where(valid[:, j], at[:, j] - end, 0.0)
        end = np.where(valid[:, j], np.maximum(end, at[:, j] + wide[:, j]), end)
    start[:, width], length[:, width] = first + end, TAU - end
    start[none], length[none, 1:] = 0.0, 0.0
    return start, length, length > SLIVER


class Region:
    """What some lines of the alive discs, ``rows``, leave of those: a convex region within pieces of lines and arcs. It holds
    all of the contact, so a line that passes outside of it cuts nothing."""

    def __init__(self, rows: np.ndarray, dist, n1, n2, valid, disc_r: np.ndarray):
        self.disc_r = disc_r[rows]
        lo, hi, _, _, left = pieces(dist, n1, n2, valid, self.disc_r, names=False)
        start, length, open_ = arcs(dist, n1, n2, valid, self.disc_r)
        self.any, arched = open_.any(axis=1) | left.any(axis=1), open_.any(axis=1)
        corner = np.where(left, dist * dist + np.maximum(lo * lo, np.where(left, hi * hi, 0.0)), 0.0).max(axis=1, initial=0.0)
        #: How far the region reaches from the centre.
        self.reach = np.where(arched, self.disc_r, np.sqrt(corner) + SLIVER)
        self.place = np.full(len(disc_r), -1)
        self.place[rows] = np.arange(len(rows))
        lo, hi, length = np.where(left, lo, 0.0), np.where(left, hi, 0.0), np.where(open_, length, 0.0)
        ends = [f(start + x) * self.disc_r[:, None] for f in (np.cos, np.sin) for x in (0.0, length)]
        real = np.concatenate((left, left, open_, open_), axis=1)
        first = real.argmax(axis=1)[:, None]
        same = lambda *x: (lambda p: np.where(real, p, np.take_along_axis(p, first, axis=1)))(np.concatenate(x, axis=1))
        #: Its corners; one stands for those that are not there.
        self.p1 = same(dist * n1 - lo * n2, dist * n1 - hi * n2, ends[0], ends[1])
        self.p2 = same(dist * n2 + lo * n1, dist * n2 + hi * n1, ends[2], ends[3])
        #: The middles of its arcs, and the cosines of half of their angles.
        self.m1, self.m2, self.cosine = np.cos(start + length / 2), np.sin(start + length / 2), np.where(open_, np.cos(length / 2), 2.0)

    def touched(self, lines: Lines) -> np.ndarray:
        """Which lines reach the region; all are of its discs."""
        keep = np.zeros(len(lines.pair), bool)
        step = max(1, LOOK // self.p1.shape[1])
        for i in range(0, len(keep), step):
            some = slice(i, i + step)
            at, n1, n2, dist = self.place[lines.pair[some]], lines.n1[some, None], lines.n2[some, None], lines.dist[some]
            furthest = (self.p1[at] * n1 + self.p2[at] * n2).max(axis=1)
            keep[some] = (dist <= furthest + SLIVER) | (self.m1[at] * n1 + self.m2[at] * n2 >= self.cosine[at] - SLIVER).any(axis=1)
        return keep


def _relevant(lines: Lines, alive: np.ndarray, disc_r: np.ndarray) -> tuple[np.ndarray, Lines]:
    """The discs of which something is left, and only those lines that can matter: that reach what the ``NEAREST`` lines
    nearest to the centre leave."""
    rows = np.nonzero(alive)[0]
    region = Region(rows, *lines.nearest(rows, len(alive)), disc_r)
    alive = np.zeros(len(alive), bool)
    alive[rows[region.any]] = True
    lines = lines.where(alive[lines.pair])
    return alive, lines.where(region.touched(lines))


def _wedge(dist, lo, hi, far):
    """The solid angle of the triangle between a centre's foot and a piece of a line, seen from far off the plane."""
    p, q = np.sqrt(dist * dist + lo * lo + far * far), np.sqrt(dist * dist + hi * hi + far * far)
    return 2.0 * np.arctan2(dist * (hi - lo), p * q + far * (p + q) + dist * dist + lo * hi + far * far)


def _bounded(s: Spheres, pairs: np.ndarray, lines: Lines, rows: np.ndarray, width: int, detail: bool) -> dict:
    """Measures and boundaries of the contacts ``rows`` of pairs, of which none has more than width lines."""
    entry, dist, n1, n2, valid = lines.padded(rows, len(pairs), width)
    here = pairs[rows]
    disc_r, h, d, a_r, b_r = s.disc_r[here], s.h[here], s.d[here], s.own_r[here], s.r[here]
    lo, hi, lo_by, hi_by, left = pieces(dist, n1, n2, valid, disc_r, detail)
    start, length, open_ = arcs(dist, n1, n2, valid, disc_r)
    lo, hi = np.where(left, lo, 0.0), np.where(left, hi, 0.0)
    arc_sum = np.where(open_, length, 0.0).sum(axis=1)
    area = 0.5 * (disc_r * disc_r * arc_sum + (dist * (hi - lo)).sum(axis=1))
    out = {"here": here, "area": area, "arc_length": disc_r * arc_sum, "central": (~left | (dist >= 0)).all(axis=1)}
    for end, offset, radius in (("a", h, a_r), ("b", d - h, b_r)):
        far, sign = np.abs(offset), np.where(offset < 0, -1.0, 1.0)
        solid = arc_sum * (1.0 - far / radius) + np.where(left, _wedge(dist, lo, hi, far[:, None]), 0.0).sum(axis=1)
        out |= {f"solid_angle_{end}": sign * solid, f"pyramid_volume_{end}": sign * far * area / 3.0}
    keep = (area > LEAST_AREA) & (left.any(axis=1) | open_.any(axis=1))
    by = lambda x: np.where(x >= 0, np.take_along_axis(entry, np.maximum(x, 0), axis=1), -1)
    out |= {"left": left, "entry": entry, "dist": dist, "n1": n1, "n2": n2, "lo": lo, "hi": hi, "lo_by": by(lo_by), "hi_by": by(hi_by)} if detail and width else {}
    return {k: v[keep] for k, v in (out | {"open": open_, "start": start, "length": length}).items()}


PIECE = [("c", pa.int64()), *[(n, pa.float64()) for n in ("dist", "n1", "n2", "lo", "hi")], ("lo_c", pa.int64()), ("hi_c", pa.int64())]
ARC = [("start", pa.float64()), ("length", pa.float64())]


def _lists(counts: np.ndarray, fields: list, columns: list) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    arrays = [pa.array(x, t, mask=m) for (x, m), (_, t) in zip(columns, fields)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(arrays, names=[n for n, _ in fields]))


def _piece_lists(s: Spheres, part: dict) -> pa.ListArray:
    left = part.get("left")
    if left is None:
        return _lists(np.zeros(len(part["here"]), int), PIECE, [(np.zeros(0), None)] * len(PIECE))
    name = lambda e: (s.id[np.maximum(e, 0)], e < 0)
    at = {k: part[k][left] for k in ("entry", "dist", "n1", "n2", "lo", "hi", "lo_by", "hi_by")}
    return _lists(left.sum(axis=1), PIECE, [name(at["entry"]), *[(at[k], None) for k in ("dist", "n1", "n2", "lo", "hi")], name(at["lo_by"]), name(at["hi_by"])])


MEASURES = ("area", "arc_length", "central", "solid_angle_a", "solid_angle_b", "pyramid_volume_a", "pyramid_volume_b")


def _contacts(s: Spheres, pairs: np.ndarray, alive: np.ndarray, lines: Lines, detail: bool):
    count, _ = lines.rank(len(pairs))
    low = -1
    # Discs with few lines go apart from those with many, so that little is padding.
    for width in (0, 3, 4, 5, 6, 7, 8, 10, 12, 14, 17, 20, 24, 32, 40, 52, max(53, int(count.max(initial=0)))):
        found = np.nonzero(alive & (count > low) & (count <= width))[0]
        low = width
        step = max(1, PIECES // max(1, width))
        for rows in (found[i : i + step] for i in range(0, len(found), step)):
            part = _bounded(s, pairs, lines, rows, width, detail)
            here = part["here"]
            if not len(here):
                continue
            columns = {"b": s.id[here], "bimage": s.image[here], "h": s.h[here], "d": s.d[here], "ar": s.own_r[here], "br": s.r[here]}
            columns |= {m: part[m] for m in MEASURES}
            if detail:
                u = s.v[:, here] / s.d[here]
                e1, e2 = _basis(u)
                m = s.at[:, here] + u * s.h[here]
                for name, vector in (("u", u), ("m", m), ("e1", e1), ("e2", e2)):
                    columns |= {f"{name}{c}": x for c, x in zip("xyz", vector)}
                columns["disc_r"] = s.disc_r[here]
                columns["pieces"] = _piece_lists(s, part)
                open_ = part["open"]
                columns["arcs"] = _lists(open_.sum(axis=1), ARC, [(part[k][open_], None) for k in ("start", "length")])
            yield s.owner[here], columns


def contact_columns(s: Spheres, detail: bool):
    """Blocks of contacts: the rows of their spheres, and columns by name; with detail also their planes, pieces and arcs."""
    s = s.without_idle()
    ordinary = s.ordinary[s.owner[s.pairs]]
    yield from _contacts(s, *cutting_lines(s, s.pairs[ordinary]), detail)
    s.pairs = s.pairs[~ordinary]
    if not len(s.pairs):
        return
    rough = rough_look(s)
    yield from _contacts(s, rough.left, *relevant_lines(s, rough), detail)
    pairs = _spared(s, rough)
    step = max(1, BLOCK // max(1, int(s.count[s.owner[pairs]].max(initial=1))))
    for some in (pairs[i : i + step] for i in range(0, len(pairs), step)):
        alive, lines = find_lines(s, some)
        yield from _contacts(s, some, *_relevant(lines, alive, s.disc_r[some]), detail)


def first_columns(s: Spheres, merge_inner: bool):
    """contact_columns() with one contact of each pair among those with images, as first_of_pair() has them: all of a pair are in
    the row of one sphere."""
    found = list(contact_columns(s, False))
    if not found:
        return
    rows = np.concatenate([r for r, _ in found])
    columns = {n: np.concatenate([c[n] for _, c in found]) for n in found[0][1]}
    edge = columns["bimage"] != 0 if not merge_inner else np.zeros(len(rows), bool)
    order = np.lexsort((columns["bimage"], columns["h"], edge, columns["b"], rows))
    first = np.ones(len(rows), bool)
    first[1:] = False
    for x in (rows, columns["b"], edge):
        first[1:] |= x[order[1:]] != x[order[:-1]]
    keep = order[first]
    yield rows[keep], {n: x[keep] for n, x in columns.items()}


def line_columns(s: Spheres):
    """Blocks of the lines of all discs that are not cut away as a whole: b, bimage, c and dist."""
    gone, by, others = [], [], []
    for look in rough_blocks(s, sines=True):
        gone.append(look.gone)
        by.append(look.by)
        others.append(look.other)
        if not len(look.left):
            continue
        pair, entry, dist, unsure = plain_lines(s, look)
        others.append(unsure)
        yield _named_lines(s, look.left[pair], entry, dist)
    gone, by, others = map(np.concatenate, (gone, by, others))
    alive, _ = _cuts(s, gone, np.arange(len(gone)), by)
    others = np.concatenate((others, gone[alive]))
    step = max(1, BLOCK // max(1, int(s.count[s.owner[others]].max(initial=1))))
    for some in (others[i : i + step] for i in range(0, len(others), step)):
        _, lines = find_lines(s, some)
        yield _named_lines(s, some[lines.pair], lines.entry, lines.dist)


def _named_lines(s: Spheres, here: np.ndarray, entry: np.ndarray, dist: np.ndarray):
    return s.owner[here], {"b": s.id[here], "bimage": s.image[here], "c": s.id[entry], "dist": dist}
