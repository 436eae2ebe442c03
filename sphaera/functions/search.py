"""Neighbours of the spheres of whole places, in numpy.

A place is a structure, or a block of a large one with all that reaches into it, so a sphere's neighbours are found
without a pair ever leaving its task. Spheres are sorted by cell, of which one along x follows the other: the 27 cells
around a sphere are nine runs. All spheres of a batch of places go through each step together, in blocks of bounded size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from sphaera.functions.geometry import EPSILON

# Tasks get this module with their code and need not find it where they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns that tell a place.
PLACE = ["structure_id", "px", "py", "pz"]
#: Pairs of spheres that are looked at together.
CANDIDATES = 1 << 16
#: Of a place of up to so many spheres, all pairs are looked at, PRODUCTS of them together: that is less work than cells.
SMALL = 2048
PRODUCTS = 1 << 18
#: Rows of whole places that are looked at together, unless one place has more.
ROWS = 2048
#: Neighbours of spheres whose contacts are made together.
ENTRIES = 1 << 16
#: Just under the most that the C library learns to keep.
KEPT_BYTES = 24 << 20
#: Most cells along an axis; what is further out shares the last one.
CELLS = 1 << 16
#: Most places in a batch, so that the number of a cell fits.
PLACES = 1 << 12


def whole_places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole places, about ROWS rows each, from batches that are sorted by place."""
    kept: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        kept.append(pa.Table.from_batches([batch]))
        size += len(batch)
        if size < ROWS:
            continue
        table = pa.concat_tables(kept).combine_chunks()
        starts = np.nonzero(_new_place(table))[0]
        # The last place may go on in the next batch.
        begin = 0
        for at in starts[1:].tolist():
            if at - begin >= ROWS or at == starts[-1]:
                yield table.slice(begin, at - begin)
                begin = at
        kept, size = [table.slice(begin)], len(table) - begin
    if kept:
        table = pa.concat_tables(kept).combine_chunks()
        starts, begin = np.nonzero(_new_place(table))[0], 0
        for at in starts[1:].tolist():
            if at - begin >= ROWS:
                yield table.slice(begin, at - begin)
                begin = at
        yield table.slice(begin)


def _new_place(table: pa.Table) -> np.ndarray:
    """Whether a row is the first one of its place."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for name in PLACE:
        column = table.column(name)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(table) - 1)).to_numpy()
    return new


def _runs(place: np.ndarray, at: np.ndarray, reach: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the spheres by cell, and for each of mine the nine runs, begin and end, that can touch it."""
    n = int(place[-1]) + 1
    first = np.concatenate(([0], np.nonzero(np.diff(place))[0] + 1))
    widest = np.maximum.reduceat(reach, first)
    size = np.maximum(2.0 * widest, EPSILON) * (1.0 + 1e-9) + 1e-9
    cell = []
    for x in at:
        low = np.minimum.reduceat(x, first)
        steps = np.floor((x - low[place]) / size[place])
        cell.append(np.clip(np.nan_to_num(steps, nan=0.0), 0, CELLS).astype(np.int64) + 1)
    nx, ny, nz = (int(c.max(initial=0)) + 2 for c in cell)
    key = ((place * nz + cell[2]) * ny + cell[1]) * nx + cell[0]
    order = np.argsort(key, kind="stable")
    keys = key[order]
    moves = np.array([(dz * ny + dy) * nx for dz in (-1, 0, 1) for dy in (-1, 0, 1)])
    around = key[mine][:, None] + moves
    return order, np.searchsorted(keys, around - 1, "left"), np.searchsorted(keys, around + 1, "right")


def neighbourhoods(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each sphere of a table of whole places that is to be looked at and overlaps any: a batch of rows as NEAR has them.

    The table has the columns of PLACE, ball_id, x, y, z, r, grp, image, and mine, which tells the spheres to be looked at.
    """
    table = table.combine_chunks()
    new = _new_place(table)
    starts = np.nonzero(new)[0]
    if len(starts) > PLACES:
        cut = int(starts[PLACES])
        yield from neighbourhoods(table.slice(0, cut))
        yield from neighbourhoods(table.slice(cut))
        return
    column = lambda name: table.column(name).to_numpy()
    place = np.cumsum(new) - 1
    at, r, ball, image = np.stack([column(c) for c in "xyz"]), column("r"), column("ball_id"), column("image")
    mine = np.nonzero(column("mine"))[0]
    if not len(mine):
        return
    sizes = np.diff(np.append(starts[: PLACES + 1], len(table)))
    if sizes.max() <= SMALL and np.isfinite(at).all() and np.isfinite(r).all():
        yield from _batches((_overlapping(at, r, ball, image, a, b) for a, b in _small(at, r, starts, sizes, mine)), table, at, r, ball, image)
        return
    order, begin, end = _runs(place, at, np.maximum(r, 0.0), mine)
    upto = np.cumsum((end - begin).sum(axis=1))

    def found():
        i = 0
        while i < len(mine):
            # At least one sphere, and as many as have CANDIDATES pairs together.
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CANDIDATES, "right")))
            yield _found(at, r, ball, image, mine[i:j], order, begin[i:j], end[i:j])
            i = j

    yield from _batches(found(), table, at, r, ball, image)


def _batches(found, table, at, r, ball, image) -> Iterator[pa.RecordBatch]:
    """The rows of what was found, about ENTRIES pairs together."""
    kept, size = [], 0
    for some in found:
        if some is None:
            continue
        if kept and size + len(some[0]) > ENTRIES:
            yield _rows(table, at, r, ball, image, *map(np.concatenate, zip(*kept)))
            kept, size = [], 0
        kept.append(some)
        size += len(some[0])
    if kept:
        yield _rows(table, at, r, ball, image, *map(np.concatenate, zip(*kept)))


def _small(at, r, starts, sizes, mine) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (a of mine, b) of small places that may overlap, by the product of two matrices; blocks of whole spheres a."""
    per = np.searchsorted(mine, np.append(starts, starts[-1] + sizes[-1]))
    kept, size = [], 0
    for start, n, low, high in zip(starts.tolist(), sizes.tolist(), per[:-1].tolist(), per[1:].tolist()):
        whole = slice(start, start + n)
        x = at[:, whole] - at[:, whole].mean(axis=1)[:, None]
        power, ones = (x * x).sum(axis=0) - r[whole] ** 2, np.ones(n)
        ours = mine[low:high]
        a, b = np.stack((*(-2.0 * x), -2.0 * r[whole], power, ones), axis=1)[ours - start], np.stack((*x, r[whole], ones, power))
        slack = 1e-9 * (1.0 + (x * x).sum(axis=0).max() + (r[whole] ** 2).max())
        step = max(1, PRODUCTS // n)
        for k in range(0, len(ours), step):
            # Squares of distances less those of reaches, but for rounding.
            i, j = np.nonzero(a[k : k + step] @ b < slack)
            kept.append((ours[k : k + step][i], j + start))
            size += len(i)
            if size >= CANDIDATES:
                yield tuple(map(np.concatenate, zip(*kept)))
                kept, size = [], 0
    if kept:
        yield tuple(map(np.concatenate, zip(*kept)))


def _found(at, r, ball, image, mine, order, begin, end):
    """The pairs (a, b) that overlap, as rows of the table, by a, plane offset, image and id; with their offset, whether b covers
    a, and whether it lies within a."""
    length = (end - begin).ravel()
    total = int(length.sum())
    shift = np.repeat(begin.ravel() - (np.cumsum(length) - length), length)
    b = order[np.arange(total) + shift]
    return _overlapping(at, r, ball, image, np.repeat(mine, (end - begin).sum(axis=1)), b)


def _overlapping(at, r, ball, image, a, b):
    """_found() of candidates (a, b)."""
    d2 = np.zeros(len(a))
    for x in at:
        d = x[a] - x[b]
        d2 += d * d
    reach = r[a] + r[b]
    keep = np.nonzero(d2 + EPSILON < reach * reach)[0]
    a, b, d2 = a[keep], b[keep], d2[keep]
    keep = (ball[a] != ball[b]) | (image[b] != 0)
    a, b, d2 = a[keep], b[keep], d2[keep]
    if not len(a):
        return None
    ra, rb = r[a], r[b]
    within = d2 < (ra - rb) * (ra - rb) + EPSILON
    inner, outer = within & (ra + EPSILON > rb), within & (rb + EPSILON > ra)
    same = np.abs(ra - rb) <= EPSILON
    for x in at:
        same &= np.abs(x[a] - x[b]) <= EPSILON
    covered = outer & (~same | (image[b] == 0) & (ball[a] > ball[b]))
    d = np.sqrt(d2)
    apart = d >= EPSILON
    h = np.where(apart, (d * d + ra * ra - rb * rb) / np.where(apart, d * 2.0, 1.0), 0.0)
    by = _by_offset(a, h, image[b], ball[b])
    return a[by], b[by], h[by], covered[by], inner[by]


def _by_offset(a, h, image, ball) -> np.ndarray:
    """np.lexsort((ball, image, h, a)) for a that are sorted: by h alone, then by a in one pass, and equal ones by all."""
    number = np.concatenate(([0], np.cumsum(a[1:] != a[:-1])))
    if number[-1] > np.iinfo(np.uint16).max or not np.isfinite(h).all():
        return np.lexsort((ball, image, h, a))
    by = np.argsort(h)
    by = by[np.argsort(number.astype(np.uint16)[by], kind="stable")]
    equal = np.nonzero((h[by[1:]] == h[by[:-1]]) & (a[by[1:]] == a[by[:-1]]))[0]
    if len(equal):
        near = np.zeros(len(by), bool)
        near[equal] = near[equal + 1] = True
        at = np.nonzero(near)[0]
        some = by[at]
        by[at] = some[np.lexsort((ball[some], image[some], h[some], a[some]))]
    return by


def _rows(table, at, r, ball, image, a, b, h, covered, inner) -> pa.RecordBatch:
    first = np.concatenate(([0], np.nonzero(np.diff(a))[0] + 1))
    own = a[first]
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a))))
    hidden = np.logical_or.reduceat(covered, first)
    keep = ~inner & ~hidden[number]
    near = b[keep]
    taken = pa.array(near)
    lists = lambda number, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(own))))).astype(np.int32)), values)
    fields = {"h": pa.array(h[keep]), "bimage": pa.array(image[near]), "b": pa.array(ball[near]), **{f"b{c}": pa.array(x[near]) for c, x in zip("xyz", at)}, "br": pa.array(r[near]), "bgrp": table.column("grp").combine_chunks().take(taken)}
    fields["bgrp"] = fields["bgrp"].combine_chunks() if isinstance(fields["bgrp"], pa.ChunkedArray) else fields["bgrp"]
    mine = pa.array(own)
    flat = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    columns = {
        "structure_id": flat(table.column("structure_id").take(mine)), "a": pa.array(ball[own]), **{f"a{c}": pa.array(x[own]) for c, x in zip("xyz", at)}, "ar": pa.array(r[own]),
        "agrp": flat(table.column("grp").take(mine)), "hidden": pa.array(hidden),
        "near": lists(number[keep], pa.StructArray.from_arrays(list(fields.values()), names=list(fields))), "links": lists(number, pa.array(ball[b])),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def near_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """neighbourhoods() of batches that are sorted by place."""
    # Once the C library has freed an array of this size, it keeps smaller ones to use again and gives no page back at each.
    np.empty(KEPT_BYTES, np.uint8)
    for table in whole_places(batches):
        yield from neighbourhoods(table)


def in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of up to about ENTRIES neighbours, so that a task's memory does not grow with how many there are."""
    upto = np.cumsum(pc.list_value_length(batch.column("near")).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + ENTRIES, "right")))
        yield batch.slice(i, j - i)
        i = j
