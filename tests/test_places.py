"""Neighbours that are searched place by place equal those of the join, and no pair leaves its task."""

import random

import pyarrow as pa
import pytest

from sphaera.functions import search
from sphaera.operators import overlap
from sphaera.operators.periodic import PeriodicBox
from sphaera.plans.tessellation import tessellate

BOX, SKEW = PeriodicBox.from_corners((0, 0, 0), (30, 30, 30)), PeriodicBox.from_vectors((30, 0, 0), (5, 29, 0), (-4, 3, 31))


def _balls(spark, n=600, structures=2, seed=3):
    rng = random.Random(seed)
    rows = [(s, i, *[rng.uniform(-2, 30) for _ in range(3)], rng.choice((0.4, 1.2, 2.0)), rng.choice((None, 1, 2))) for s in range(structures) for i in range(n)]
    return spark.createDataFrame(rows, "structure_id long, ball_id long, x double, y double, z double, r double, grp long")


def _plain(df):
    out = {}
    for r in df.collect():
        near = [tuple(n[f] for f in ("bimage", "b", "bgrp")) for n in r["near"]]
        out[r["structure_id"], r["a"]] = (r["ax"], r["ay"], r["az"], r["ar"], r["agrp"], r["hidden"], near, [pytest.approx(n["h"], abs=1e-9) for n in r["near"]], sorted(r["links"]))
    return out


@pytest.mark.parametrize("box", [None, BOX, SKEW])
@pytest.mark.parametrize("place_rows", [8192, 100])
@pytest.mark.parametrize("part", [False, True])
def test_places_equal_the_join(spark, monkeypatch, box, place_rows, part):
    monkeypatch.setattr(overlap, "PLACE_ROWS", place_rows)
    # Blocks of one cell, so that a structure has several.
    monkeypatch.setattr(overlap, "BLOCK_CELLS", 1)
    spheres = overlap.spheres_of(_balls(spark), 0.5)
    some = spheres.where("ball_id % 7 = 1").select("structure_id", "ball_id") if part else None
    found = overlap.neighbourhoods(spheres, box, some)
    assert found.dealt is not None and found.joined is None
    assert _plain(found.rows()) == _plain(overlap.neighbours(overlap.overlaps(spheres, box, some)))


def test_crowded_blocks_and_uneven_structures_take_the_join(spark, monkeypatch):
    want = _plain(overlap.neighbours(overlap.overlaps(overlap.spheres_of(_balls(spark), 0.5))))
    for limits in ({"PLACE_ROWS": 100, "CELL_ROWS": 20}, {"SMALL": 10, "EVEN": 1.0}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(overlap, name, value)
            found = overlap.neighbourhoods(overlap.spheres_of(_balls(spark), 0.5))
        assert found.dealt is None and found.joined is not None
        assert _plain(found.rows()) == want


def test_places_stay_whole_whatever_the_batches():
    table = pa.table({"structure_id": [0] * 5 + [1] * 9 + [2] * 2, "px": [0] * 16, "py": [0] * 16, "pz": [0] * 14 + [0, 1], "n": range(16)})
    for size in (1, 3, 16):
        for rows in (1, 4, 100):
            search.ROWS, before = rows, search.ROWS
            try:
                got = [t.column("n").to_pylist() for t in search.whole_places(table.to_batches(max_chunksize=size))]
            finally:
                search.ROWS = before
            assert sum(got, []) == list(range(16))
            starts = {0, 5, 14, 15}
            assert all(g[0] in starts for g in got)


def test_no_pair_is_shuffled(spark):
    """Contacts come from one exchange, of spheres; pairs of spheres took a join and another exchange of each pair."""
    plan = tessellate(_balls(spark), 1.4).contacts._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 1


def test_memory_does_not_grow_with_the_neighbours_of_a_batch():
    """contacts are made from slices of so many neighbours, where a batch of 10,000 spheres was taken whole."""
    batch = pa.RecordBatch.from_pydict({"near": [[0] * (search.ENTRIES // 3)] * 7 + [[]] + [[0] * (search.ENTRIES + 5)]})
    parts = list(search.in_parts(batch))
    assert sum(len(p) for p in parts) == len(batch) and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(len(p) == 1 or sum(map(len, p.column("near").to_pylist())) <= search.ENTRIES for p in parts)
