"""State by bucket: what an update reads and writes, and streams that stop and go on."""

import random

import pytest
from pyspark.sql import functions as F

from sphaera.operators.periodic import PeriodicBox
from sphaera.plans.incremental import TABLES, UpdateableTessellation
from sphaera.plans.tessellation import tessellate
from sphaera.streaming.follow import follow

SCHEMA = "structure_id long, ball_id long, x double, y double, z double, r double"


def balls(spark, structures, each=6, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(s, i, *[rng.uniform(0, 5) for _ in range(3)], rng.uniform(0.8, 1.6)) for s in range(structures) for i in range(each)], SCHEMA)


def same_as_new(t, now, probe=0.6, box=None):
    full = UpdateableTessellation()
    full.init(now, probe, box)
    for name, key in (("contacts", ("id_a", "id_b")), ("cells", ("index",))):
        a, b = ({tuple(r[k] for k in ("structure_id", *key)): r for r in getattr(x, name).collect()} for x in (t, full))
        if name == "cells":
            # A ball that lost its contacts to an update, but not its neighbours, keeps a whole cell.
            met = {(r["structure_id"], i) for r in t.contacts.collect() for i in (r["id_a"], r["id_b"])}
            a = {k: r for k, r in a.items() if k in b or k in met}
        assert a.keys() == b.keys()
        column = "area" if name == "contacts" else "volume"
        assert all(a[k][column] == pytest.approx(b[k][column], abs=1e-9) for k in a)


def written(before, after):
    """The buckets of each table that are in another folder than before."""
    return {n: {b for b in getattr(before, n).folders.keys() | getattr(after, n).folders.keys() if getattr(before, n).folders.get(b) != getattr(after, n).folders.get(b)} for n in TABLES}


def test_one_moved_ball_touches_one_structure(spark):
    start = balls(spark, 200)
    t = UpdateableTessellation(with_backup=True, buckets=100_000)
    t.init(start, 0.6)
    before = t.state
    assert len(before.balls.folders) > 195
    moved = start.withColumn("x", F.when((F.col("structure_id") == 117) & (F.col("ball_id") == 2), F.col("x") + 0.3).otherwise(F.col("x")))
    assert t.update(moved) and not t.last_update_was_full_reinit
    touched = written(before, t.state)
    assert len(touched["full"]) == len(touched["balls"]) == 1 and touched["full"] == touched["cells"] == touched["links"] and not touched["excluded"]
    (folder,) = (t.state.balls.folders[b] for b in touched["balls"])
    assert {r[0] for r in spark.read.parquet(folder).select("structure_id").distinct().collect()} == {117}
    assert [tuple(r) for r in t.changed.collect()] == [(117, 2)] and {r[0] for r in t.affected.select("structure_id").distinct().collect()} == {117}
    same_as_new(t, moved)
    assert t.restore() and t.state is before


def test_unchanged_tables_are_told_by_digests(spark):
    start = balls(spark, 5)
    t = UpdateableTessellation()
    t.init(start, 0.6)
    before, t._changes = t.state, None
    assert not t.update(start.repartition(7)) and t.state is before and t.changed.count() == 0


@pytest.mark.parametrize("box", [None, PeriodicBox.from_vectors((6, 0, 0), (1, 6, 0), (0, 0, 7))])
def test_a_run_of_updates(spark, box):
    start = balls(spark, 12, 12, 3)
    t = UpdateableTessellation(buckets=5)
    t.init(start, 0.6, box)
    now = {(r[0], r[1]): tuple(r) for r in start.collect()}
    rng = random.Random(9)
    for step in range(3):
        some = rng.sample(sorted(now), 3)
        rows = [(*k, now[k][2] + rng.uniform(-1, 1), *now[k][3:5], rng.uniform(0.8, 1.6)) for k in some]
        now |= {r[:2]: r for r in rows}
        assert t.update_some(spark.createDataFrame(rows, SCHEMA)) and not t.last_update_was_full_reinit
    t.set_exclusion(4, True, 7)
    t.set_exclusion(4, False, 7)
    same_as_new(t, spark.createDataFrame(list(now.values()), SCHEMA), box=box)
    keys = sorted(now)[:2]
    rows = spark.createDataFrame([(*now[keys[0]][:5], 2.0), (99, 0, 0.0, 0.0, 0.0, 1.0)], SCHEMA)
    assert t.update_some(rows) and t.last_update_was_full_reinit and t.balls.count() == len(now) + 1


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """A query stops after some batches; another one, with a tessellation loaded from the folder, goes on, and a batch
    that was taken but not committed is not taken twice."""
    start = balls(spark, 4, 8, 5)
    t = UpdateableTessellation()
    t.init(start, 0.6)
    t.save(str(tmp_path / "kept"), -1)
    feed = lambda n, rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    (tmp_path / "in").mkdir()
    first = {(r[0], r[1]): tuple(r) for r in start.collect()}
    batches = [[(*first[k][:2], first[k][2] + 0.2 * (n + 1), *first[k][3:]) for k in sorted(first)[n * 3 : n * 3 + 2]] for n in range(4)]
    seen = []

    def run(t, done):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        query = follow(stream, t, lambda x, n: seen.append((n, done)), keep=str(tmp_path / "kept"), done=done, checkpointLocation=str(tmp_path / "log"))
        query.processAllAvailable()
        query.stop()

    for n in (0, 1):
        feed(n, batches[n])
    run(t, -1)
    for n in (2, 3):
        feed(n, batches[n])
    # The log of the last batch is lost: Spark gives it again.
    for name in ("1", ".1.crc"):
        (tmp_path / "log" / "commits" / name).unlink(missing_ok=True)
    again, done = UpdateableTessellation.load(spark, str(tmp_path / "kept"))
    assert done == 1 and again.box is None
    run(again, done)
    assert [n for n, _ in seen] == [0, 1, 1, 2, 3]
    now = dict(first)
    for rows in batches:
        now |= {r[:2]: r for r in rows}
    same_as_new(again, spark.createDataFrame(list(now.values()), SCHEMA))
