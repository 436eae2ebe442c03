"""Documents in pieces: the same bytes as whole ones, written by many tasks."""

import json
import random

import pytest

from sphaera.operators.periodic import PeriodicBox
from sphaera.plans.tessellation import tessellate
from sphaera.sources.sinks import json_documents, json_pieces, pymol_lines, pymol_script, write_pieces


def some_balls(spark, structures=3, each=25):
    rng = random.Random(4)
    rows = [(s, i, *[rng.uniform(0, 9) for _ in range(3)], rng.uniform(0.8, 1.9)) for s in range(structures) for i in range(each)]
    rows += [(7, 0, 0.0, 0.0, 0.0, 1.0), (8, 0, 0.0, 0.0, 0.0, 1.0), (8, 1, 0.1, 0.0, 0.0, 0.3)]
    return spark.createDataFrame(rows, "structure_id long, ball_id long, x double, y double, z double, r double")


@pytest.mark.parametrize("box", [None, PeriodicBox.from_corners((0, 0, 0), (9, 9, 9))])
def test_pieces_make_up_the_documents(spark, box):
    t = tessellate(some_balls(spark), 0.5, box).kept()
    want = {r["structure_id"]: r["json"] for r in json_documents(t).collect()}
    got = {}
    for r in json_pieces(t).orderBy("structure_id", "part", "a", "b", "line").collect():
        got[r["structure_id"]] = got.get(r["structure_id"], "") + r["text"]
    # Sums of the totals may come in another order.
    plain = lambda text: json.loads(text, parse_float=lambda x: round(float(x), 9))
    assert {k: plain(v) for k, v in got.items()} == {k: plain(v) for k, v in want.items()}
    assert all(got[k].split('"total_sas_area"')[0] == want[k].split('"total_sas_area"')[0] for k in want)


def test_written_by_many_tasks(spark, tmp_path):
    t = tessellate(some_balls(spark), 0.5).kept()
    write_pieces(json_pieces(t), f"{tmp_path}/json", 9)
    write_pieces(pymol_lines(t), f"{tmp_path}/pymol", 9)
    text = lambda kind, s: "".join(p.read_text() for p in sorted((tmp_path / kind / f"structure_id={s}").glob("part-*")))
    assert len(list((tmp_path / "json" / "structure_id=1").glob("part-*"))) > 1
    for s in (0, 1, 2, 7, 8):
        assert json.loads(text("json", s))["num_balls"] == (25 if s < 3 else s - 6)
    assert text("pymol", 1) == "\n".join(pymol_script(t, 1)) + "\n"


def test_totals_do_not_depend_on_partitions(spark):
    """Bit for bit the same totals and cells, however the balls and the shuffles are dealt."""
    balls = some_balls(spark, 2, 120)
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            t = tessellate(balls.repartition(n), 0.7).kept()
            results.append((sorted(map(tuple, t.totals.collect())), sorted(map(tuple, t.cells.collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert results[0] == results[1] == results[2]


def test_exact_sums(spark):
    from pyspark.sql import functions as F

    from sphaera.functions.geometry import exact_sum

    rng = random.Random(8)
    values = [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 7) for _ in range(5000)]
    exact = sum(map(__import__("fractions").Fraction, values))
    sums = {spark.createDataFrame([(v,) for v in rng.sample(values, len(values))], "v double").repartition(n).agg(exact_sum(F.col("v"))).first()[0] for n in (1, 7, 40)}
    assert len(sums) == 1 and sums.pop() == pytest.approx(float(exact), abs=1e-8)
    assert spark.createDataFrame([(None,)], "v double").agg(exact_sum(F.col("v"))).first()[0] is None
