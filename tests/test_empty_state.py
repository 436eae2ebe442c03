"""a table of the state without rows, as that of excluded balls mostly is, takes no join and no shuffle."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphaera.plans.incremental import Kept


def test_a_join_with_an_empty_table_is_left_out(spark):
    schema = T._parse_datatype_string("structure_id long, ball_id long, x double, links array<bigint>")
    empty = Kept(schema, {}).read(spark)
    assert [(f.name, f.dataType) for f in empty.schema] == [(f.name, f.dataType) for f in schema] and empty.isEmpty()
    rows = spark.range(1000).select(F.col("id").alias("structure_id"), F.col("id").alias("ball_id"))
    left = rows.join(empty, ["structure_id", "ball_id"], "left_anti")
    plan = left._jdf.queryExecution()
    assert "Join" not in plan.optimizedPlan().toString() and "Exchange" not in plan.executedPlan().toString()
    assert left.count() == 1000
