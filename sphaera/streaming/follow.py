"""Keep a tessellation up to date with a stream of moved balls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sphaera.operators.overlap import KEY
from sphaera.plans.incremental import UpdateableTessellation


def last_rows(batch: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each ball: of several, the last by ``order``."""
    if order:
        last = Window.partitionBy(*KEY).orderBy(F.desc(order))
        batch = batch.withColumn("__n", F.row_number().over(last)).where("__n = 1")
    return batch.select(*KEY, *"xyzr").dropDuplicates(KEY)


def follow(
    stream: DataFrame, tessellation: UpdateableTessellation, then: Callable[[UpdateableTessellation, int], None] | None = None, order: str | None = None,
    keep: str | None = None, done: int = -1, **options: str,
) -> StreamingQuery:
    """Start a query that updates an initialised tessellation with each micro-batch of (structure_id, ball_id,
    x, y, z, r) and calls then(tessellation, batch number) after it. New keys are new balls. A batch reads and writes
    the buckets of its structures only.

    With ``keep``, a folder, the state is saved there after each batch. After a restart, UpdateableTessellation.load()
    gives it back with the number of its batch, which goes in as ``done``: a batch that Spark then gives
    again is not taken twice.
    """

    def take(batch: DataFrame, number: int) -> None:
        if number > done:
            tessellation.update_some(last_rows(batch, order))
            if keep:
                tessellation.save(keep, number)
        if then:
            then(tessellation, number)

    return stream.writeStream.options(**options).foreachBatch(take).start()
