"""Tessellations that follow changes of their balls.

The state is a set of tables in the shared folder, each written bucket by bucket; a structure has one bucket. An update
finds the balls that changed, adds their old and new neighbours, recomputes the contacts between those alone and
replaces them; results are those of a full computation. It reads and writes the buckets of the structures that changed
and leaves all others where they are: a table of the state only says which folder has which bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphaera.functions.geometry import eq
from sphaera.operators import cells as cell_ops
from sphaera.operators import contacts as contact_ops
from sphaera.operators.overlap import KEY, Neighbourhoods, neighbourhoods, spheres_of
from sphaera.operators.periodic import PeriodicBox, first_of_pair
from sphaera.staging import shared_dir, staged

LEAST_FULL = 10
BUCKETS = 256


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("structure_id").cast("string")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Kept:
    """A table that is written bucket by bucket: the folder of each bucket that has rows."""

    schema: T.StructType
    folders: dict[int, str]

    @classmethod
    def written(cls, df: DataFrame, buckets: int, label: str) -> Kept:
        spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
        df.withColumn("__bucket", bucket(buckets)).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(path)
        found = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__bucket", T.IntegerType())])).parquet(path)
        return cls(df.schema, {r[0]: f"{path}/__bucket={r[0]}" for r in found.select("__bucket").distinct().collect()})

    def read(self, spark: SparkSession, only: Iterable[int] | None = None) -> DataFrame:
        """All of it, or the rows of some buckets."""
        paths = sorted({self.folders[b] for b in (self.folders if only is None else only) if b in self.folders})
        if paths:
            return spark.read.schema(self.schema).parquet(*paths)
        # Spark knows that this is empty and leaves joins with it out.
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]).where("false")

    def replaced(self, here: set[int], other: Kept) -> Kept:
        return replace(self, folders={b: p for b, p in self.folders.items() if b not in here} | other.folders)


@dataclass(frozen=True)
class State:
    """The tables, and for each bucket how many balls it has and a digest of them."""

    balls: Kept
    excluded: Kept
    links: Kept
    full: Kept
    cells: Kept
    digests: dict[int, tuple[int, int]]

    @property
    def count(self) -> int:
        return sum(n for n, _ in self.digests.values())


TABLES = ("balls", "excluded", "links", "full", "cells")


class UpdateableTessellation:
    """A tessellation of a table of balls (structure_id, ball_id, x, y, z, r) that can be updated.

    excluded_clip: whether excluded balls still cut the contacts of others, of which they have none
    themselves; without it they do not take part at all. Hidden balls have no cell here.
    """

    def __init__(self, with_backup: bool = False, excluded_clip: bool = True, buckets: int = BUCKETS):
        self.with_backup, self.excluded_clip, self.buckets = with_backup, excluded_clip, buckets
        self.spark: SparkSession | None = None
        self.state: State | None = None
        self.backup: State | None = None
        self.changed: DataFrame | None = None
        self.affected: DataFrame | None = None
        self.last_update_was_full_reinit = False
        self.probe, self.box = 0.0, None

    def _keyed(self, balls: DataFrame) -> DataFrame:
        keyed = balls if "structure_id" in balls.columns else balls.withColumn("structure_id", F.lit(0))
        return keyed.select(*KEY, *[F.col(c).cast("double").alias(c) for c in "xyzr"])

    def _digests(self, balls: DataFrame) -> dict[int, tuple[int, int]]:
        """(number of balls, digest of them) by bucket."""
        rows = balls.groupBy(bucket(self.buckets).alias("b")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*balls.columns)).alias("h"))
        return {r["b"]: (r["n"], r["h"]) for r in rows.collect()}

    def _read(self, table: str, only: Iterable[int] | None = None) -> DataFrame:
        return getattr(self.state, table).read(self.spark, only)

    def init(self, balls: DataFrame, probe: float, box: PeriodicBox | None = None) -> bool:
        """Compute all of it; False if no ball has a cell."""
        self.spark, self.probe, self.box, self.backup = balls.sparkSession, float(probe), box, None
        keyed = staged(self._keyed(balls), "state")
        first = self.state is None
        self.state = self._written(keyed, self._computed(keyed, keyed.select(*KEY).where("false"), not first), self._digests(keyed))
        self.changed = self.affected = keyed.select(*KEY)
        self.last_update_was_full_reinit = True
        return bool(self.state.cells.folders)

    def _written(self, balls: DataFrame, tables: dict[str, DataFrame], digests: dict[int, tuple[int, int]]) -> State:
        return State(**{n: Kept.written(df, self.buckets, f"state-{n}") for n, df in {"balls": balls, **tables}.items()}, digests=digests)

    def _around(self, balls: DataFrame, some: DataFrame | None, excluded: DataFrame) -> Neighbourhoods:
        spheres = spheres_of(balls, self.probe)
        if not self.excluded_clip:
            spheres = spheres.join(excluded, KEY, "left_anti")
        return neighbourhoods(spheres, self.box, some)

    def _measured(self, near: Neighbourhoods, excluded: DataFrame, some: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """What contacts.measured() gives, without contacts of excluded balls, and only those of two of some; and, from the
        same pass, (structure_id, a, links, hidden) of each sphere that overlaps any."""
        found = staged(contact_ops.measured(near, links=True), "state")
        over = found.where("links is not null").select("structure_id", "a", F.array_distinct("links").alias("links"), "hidden")
        rows = found.where("b is not null or around").drop("links", "hidden", "around")
        for end in "ab":
            rows = rows.join(excluded.select("structure_id", F.col("ball_id").alias(end)), ["structure_id", end], "left_anti")
        if some is not None:
            inside = some.select("structure_id", F.col("ball_id").alias("b"), F.lit(True).alias("inside"))
            rows = rows.join(inside, ["structure_id", "b"], "left").where("b is null or inside").drop("inside")
        return rows, over

    def _cells(self, balls, over, rows, excluded, after_update: bool) -> DataFrame:
        hidden = over.where("hidden").select("structure_id", F.col("a").alias("ball_id"))
        spheres = spheres_of(balls, self.probe).join(excluded, KEY, "left_anti").join(hidden, KEY, "left_anti")
        return cell_ops.cells(spheres, rows, detached_without_contacts=after_update)

    def _computed(self, balls: DataFrame, excluded: DataFrame, after_update: bool) -> dict[str, DataFrame]:
        rows, over = self._measured(self._around(balls, None, excluded), excluded, None)
        return {"excluded": excluded, "links": over.drop("hidden"), "full": contact_ops.contacts_full(rows), "cells": self._cells(balls, over, rows, excluded, after_update)}

    def _changes(self, new: DataFrame, here: Iterable[int]) -> tuple[DataFrame, bool]:
        """The balls of some buckets that differ between the state and new, and whether they are the same ones."""
        same = F.lit(True)
        for c in "xyzr":
            same = same & eq(F.col(f"n.{c}"), F.col(f"o.{c}"))
        joined = new.alias("n").join(self._read("balls", here).alias("o"), KEY, "full")
        changed = staged(joined.where(~F.coalesce(same, F.lit(False))).select(*KEY, (F.col("n.x").isNull() | F.col("o.x").isNull()).alias("other")), "changed")
        return changed.select(*KEY), changed.where("other").isEmpty()

    def update(self, balls: DataFrame) -> bool:
        """Take over new coordinates and radii; False if nothing changed. A change of the number of balls, or of
        more than half of them (10 at least), computes all of it anew. Digests tell which buckets differ at all;
        only those are compared with the state."""
        keyed = self._keyed(balls)
        digests, old = self._digests(keyed), self.state.digests
        here = {b for b in digests.keys() | old.keys() if digests.get(b) != old.get(b)}
        if not here:
            self._keep()
            self.last_update_was_full_reinit = False
            self.changed = self.affected = self._read("balls", ()).select(*KEY)
            return False
        new = staged(keyed.where(bucket(self.buckets).isin(*here)), "new")
        changed, same_balls = self._changes(new, here)
        return self._follow(new, here, changed, None, same_balls)

    def update_some(self, rows: DataFrame) -> bool:
        """update() with new coordinates and radii of some balls, one row each; the others stay. Keys that are not known
        are new balls. Only the buckets of their structures are read."""
        rows = staged(self._keyed(rows), "rows")
        here = {r[0] for r in rows.select(bucket(self.buckets)).distinct().collect()}
        new = staged(self._read("balls", here).join(rows.select(*KEY), KEY, "left_anti").unionByName(rows), "new")
        changed, same_balls = self._changes(new, here)
        return self._follow(new, here, changed, None, same_balls)

    def update_with_changed(self, balls: DataFrame, changed: DataFrame) -> bool:
        """update() for a caller who knows the (structure_id, ball_id) that changed."""
        changed = staged(changed.select(*KEY).distinct(), "changed")
        keyed = self._keyed(balls)
        same_balls = keyed.count() == self.state.count
        here = {r[0] for r in changed.select(bucket(self.buckets)).distinct().collect()} if same_balls else set(self._digests(keyed)) | set(self.state.digests)
        return self._follow(staged(keyed.where(bucket(self.buckets).isin(*here)), "new"), here, changed, None, same_balls)

    def set_exclusion(self, ball_id: int, excluded: bool = True, structure_id=0) -> bool:
        """Exclude a ball, or take it back; False if it was so already."""
        key = self.spark.range(1).select(F.lit(structure_id).alias("structure_id"))
        here = {r[0] for r in key.select(bucket(self.buckets)).collect()}
        balls, before = self._read("balls", here), self._read("excluded", here)
        one = staged(balls.where((F.col("ball_id") == ball_id) & (F.col("structure_id") == F.lit(structure_id))).select(*KEY), "one")
        now = not before.join(one, KEY, "left_semi").isEmpty()
        if now == excluded or one.isEmpty():
            self._keep()
            self.changed = self.affected = one.where("false")
            return False
        after = before.unionByName(one) if excluded else before.join(one, KEY, "left_anti")
        return self._follow(balls, here, one, staged(after, "excluded"), True, may_start_over=False)

    def _keep(self) -> None:
        if self.with_backup:
            self.backup = self.state

    def _follow(self, balls: DataFrame, here: set[int], changed: DataFrame, excluded: DataFrame | None, same_balls: bool, may_start_over: bool = True) -> bool:
        """Go on to a state whose buckets ``here`` have these balls, of which some changed, and these excluded ones."""
        self._keep()
        self.last_update_was_full_reinit = False
        excluded = self._read("excluded", here) if excluded is None else excluded
        count = changed.count()
        self.changed = self.affected = changed
        if not count and same_balls:
            return False
        digests = {b: d for b, d in self.state.digests.items() if b not in here} | self._digests(balls)
        limit = max(sum(n for n, _ in digests.values()) // 2, LEAST_FULL)
        old = self._read("links", here).join(changed.withColumnRenamed("ball_id", "a"), ["structure_id", "a"], "left_semi").select("structure_id", F.explode("links").alias("ball_id"))
        new = self._around(balls, changed, excluded).rows().select("structure_id", F.explode("links").alias("ball_id"))
        affected = staged(changed.unionByName(old).unionByName(new).distinct(), "affected")
        if not same_balls or may_start_over and (count > limit or affected.count() >= limit):
            self.last_update_was_full_reinit = True
            others = [b for b in self.state.digests if b not in here]
            balls = staged(balls.unionByName(self._read("balls", others)), "state")
            excluded = excluded.unionByName(self._read("excluded", others))
            self.affected = balls.select(*KEY)
            self.state = self._written(balls, self._computed(balls, excluded, True), digests)
            return True
        self.affected = affected
        rows, over = self._measured(self._around(balls, affected, excluded), excluded, affected)
        # Contacts of two affected balls are replaced, all others stand.
        touched = self._read("full", here)
        columns = touched.columns
        for end in "ab":
            mark = affected.select("structure_id", F.col("ball_id").alias(end), F.lit(True).alias(f"hit_{end}"))
            touched = touched.join(mark, ["structure_id", end], "left")
        stand = touched.where("hit_a is null or hit_b is null").select(*columns)
        full = staged(stand.unionByName(contact_ops.contacts_full(rows).select(*columns)), "full")
        fresh = self._cells(balls.join(affected, KEY, "left_semi"), over, full, excluded, True)
        cells = self._read("cells", here).join(affected.withColumnRenamed("ball_id", "index"), ["structure_id", "index"], "left_anti").unionByName(fresh)
        before = self._read("links", here).join(affected.withColumnRenamed("ball_id", "a"), ["structure_id", "a"], "left_anti")
        # Links from balls that are not affected to those that are do not change either: both ends would be.
        links = before.unionByName(over.drop("hidden"))
        part = self._written(balls, {"excluded": excluded, "links": links, "full": full, "cells": cells}, digests)
        self.state = State(**{n: getattr(self.state, n).replaced(here, getattr(part, n)) for n in TABLES}, digests=digests)
        return True

    def restore(self) -> bool:
        """Go back to before the last update or exclusion, once; False without a backup."""
        if self.backup is None:
            return False
        self.state, self.backup = self.backup, None
        return True

    def save(self, folder: str, number: int = 0) -> None:
        """Write where the state is, under a number, to a folder; load() goes on from the largest number."""
        tables = {n: {"schema": getattr(self.state, n).schema.json(), "folders": getattr(self.state, n).folders} for n in TABLES}
        box = [self.box.a, self.box.b, self.box.c] if self.box else None
        text = json.dumps({"tables": tables, "digests": self.state.digests, "probe": self.probe, "box": box, "buckets": self.buckets, "excluded_clip": self.excluded_clip, "with_backup": self.with_backup})
        self.spark.createDataFrame([(number, text)], "number long, state string").coalesce(1).write.mode("append").parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> tuple[UpdateableTessellation, int]:
        """The tessellation that was saved last, and its number."""
        number, text = spark.read.schema("number long, state string").parquet(folder).orderBy(F.desc("number")).first()
        saved = json.loads(text)
        out = cls(saved["with_backup"], saved["excluded_clip"], saved["buckets"])
        out.spark, out.probe, out.box = spark, saved["probe"], PeriodicBox.from_vectors(*saved["box"]) if saved["box"] else None
        whole = lambda d: {int(k): v for k, v in d.items()}
        tables = {n: Kept(T.StructType.fromJson(json.loads(t["schema"])), whole(t["folders"])) for n, t in saved["tables"].items()}
        out.state = State(**tables, digests={b: tuple(d) for b, d in whole(saved["digests"]).items()})
        out.changed = out.affected = out._read("balls", ()).select(*KEY)
        return out, number

    @property
    def balls(self) -> DataFrame:
        return self._read("balls")

    def _contacts(self, only: Iterable[int] | None = None) -> DataFrame:
        found = self._read("full", only)
        if self.box:
            found = first_of_pair(found, merge_inner=False)
        else:
            found = found.withColumns({"a_id": F.least("a", "b"), "b_id": F.greatest("a", "b")})
        return found.select("structure_id", F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), "area", "arc_length", "central")

    @property
    def contacts(self) -> DataFrame:
        return self._contacts()

    def contacts_for(self, ball_id: int, structure_id=0) -> DataFrame:
        mine = (F.col("id_a") == ball_id) | (F.col("id_b") == ball_id)
        return self.contacts.where(mine & (F.col("structure_id") == F.lit(structure_id)))

    @property
    def excluded(self) -> DataFrame:
        """(structure_id, ball_id) of the excluded balls."""
        return self._read("excluded")

    @property
    def collisions(self) -> DataFrame:
        """(structure_id, collisions): pairs of balls whose spheres overlap, images counted as their balls."""
        pair = F.array_sort(F.array("a", "b"))
        return self._read("links").select("structure_id", "a", F.explode("links").alias("b")).select("structure_id", pair.alias("pair")).distinct().groupBy("structure_id").agg(F.count("*").alias("collisions"))

    def colliding(self, ball_id: int, structure_id=0) -> DataFrame:
        """(structure_id, ball_id) of the balls that overlap one."""
        mine = (F.col("a") == ball_id) & (F.col("structure_id") == F.lit(structure_id))
        return self._read("links").where(mine).select("structure_id", F.explode("links").alias("ball_id")).distinct()

    @property
    def cells(self) -> DataFrame:
        return self._read("cells")

    @property
    def totals(self) -> DataFrame:
        return cell_ops.totals(self.balls, self.contacts, self.cells)
