"""Which spheres overlap: a range join on a grid, the hidden spheres, and the neighbours of each sphere.

Tables are keyed by (structure_id, ball_id). The grid is a hash join of several levels, one for each class of
radii (powers of four): a sphere stays in the cell of its own class, and in one of each coarser class of its
structure; it calls, in the cells around, those of its class and of finer ones. So a pair meets once, on the level of
the larger one, and large spheres do not make the cells of small ones large. A giant structure spreads over as many
keys as it has cells, and a crowded cell over blocks.

Neighbours of each sphere need no row for a pair: whole places (a structure, or a block of a large one with what
reaches into it) are dealt out, and each task searches its own. Structures of very uneven radii or with crowded
blocks take the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphaera.functions.geometry import Vec, plane_offset, sphere_contains, spheres_equal, spheres_intersect, square_distance
from sphaera.functions.search import PLACE, near_batches
from sphaera.operators.periodic import LAST_FORWARD, STRUCTURES, PeriodicBox, images_within, reaches
from sphaera.staging import staged

KEY = ["structure_id", "ball_id"]
SPHERE = ["x", "y", "z", "r"]
ALL_CELLS = list(product((-1, 0, 1), repeat=3))
#: One of each two opposite neighbours, and the cell itself: each unordered pair of cells once.
HALF_CELLS = [c for c in ALL_CELLS if c >= (0, 0, 0)]
WIDE_CELLS = list(product((-2, -1, 0, 1, 2), repeat=3))
#: The most crowded cells that are broadcast.
CROWDED_CELLS = 100_000


def spheres_of(balls: DataFrame, probe: float = 0.0) -> DataFrame:
    """Balls with the probe added to their radii: (structure_id, ball_id, x, y, z, r, grp).

    A table without structure_id is one structure, one without grp has no groups. Balls with a null or NaN
    coordinate or radius cannot take part in geometry: raise on reading one.
    """
    sid = F.col("structure_id") if "structure_id" in balls.columns else F.lit(0)
    grp = F.col("grp").cast("long") if "grp" in balls.columns else F.lit(None).cast("long")
    numbers = [F.col(c).cast("double") for c in SPHERE]
    bad = F.lit(False)
    for n in numbers:
        bad = bad | n.isNull() | F.isnan(n)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("ball with a missing coordinate or radius: "), F.col("ball_id").cast("string")))).otherwise(numbers[3] + F.lit(float(probe)))
    return balls.select(sid.alias("structure_id"), F.col("ball_id").cast("long").alias("ball_id"), *[n.alias(c) for n, c in zip(numbers[:3], SPHERE)], checked.cast("double").alias("r"), grp.alias("grp"))


#: Radii below this share a class.
LEAST_RADIUS = 0.5
#: Added to the size of cells, beyond rounding.
MARGIN = 0.25
#: A cell with more rows than this is split into blocks, of which each meets each of the other side.
CELL_ROWS = 20_000
_CELL = ["structure_id", "level", "fine", "gx", "gy", "gz"]


def _with_classes(spheres: DataFrame, *more: DataFrame) -> tuple[list[DataFrame], bool]:
    """Each frame with the class of every sphere, the power of four below its radius, and the classes of its
    structure with their largest radii, as an array: of those there are as many as there are powers of four. Also
    whether a structure has so many spheres that a cell might be crowded. The classes are looked up once and
    written, a row for each structure."""
    level = F.floor(F.log2(F.greatest("r", F.lit(LEAST_RADIUS))) / 2.0).cast("int").alias("level")
    found = spheres.groupBy("structure_id", level).agg(F.greatest(F.max("r"), F.lit(LEAST_RADIUS)).alias("reach"), F.count("*").alias("n"))
    found = staged(found.groupBy("structure_id").agg(F.sum("n").alias("n"), F.collect_list(F.struct("level", "reach")).alias("classes")), "classes")
    many = not found.where(F.col("n") > CELL_ROWS).isEmpty()
    return [f.select("*", level).join(found.drop("n"), "structure_id") for f in (spheres, *more)], many


def _cells(df: DataFrame, size: Column, box: PeriodicBox | None) -> DataFrame:
    """df with the cell ix, iy, iz of every sphere: along the axes, or along the vectors of a box, of whose length a
    whole number nx, ny, nz of cells makes up all."""
    if box is None:
        return df.withColumns({f"i{c}": F.floor(F.col(c) / size) for c in "xyz"})
    rows = box.inverse()
    df = df.withColumns({f"n{c}": F.greatest(F.lit(1).cast("long"), F.floor(F.lit(h) / size)) for c, h in zip("xyz", box.heights())})
    along = [sum((F.col(c) * F.lit(m) for c, m in zip("xyz", row)), F.lit(0.0)) for row in rows]
    return df.withColumns({f"i{c}": F.floor(f * F.col(f"n{c}")) for c, f in zip("xyz", along)})


def _stays(classed: DataFrame, box: PeriodicBox | None, coarser_only: bool = False) -> DataFrame:
    """Every sphere in its own cell: among its class, and among each coarser one of its structure, whose cells for
    finer spheres are half as long. In a box, cells repeat; wx, wy, wz tell how many boxes off the sphere is."""
    wanted = lambda c: c["level"] > F.col("level") if coarser_only else c["level"] >= F.col("level")
    rows = classed.select(*classed.columns, F.explode(F.filter("classes", wanted)).alias("of"))
    fine = F.col("of.level") > F.col("level")
    rows = rows.withColumns({"fine": fine, "size": F.when(fine, 1.0).otherwise(2.0) * F.col("of.reach") + MARGIN, "level": F.col("of.level")})
    rows = _cells(rows, F.col("size"), box)
    if box is None:
        return rows.select("structure_id", "ball_id", *SPHERE, "grp", "level", "fine", *[F.col(f"i{c}").alias(f"g{c}") for c in "xyz"])
    off = {c: F.floor(F.col(f"i{c}") / F.col(f"n{c}")) for c in "xyz"}
    places = [(F.col(f"i{c}") - off[c] * F.col(f"n{c}")).alias(f"g{c}") for c in "xyz"]
    return rows.select("structure_id", "ball_id", *SPHERE, "grp", "level", "fine", *places, *[off[c].alias(f"w{c}") for c in "xyz"])


def _calls(classed: DataFrame, box: PeriodicBox | None, half: bool, fine_only: bool = False) -> DataFrame:
    """Every sphere in all cells where one of its class, or (fine) of a finer one, can touch it; with half, of two
    opposite cells around the own one for its class. ``own`` marks its own cell."""
    own = F.filter("classes", lambda c: c["level"] == F.col("level"))[0]["reach"]
    finer = F.array_max(F.transform(F.filter("classes", lambda c: c["level"] < F.col("level")), lambda c: c["reach"]))
    options = [] if fine_only else [F.struct(F.lit(False).alias("fine"), (own * 2.0 + MARGIN).alias("size"), (F.col("r") + own).alias("out"))]
    options.append(F.struct(F.lit(True).alias("fine"), (own + MARGIN).alias("size"), (F.col("r") + finer).alias("out")))
    rows = classed.select(*classed.columns, F.explode(F.array(*options)).alias("of")).where("of.out is not null")
    rows = _cells(rows.select("structure_id", "ball_id", *SPHERE, "grp", "level", "of.*"), F.col("size"), box)
    kept = ["structure_id", "ball_id", *SPHERE, "grp", "level", "fine"]
    if box is None:
        moves = lambda cells: F.array(*[F.struct(*[F.lit(d).alias(f"o{c}") for c, d in zip("xyz", o)]) for o in cells])
        rows = rows.select("*", F.explode(F.when(F.col("fine"), moves(WIDE_CELLS)).otherwise(moves(HALF_CELLS if half else ALL_CELLS))).alias("o")).select("*", "o.*")
        gap = {c: F.greatest((F.col(f"i{c}") + F.col(f"o{c}")) * F.col("size") - F.col(c), F.col(c) - (F.col(f"i{c}") + F.col(f"o{c}") + 1) * F.col("size"), F.lit(0.0)) for c in "xyz"}
        near = sum((gap[c] * gap[c] for c in "xyz"), F.lit(0.0)) <= F.col("out") * F.col("out") + MARGIN
    else:
        for c, h in zip("xyz", box.heights()):
            most = F.ceil(F.col("out") / (F.lit(h) / F.col(f"n{c}")))
            rows = rows.select("*", F.explode(F.sequence(-most, most)).alias(f"o{c}"))
        offset = F.struct("ox", "oy", "oz")
        near = F.col("fine") | (offset >= F.struct(*[F.lit(0).cast("long").alias(f"o{c}") for c in "xyz"])) if half else F.lit(True)
    mine = ((F.col("ox") == 0) & (F.col("oy") == 0) & (F.col("oz") == 0) & ~F.col("fine")).alias("own")
    rows = rows.where(near)
    if box is None:
        return rows.select(*kept, mine, *[(F.col(f"i{c}") + F.col(f"o{c}")).alias(f"g{c}") for c in "xyz"])
    at = {c: F.col(f"i{c}") + F.col(f"o{c}") for c in "xyz"}
    off = {c: F.floor(at[c] / F.col(f"n{c}")) for c in "xyz"}
    return rows.select(*kept, mine, *[(at[c] - off[c] * F.col(f"n{c}")).alias(f"g{c}") for c in "xyz"], *[off[c].alias(f"q{c}") for c in "xyz"])


def _split(stays: DataFrame, calls: DataFrame, many: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with blocks of the cells that have more than CELL_ROWS rows of either side, and the columns to join
    on: a block of one side meets each block of the other. Where no cell has that many, they come back as they are;
    that is looked up first, if there are structures that are large enough."""
    crowded = lambda rows: rows.groupBy(*_CELL).agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    if not many or crowded(stays).isEmpty():
        # No cell around one has more than its 27 or 125 times as many callers.
        return stays, calls, _CELL
    parts = F.ceil(F.col("n") / CELL_ROWS).cast("int")
    a, b = (crowded(rows).select(*_CELL, parts.alias(n)) for rows, n in ((stays, "a_parts"), (calls, "b_parts")))
    both = staged(a.join(b, _CELL, "full").fillna(1, ["a_parts", "b_parts"]), "crowded")
    if both.limit(CROWDED_CELLS + 1).count() <= CROWDED_CELLS:
        both = F.broadcast(both)
    out = []
    for rows, mine, other in ((stays, "a", "b"), (calls, "b", "a")):
        rows = rows.join(both, _CELL, "left").fillna(1, ["a_parts", "b_parts"])
        rows = rows.withColumn(f"{mine}_block", F.pmod(F.xxhash64("ball_id"), F.col(f"{mine}_parts")).cast("int"))
        out.append(rows.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1))).drop("a_parts", "b_parts"))
    return *out, [*_CELL, "a_block", "b_block"]


def _met(stays: DataFrame, calls: DataFrame, box: PeriodicBox | None, many: bool) -> DataFrame:
    """Overlapping (p, q): p stays, q calls, each a struct (ball_id, x, y, z, r, grp). In a box, q moved by sx, sy, sz
    boxes touches p; only moves by up to one box along each vector count."""
    stays, calls, on = _split(stays, calls, many)
    whole = lambda df, n: df.select(*on, *[c for c in df.columns if c in ("own", "wx", "wy", "wz", "qx", "qy", "qz")], F.struct("ball_id", *SPHERE, "grp").alias(n))
    found = whole(stays, "p").join(whole(calls, "q"), on)
    moves = [F.col(f"w{c}") - F.col(f"q{c}") for c in "xyz"] if box else [F.lit(0).cast("long")] * 3
    found = found.select("structure_id", "own", "p", "q", *[m.alias(f"s{c}") for c, m in zip("xyz", moves)])
    for c in "xyz" if box else "":
        found = found.where(F.col(f"s{c}").between(-1, 1))
    p = Vec(*[F.col(f"p.{c}") for c in "xyz"])
    q = _moved("q", box, 1)
    found = found.where(spheres_intersect(square_distance(p, q), F.col("p.r"), F.col("q.r")))
    other = F.when(F.col("own"), F.col("p.ball_id") < F.col("q.ball_id")).otherwise((F.col("p.ball_id") != F.col("q.ball_id")) | (F.col("sx") != 0) | (F.col("sy") != 0) | (F.col("sz") != 0))
    return found.where(other)


def _moved(of: str, box: PeriodicBox | None, sign: int) -> Vec:
    """The centre of sphere ``of``, moved by sign times (sx, sy, sz) boxes."""
    if box is None:
        return Vec(*[F.col(f"{of}.{c}") for c in "xyz"])
    moves = [sum((F.col(f"s{s}") * F.lit(v[i]) for s, v in zip("xyz", (box.a, box.b, box.c))), F.lit(0.0)) * sign for i in range(3)]
    return Vec(*[F.col(f"{of}.{c}") + m for c, m in zip("xyz", moves)])


def _seen(a: str, b: str, box: PeriodicBox | None, sign: int) -> Column:
    """The overlap of a with b moved by sign times the shift, as a struct of the columns of overlaps()."""
    at = _moved(b, box, sign)
    place = (F.col("sx") * sign + 1) * 9 + (F.col("sy") * sign + 1) * 3 + F.col("sz") * sign + 1
    image = F.when(place == 13, 0).when(place < 13, place + 1).otherwise(place).cast("int")
    return F.struct(
        F.col(f"{a}.ball_id").alias("a"), *[F.col(f"{a}.{c}").alias(f"a{c}") for c in [*SPHERE, "grp"]],
        F.col(f"{b}.ball_id").alias("b"), *[x.alias(f"b{c}") for c, x in zip("xyz", at)], F.col(f"{b}.r").alias("br"), F.col(f"{b}.grp").alias("bgrp"),
        (image if box else F.lit(0)).alias("bimage"),
    )


def squared(a: str = "a", b: str = "b"):
    return square_distance(Vec.of(a), Vec.of(b))


def overlaps(spheres: DataFrame, box: PeriodicBox | None = None, some: DataFrame | None = None) -> DataFrame:
    """Both directions of every pair of overlapping spheres of a structure, with their coordinates; with ``some``
    (structure_id, ball_id), only those from these spheres. Touching spheres do not overlap.

    Columns: structure_id, a, ax, ay, az, ar, agrp, the same for b, and bimage. In a box, b may be the image of that
    number, with its coordinates there. No image is written: cells repeat with the box, and a pair carries how many
    boxes apart its cells are.
    """
    if some is None:
        (classed,), many = _with_classes(spheres)
        found = _met(_stays(classed, box), _calls(classed, box, half=True), box, many)
        both = F.array(_seen("p", "q", box, 1), _seen("q", "p", box, -1))
        return found.select("structure_id", F.explode(both).alias("o")).select("structure_id", "o.*")
    (classed, left), many = _with_classes(spheres, spheres.join(some, KEY, "left_semi"))
    # Those call others of their class and finer ones, and coarser ones call them.
    called = _met(_stays(classed, box), _calls(left, box, half=False).withColumn("own", F.lit(False)), box, many).select("structure_id", _seen("q", "p", box, -1).alias("o"))
    heard = _met(_stays(left, box, coarser_only=True), _calls(classed, box, half=False, fine_only=True), box, many).select("structure_id", _seen("p", "q", box, 1).alias("o"))
    return called.unionByName(heard).select("structure_id", "o.*")


def _covered():
    """b contains a: and, of two equal ones, the one with the larger id is covered."""
    same = spheres_equal(Vec.of("a"), F.col("ar"), Vec.of("b"), F.col("br"))
    return sphere_contains(squared(), F.col("br"), F.col("ar")) & (~same | (F.col("bimage") == 0) & (F.col("a") > F.col("b")))


def hidden(over: DataFrame) -> DataFrame:
    """(structure_id, ball_id) of spheres that lie within another one."""
    return over.where(_covered()).select("structure_id", F.col("a").alias("ball_id")).distinct()


def neighbours(over: DataFrame) -> DataFrame:
    """One row for each sphere that overlaps any: its neighbours as an array near, sorted by the offset h of
    their radical plane and then by id. Hidden spheres have none; spheres within a are not neighbours of a. links has
    the ids of all that overlap it.

    The number of neighbours is bounded by how many spheres fit around one, not by the size of the table.
    """
    d2 = squared()
    h = plane_offset(F.sqrt(d2), F.col("ar"), F.col("br"))
    inner = sphere_contains(d2, F.col("ar"), F.col("br"))
    one = F.struct(h.alias("h"), "bimage", "b", "bx", "by", "bz", "br", "bgrp")
    rows = over.withColumn("one", F.when(~inner, one)).withColumn("covered", _covered())
    group = rows.groupBy("structure_id", "a").agg(
        *[F.first(c).alias(c) for c in ("ax", "ay", "az", "ar", "agrp")], F.max("covered").alias("hidden"), F.array_sort(F.collect_list("one")).alias("near"),
        F.collect_list("b").alias("links"),
    )
    return group.withColumn("near", F.when(F.col("hidden"), F.slice("near", 1, 0)).otherwise(F.col("near")))


#: Structures of up to so many spheres are one place.
PLACE_ROWS = 8192
#: Those of up to so many are one whatever their radii.
SMALL = 2048
#: Radii are even if the largest is at most so many times the mean.
EVEN = 4.0
#: The length of a block of a larger structure, in cells of its largest spheres.
BLOCK_CELLS = 4
#: Spheres that a task gets, about: it looks at some thousand at a time, and takes a good part of a second to begin.
TASK_ROWS = 1 << 15


@dataclass(frozen=True)
class Neighbourhoods:
    """The neighbours of spheres, as neighbours() has them, still to be searched: ``dealt`` has whole places by partition,
    ``joined`` the rows of structures that take the join."""

    dealt: DataFrame | None
    joined: DataFrame | None
    schema: T.StructType

    def rows(self) -> DataFrame:
        """One row for each sphere that overlaps any."""
        return self.mapped(lambda batches: batches, self.schema, self.joined)

    def mapped(self, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType, joined: DataFrame | None = None) -> DataFrame:
        """What run makes of Arrow batches of the rows, in the tasks that search them."""
        parts = [self.dealt.mapInArrow(lambda batches: run(near_batches(batches)), schema)] if self.dealt is not None else []
        if self.joined is not None:
            parts.append(self.joined.mapInArrow(run, schema) if joined is None else joined)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


_NEAR = (
    "a bigint, ax double, ay double, az double, ar double, agrp bigint, hidden boolean, "
    "near array<struct<h:double,bimage:int,b:bigint,bx:double,by:double,bz:double,br:double,bgrp:bigint>>, links array<bigint>"
)


def neighbourhoods(spheres: DataFrame, box: PeriodicBox | None = None, some: DataFrame | None = None) -> Neighbourhoods:
    """The neighbours of all spheres, or with ``some`` (structure_id, ball_id) of these, without a row for a pair."""
    schema = T.StructType([spheres.schema["structure_id"], *T._parse_datatype_string(_NEAR).fields])
    spheres = spheres.where("structure_id is not null")
    if some is not None:
        spheres = spheres.join(some.select("structure_id").distinct(), "structure_id", "left_semi")
    uneven = (F.col("n") > SMALL) & (F.col("most") > EVEN * F.col("mean"))
    found = staged(reaches(spheres, F.count("*").alias("n"), F.avg("r").alias("mean")).withColumn("odd", uneven), "structures")
    large = F.col("n") > PLACE_ROWS
    seen = found.agg(F.count("*").alias("structures"), F.sum("n").alias("n"), F.count_if(large & ~F.col("odd")).alias("large"), F.count_if("odd").alias("odd")).first()
    size = (F.col("most") * 2.0 + MARGIN) * BLOCK_CELLS
    block = {f"p{c}": F.floor(F.col(c) / size) for c in "xyz"}
    if seen["large"]:
        # A block that is crowded is not searched by one task.
        crowded = spheres.join(found.where(large & ~F.col("odd")), "structure_id").withColumns(block).groupBy(*PLACE).agg(F.count("*").alias("here"))
        crowded = crowded.where(F.col("here") > CELL_ROWS).select("structure_id", F.lit(True).alias("crowded")).distinct()
        found = staged(found.join(crowded, "structure_id", "left").withColumn("odd", F.col("odd") | F.coalesce("crowded", F.lit(False))).drop("crowded"), "structures")
        seen = seen.asDict() | {"odd": found.where("odd").count()}
    all_odd, any_odd = seen["structures"] > 0 and seen["odd"] == seen["structures"], seen["odd"] > 0
    joined = dealt = None
    if any_odd:
        odd = spheres if all_odd else spheres.join(found.where("odd").select("structure_id"), "structure_id", "left_semi")
        joined = neighbours(overlaps(odd, box, some)).select(*schema.names)
    if not all_odd:
        rows = spheres
        if any_odd or seen["large"] or box is not None:
            about = found.where("not odd")
            rows = rows.join(F.broadcast(about) if seen["structures"] <= STRUCTURES else about.hint("merge"), "structure_id")
        rows = rows.withColumn("image", F.lit(0)) if box is None else images_within(rows, box)
        mine = F.col("image") == 0
        if seen["large"]:
            rows = _with_blocks(rows, size, large)
            mine = mine & F.col("home")
        else:
            rows = rows.withColumns({p: F.lit(0).cast("long") for p in PLACE[1:]})
        rows = rows.withColumn("mine", mine)
        if some is not None:
            rows = rows.join(some.select(*KEY).distinct().withColumn("wanted", F.lit(True)), KEY, "left").withColumn("mine", F.col("mine") & F.coalesce("wanted", F.lit(False)))
        parts = max(-(-(seen["n"] or 0) // TASK_ROWS), min(seen["structures"], 4 * spheres.sparkSession.sparkContext.defaultParallelism), 1)
        dealt = rows.select(*PLACE, "ball_id", *SPHERE, "grp", "image", "mine").repartition(parts, *PLACE).sortWithinPartitions(*PLACE)
    return Neighbourhoods(dealt, joined, schema)


def _with_blocks(rows: DataFrame, size: Column, large: Column) -> DataFrame:
    """The spheres of large structures in each block that they may reach a sphere of, with ``home`` for their own; others in
    one. A block without any sphere of its structure's own has none at home and is passed over."""
    out = F.col("r") + F.col("most") + MARGIN
    for c in "xyz":
        low, high = (F.floor(F.col(f"{end}{c}") / size) for end in ("low", "high"))
        first, last = F.greatest(low, F.floor((F.col(c) - out) / size)), F.least(high, F.floor((F.col(c) + out) / size))
        none = F.array().cast("array<bigint>")
        rows = rows.select("*", F.explode(F.when(~large, F.array(F.lit(0).cast("long"))).when(first > last, none).otherwise(F.sequence(first, F.greatest(first, last)))).alias(f"p{c}"))
    gap = [F.greatest(F.col(f"p{c}") * size - F.col(c), F.col(c) - (F.col(f"p{c}") + 1) * size, F.lit(0.0)) for c in "xyz"]
    home = F.lit(True)
    for c in "xyz":
        home = home & (F.col(f"p{c}") == F.floor(F.col(c) / size))
    return rows.where(~large | (sum((g * g for g in gap), F.lit(0.0)) <= out * out)).withColumn("home", ~large | home)


def pairs(near: DataFrame) -> DataFrame:
    """The pairs (a, b) whose contact is to be constructed, each once, with the neighbours of a.

    a < b, and of a sphere and its own images one of each two opposite ones. Pairs of one group are left out; a null
    group is a group of its own.
    """
    rows = near.select("*", F.explode("near").alias("b")).select("structure_id", "a", "ax", "ay", "az", "ar", "agrp", "near", "b.*")
    once = (F.col("a") < F.col("b")) | (F.col("a") == F.col("b")) & (F.col("bimage") <= LAST_FORWARD)
    return rows.where(once & ~F.coalesce(F.col("agrp") == F.col("bgrp"), F.lit(False)))
