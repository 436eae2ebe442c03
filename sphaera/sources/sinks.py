"""Writers: JSON documents, PyMOL scripts, plain dicts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.operators import cells as cell_ops
from sphaera.plans.tessellation import Tessellation
from sphaera.staging import staged


def json_documents(t: Tessellation) -> DataFrame:
    """(structure_id, json): one document a structure, with contacts, cells, areas and volumes by ball (null
    where a ball has no cell) and totals. A document is one row here; json_pieces() has structures of any size."""
    t = t.kept()
    # Three tables come from the cells.
    cells = staged(t.cells, "cells")
    contact = t.contacts.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("id_a", "id_b", "area", "arc_length", "central"))).alias("contacts"))
    ball = cell_ops.per_ball(t.balls, cells).groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("ball_id", "sas_area", "volume"))).alias("balls"))
    cell = cells.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("index", "sas_area", "volume"))).alias("cells"))
    rows = cell_ops.totals(t.balls, t.contacts, cells).join(contact, "structure_id", "left").join(cell, "structure_id", "left").join(ball, "structure_id", "left")
    document = F.struct(
        "num_balls", F.coalesce("contacts", F.array().cast("array<struct<id_a:bigint,id_b:bigint,area:double,arc_length:double,central:boolean>>")).alias("contacts"),
        F.coalesce("cells", F.array().cast("array<struct<index:bigint,sas_area:double,volume:double>>")).alias("cells"),
        F.transform("balls", lambda b: b["sas_area"]).alias("sas_areas"), F.transform("balls", lambda b: b["volume"]).alias("volumes"),
        "total_sas_area", "total_volume", "total_contact_area",
    )
    return rows.select("structure_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def json_pieces(t: Tessellation) -> DataFrame:
    """(structure_id, part, a, b, line, text): the documents of json_documents() in pieces, which make them up in the
    order of those columns. No row or group holds more than a contact, a cell or a ball."""
    t = t.kept()
    sid = F.col("structure_id")

    def items(df: DataFrame, part: int, key: list[str], names: list[str] | None) -> DataFrame:
        """One piece for each row, with a comma but on the first of its structure. names: of an object, else a value."""
        text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.regexp_extract(F.to_json(F.struct(F.col(df.columns[-1]).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1)
        columns = df.columns
        # Rows that are equal throughout are one piece of several items.
        df = df.groupBy(*columns).agg(F.count("*").alias("times"))
        order = F.struct(*key, *[c for c in columns if c not in (*key, "structure_id")])
        first = df.groupBy("structure_id").agg(F.min(order).alias("first"))
        rows = df.withColumn("order", order).join(first, "structure_id")
        text = F.concat(F.when(F.col("order") == F.col("first"), "").otherwise(","), text, F.repeat(F.concat(F.lit(","), text), F.col("times").cast("int") - 1))
        b = F.col(key[1]) if len(key) > 1 else F.lit(None).cast("long")
        return rows.select(sid, F.lit(part).alias("part"), F.col(key[0]).alias("a"), b.alias("b"), F.lit(0).alias("line"), text.alias("text"))

    contact, cell, ball = ["id_a", "id_b", "area", "arc_length", "central"], ["index", "sas_area", "volume"], t.per_ball
    total = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1)
    frame = {
        0: F.concat(F.lit('{"num_balls":'), F.col("num_balls").cast("string"), F.lit(',"contacts":[')), 2: F.lit('],"cells":['), 4: F.lit('],"sas_areas":['), 6: F.lit('],"volumes":['),
        8: F.concat(F.lit("]"), *[x for c in ("total_sas_area", "total_volume", "total_contact_area") for x in (F.lit(f',"{c}":'), total(c))], F.lit("}")),
    }
    nothing = F.lit(None).cast("long")
    frames = t.totals.select(sid, F.explode(F.array(*[F.struct(F.lit(k).alias("part"), nothing.alias("a"), nothing.alias("b"), F.lit(0).alias("line"), v.alias("text")) for k, v in frame.items()])).alias("f"))
    parts = [
        frames.select(sid, "f.*"), items(t.contacts.select("structure_id", *contact), 1, contact[:2], contact), items(t.cells.select("structure_id", *cell), 3, cell[:1], cell),
        items(ball.select("structure_id", "ball_id", "sas_area"), 5, ["ball_id"], None), items(ball.select("structure_id", "ball_id", "volume"), 7, ["ball_id"], None),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_pieces(pieces: DataFrame, folder: str, ranges: int | None = None) -> None:
    """Write json_pieces() or pymol_lines() of any size as text: a folder for each structure, whose files in the order
    of their names make up its document, a piece a line. Ranges of the order spread over tasks, so that
    no task holds a document; each writes its part and Spark commits all of them together."""
    order = ["structure_id", "part", "a", "b", "line"]
    dealt = pieces.repartitionByRange(*([ranges] if ranges else []), *order)
    dealt.sortWithinPartitions(*order).select("structure_id", "text").write.partitionBy("structure_id").text(folder)


def pymol_lines(t: Tessellation, angle_step: float = 0.5, name: str = "contacts") -> DataFrame:
    """(structure_id, part, a, b, line, text): the lines of a PyMOL script, in the order of those columns."""
    point = lambda p: F.format_string("    VERTEX, %.6f, %.6f, %.6f,", p["x"], p["y"], p["z"])
    sid = F.col("structure_id") if "structure_id" in t.balls.columns else F.lit(0).alias("structure_id")
    nothing = F.lit(None).cast("long")
    balls = t.balls.select(sid, F.lit(1).alias("part"), F.col("ball_id").alias("a"), nothing.alias("b"), F.array(F.format_string("    SPHERE, %.6f, %.6f, %.6f, %.6f,", "x", "y", "z", "r")).alias("lines"))
    face = t.faces(angle_step)
    n = F.col("normal")
    corners = F.transform("outer_points", point)
    fan = F.concat(
        F.array(F.lit("    BEGIN, TRIANGLE_FAN,"), F.format_string("    NORMAL, %.6f, %.6f, %.6f,", n["x"], n["y"], n["z"]), point(F.col("barycenter"))),
        corners, F.slice(corners, 1, 1), F.array(F.lit("    END,")),
    )
    loop = F.concat(F.array(F.lit("    BEGIN, LINE_LOOP,")), corners, F.array(F.lit("    END,")))
    fans = face.select("structure_id", F.lit(3).alias("part"), "a", "b", fan.alias("lines"))
    loops = face.select("structure_id", F.lit(5).alias("part"), "a", "b", loop.alias("lines"))
    fixed = {
        0: ["from pymol.cgo import *", "from pymol import cmd", "", "cgo_graphics_list_balls = [", "    COLOR, 0, 1, 1,"],
        2: ["]", f"cmd.load_cgo(cgo_graphics_list_balls, '{name}_balls')", "", "cgo_graphics_list_faces = [", "    COLOR, 1, 1, 0,"],
        4: ["]", f"cmd.load_cgo(cgo_graphics_list_faces, '{name}_faces')", "", "cgo_graphics_list_wireframe = [", "    COLOR, 1, 0, 0,"],
        6: ["]", f"cmd.load_cgo(cgo_graphics_list_wireframe, '{name}_wireframe')", "", "cmd.set('two_sided_lighting', 1)", "cmd.set('cgo_line_width', 1)"],
    }
    frame = F.array(*[F.struct(F.lit(k).alias("part"), F.array(*map(F.lit, v)).alias("lines")) for k, v in fixed.items()])
    frames = t.balls.select(sid).distinct().select("structure_id", F.explode(frame).alias("f")).select("structure_id", "f.part", nothing.alias("a"), nothing.alias("b"), "f.lines")
    rows = balls.unionByName(fans).unionByName(loops).unionByName(frames)
    return rows.select("structure_id", "part", "a", "b", F.posexplode("lines").alias("line", "text"))


def pymol_script(t: Tessellation, structure_id=0, **options) -> Iterator[str]:
    """The lines of one structure's script in order, partition by partition."""
    rows = pymol_lines(t, **options).where(F.col("structure_id") == F.lit(structure_id)).orderBy("part", "a", "b", "line")
    return (r["text"] for r in rows.toLocalIterator())


def result_dict(t: Tessellation, network: bool = False) -> dict:
    """One structure as plain Python values, for callers with small inputs."""
    rows = lambda df, *order: [{k: v for k, v in r.asDict().items() if k != "structure_id"} for r in df.orderBy(*order).collect()]
    t = t.kept(network)
    out = {k: v for k, v in (t.totals.first() or {"num_balls": 0}).asDict().items() if k.startswith(("num_balls", "total"))}
    out |= {"contacts": rows(t.contacts, "id_a", "id_b"), "cells": rows(t.cells, "index")}
    if network:
        out |= {"vertices": rows(t.vertices, "ball_indices"), "edges": rows(t.edges, "ball_indices")}
    return out
