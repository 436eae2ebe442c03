"""Contact areas: discs on radical planes, clipped by the planes of the other neighbours.

Each row of the neighbourhoods holds all that its contacts depend on, so construction needs no shuffle: Arrow
batches of spheres go to numpy, which takes all pairs of a batch through each step together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sphaera.functions.clipping import Spheres, contact_columns, first_columns, line_columns
from sphaera.functions.geometry import Vec, any_normal, circle_radius, distance, plane_offset
from sphaera.functions.search import in_parts
from sphaera.operators.overlap import Neighbourhoods

LINKS = "hidden boolean, links array<bigint>, around boolean"

CONTACT = (
    "b bigint, bimage int, h double, d double, ar double, br double, area double, arc_length double, central boolean, solid_angle_a double, "
    "solid_angle_b double, pyramid_volume_a double, pyramid_volume_b double"
)
#: What the cell of a ball sums over its contacts, each in two integers as exact_sum() has them.
SUMS = ("arc_length", "solid_plus", "solid_minus", "volume_plus", "volume_minus")
#: Ends of contacts that a task sums together.
ENDS = 1 << 17
BOUNDARY = (
    ", ".join(f"{n}{c} double" for n in ("u", "m", "e1", "e2") for c in "xyz")
    + ", disc_r double, pieces array<struct<c:bigint,dist:double,n1:double,n2:double,lo:double,hi:double,lo_c:bigint,hi_c:bigint>>, arcs array<struct<start:double,length:double>>"
)


def discs(found: DataFrame) -> DataFrame:
    """Pairs with the uncut disc of their contact: distance d, offset h of its centre m from a along u, radius
    disc_r, and the basis e1, e2 of its plane."""
    a, b = Vec.of("a"), Vec.of("b")
    rows = found.withColumn("d", distance(a, b)).withColumn("h", plane_offset(F.col("d"), F.col("ar"), F.col("br")))
    rows = rows.withColumn("disc_r", circle_radius(F.col("h"), F.col("ar"))).where("disc_r > 0 and d > 0")
    u = b.minus(a).over(F.col("d"))
    rows = rows.withColumns(dict(zip(("ux", "uy", "uz"), u)))
    u = Vec.of("u")
    m, e1 = a.plus(u.times(F.col("h"))), any_normal(u)
    rows = rows.withColumns({**dict(zip(("mx", "my", "mz"), m)), **dict(zip(("e1x", "e1y", "e1z"), e1))})
    return rows.withColumns(dict(zip(("e2x", "e2y", "e2z"), u.cross(Vec.of("e1")))))


def _constructed(near: Neighbourhoods, fields: str, columns: Callable, mark: bool, links: bool = False) -> DataFrame:
    """Rows (structure_id, a, fields) that ``columns`` gives for batches of spheres; with mark also one row
    (structure_id, a, nulls) for each sphere that has neighbours. With links, there is one for each sphere that overlaps any,
    with columns more: hidden, links, and whether it has neighbours (around)."""
    schema = T.StructType([near.schema["structure_id"], T.StructField("a", T.LongType()), *T._parse_datatype_string(fields + (f", {LINKS}" if links else "")).fields])
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    names = [f.name for f in arrow][2:]

    def run(batches):
        for batch in (part for whole in batches for part in in_parts(whole)):
            around = pc.greater(pc.list_value_length(batch.column("near")), 0)
            if mark:
                marked = batch if links else batch.filter(around)
                known = {"hidden": marked.column("hidden"), "links": marked.column("links"), "around": around} if links else {}
                yield pa.RecordBatch.from_arrays([marked.column("structure_id"), marked.column("a"), *[known.get(n, pa.nulls(len(marked), arrow.field(n).type)) for n in names]], schema=arrow)
            batch = batch.filter(around)
            own = [batch.column("structure_id"), batch.column("a")]
            for rows, values in columns(Spheres(batch)):
                at = pa.array(rows)
                new = [values.get(n, pa.nulls(len(at), arrow.field(n).type)) if n in ("hidden", "links", "around") else values[n] for n in names]
                new = [x if isinstance(x, pa.Array) else pa.array(x) for x in new]
                yield pa.RecordBatch.from_arrays([*[x.take(at) for x in own], *[x.cast(arrow.field(n).type) for x, n in zip(new, names)]], schema=arrow)

    return near.mapped(run, schema)


def lines(near: Neighbourhoods) -> DataFrame:
    """(structure_id, a, b, bimage, c, dist): the lines that cross the disc of a pair, from the radical plane of
    neighbour c, dist from the centre; negative where the centre is on its far side. Discs that are cut away
    as a whole have none."""
    return _constructed(near, "b bigint, bimage int, c bigint, dist double", line_columns, mark=False)


def boundaries(near: Neighbourhoods) -> DataFrame:
    """contacts_full() with the plane of each contact, the pieces of lines and the arcs that bound it."""
    return _constructed(near, f"{CONTACT}, {BOUNDARY}", lambda s: contact_columns(s, True), mark=False)


def measured(near: Neighbourhoods, network: bool = False, links: bool = False) -> DataFrame:
    """Each contact once, and before them a row without b for each sphere that has neighbours; with network, also what
    boundaries() has. With links, each sphere that overlaps any has such a row: whether it is hidden, the links to those,
    and whether it has neighbours (around)."""
    return _constructed(near, f"{CONTACT}, {BOUNDARY}" if network else CONTACT, lambda s: contact_columns(s, network), mark=True, links=links)


def first_contacts(near: Neighbourhoods, merge_inner: bool) -> DataFrame:
    """periodic.first_of_pair() of the contacts, chosen where they are made, so that none is shuffled. a is the lesser id."""
    return _constructed(near, CONTACT, lambda s: first_columns(s, merge_inner), mark=False)


def half_sums(near: Neighbourhoods) -> DataFrame:
    """(structure_id, ball_id, n_contacts, and whole and rest of each of SUMS), summed over the ends at each ball of the contacts that
    a task makes: a ball has few rows, where measured() has one for each contact. A sphere that only has neighbours has zeros."""
    fields = ["ball_id bigint", "n_contacts bigint", *[f"{n}_{part} bigint" for n in SUMS for part in ("whole", "rest")]]
    schema = T.StructType([near.schema["structure_id"], *T._parse_datatype_string(", ".join(fields)).fields])
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def summed(structures: list, ends: list) -> pa.RecordBatch:
        before = np.cumsum([0, *map(len, structures)])
        names = pa.chunked_array(structures).combine_chunks().dictionary_encode()
        rows = np.concatenate([at + n for (at, *_), n in zip(ends, before)])
        ball, values = (np.concatenate([e[i] for e in ends], axis=-1) for i in (1, 2))
        structure = names.indices.to_numpy()[rows]
        order = np.lexsort((ball, structure))
        structure, ball = structure[order], ball[order]
        first = np.flatnonzero((np.diff(structure, prepend=-1) != 0) | (np.diff(ball, prepend=ball[0]) != 0))
        columns = [names.dictionary.take(pa.array(structure[first])), ball[first], np.add.reduceat(values[0].astype(np.int64)[order], first)]
        _, arc, solid, volume = values
        for value in (arc, *(np.maximum(x, 0.0) for v in (solid, volume) for x in (v, -v))):
            scaled = value[order] * float(1 << 20)
            whole = np.floor(scaled)
            columns += [np.add.reduceat(x.astype(np.int64), first) for x in (whole, np.floor((scaled - whole) * float(1 << 28) + 0.5))]
        return pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches):
        structures, ends, size = [], [], 0
        for batch in (part for whole in batches for part in in_parts(whole)):
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("near")), 0))
            if not len(batch):
                continue
            own = batch.column("a").to_numpy()
            found = [(np.arange(len(batch)), own, np.zeros((4, len(batch))))]
            for rows, c in contact_columns(Spheres(batch), False):
                one = np.ones(len(rows))
                for end, ball in (("a", own[rows]), ("b", c["b"])):
                    found.append((rows, ball, np.stack((one, c["arc_length"], c[f"solid_angle_{end}"], c[f"pyramid_volume_{end}"]))))
            structures.append(batch.column("structure_id"))
            ends.append(tuple(np.concatenate([f[i] for f in found], axis=-1) for i in range(3)))
            size += len(ends[-1][0])
            if size >= ENDS:
                yield summed(structures, ends)
                structures, ends, size = [], [], 0
        if ends:
            yield summed(structures, ends)

    return near.mapped(run, schema)


def contacts_full(rows: DataFrame) -> DataFrame:
    """The contacts of measured(): area, arc length, centrality, and solid angles and signed pyramid volumes
    towards both centres. A contact is central if no line that bounds it separates it from the centre of its disc."""
    return rows.where(F.col("b").isNotNull())


def crowded(rows: DataFrame) -> DataFrame:
    """(structure_id, ball_id) of the spheres of measured() that have neighbours."""
    return rows.where(F.col("b").isNull()).select("structure_id", F.col("a").alias("ball_id"))

