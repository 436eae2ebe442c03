"""Queries by name, each over whole tables.

The tables hold no geometry, so balls and atoms are derived from ``part``: structures of 500 balls at
pseudo-random places, every fiftieth of which has a smaller one inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.functions import geometry as g
from sphaera.functions.icosahedron import sphere_points
from sphaera.functions.selection import parse_selection
from sphaera.operators import contacts as contact_ops
from sphaera.operators import overlap
from sphaera.operators.groups import chain_groups, residue_groups, selection_groups
from sphaera.operators.periodic import PeriodicBox, images
from sphaera.plans.incremental import UpdateableTessellation
from sphaera.plans.solvent import sample_points, solvent_spheres
from sphaera.plans.tessellation import Tessellation, tessellate
from sphaera.sources.radii import Radii
from sphaera.sources.sinks import json_documents, pymol_lines
from sphaera.sources.structures import ParseOptions, parse_mmcif, parse_pdb, parse_xyzr, with_radii

PROBE = 1.4
PLACES = 4
BOX = PeriodicBox.from_corners((0, 0, 0), (20, 20, 20))
SKEW = PeriodicBox.from_vectors((20, 0, 0), (5, 19, 0), (-4, 3, 21))
SELECTIONS = ["resname ALA and backbone", "chain A and not hetatm", "resid 10 to 40 or name \"C*\""]


def balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey").cast("long")
    base = part.select(
        F.floor(key / 500).cast("long").alias("structure_id"), (key % 500).alias("ball_id"),
        *[((key * F.lit(m) % F.lit(n)).cast("double") / F.lit(50.0)).alias(c) for c, m, n in (("x", 7919, 997), ("y", 104729, 991), ("z", 1299709, 983))],
        (F.lit(1.2) + (F.col("p_size") % 10).cast("double") / F.lit(10.0)).alias("r"),
    )
    inner = base.where("ball_id % 50 = 0").select("structure_id", (F.col("ball_id") + 500).alias("ball_id"), (F.col("x") + 0.1).alias("x"), "y", "z", (F.col("r") * F.lit(0.3)).alias("r"))
    return base.unionByName(inner)


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """balls in groups of ten neighbouring ids."""
    return balls(spark, sf_dir).withColumn("grp", F.floor(F.col("ball_id") / 10))


def tess(spark: SparkSession, sf_dir: str) -> Tessellation:
    return tessellate(balls(spark, sf_dir), PROBE)


def _sid(df: DataFrame) -> DataFrame:
    return df.withColumn("structure_id", F.col("structure_id").cast("long"))


def _rounded(df: DataFrame, *names: str, places: int = PLACES) -> DataFrame:
    return df.withColumns({n: g.rounded(F.col(n), places) for n in names})


def overlap_pairs(spark, sf_dir):
    t = tess(spark, sf_dir)
    rows = t.overlaps.withColumn("d", F.sqrt(overlap.squared()))
    return _rounded(rows.select("structure_id", "a", "b", "d"), "d")


def hidden_balls(spark, sf_dir):
    return overlap.hidden(tess(spark, sf_dir).overlaps).select("structure_id", "ball_id")


def neighbour_lists(spark, sf_dir):
    rows = tess(spark, sf_dir).neighbours.select("structure_id", F.col("a").alias("ball_id"), F.explode("near").alias("n"))
    rows = rows.select("structure_id", "ball_id", F.col("n.b").alias("neighbour"), F.col("n.h").alias("offset"))
    return _rounded(rows, "offset")


def pair_groups(spark, sf_dir):
    t = tessellate(grouped(spark, sf_dir), PROBE)
    return overlap.pairs(t.neighbours).select("structure_id", "a", "b")


def contact_discs(spark, sf_dir):
    rows = contact_ops.discs(overlap.pairs(tess(spark, sf_dir).neighbours))
    area = (F.lit(g.PI) * F.col("disc_r") * F.col("disc_r")).alias("uncut_area")
    return _rounded(rows.select("structure_id", "a", "b", F.col("h").alias("offset"), F.col("disc_r").alias("radius"), area), "offset", "radius", "uncut_area")


def clip_lines(spark, sf_dir):
    return _rounded(contact_ops.lines(tess(spark, sf_dir).neighbourhoods).select("structure_id", "a", "b", "c", "dist"), "dist")


def contacts_area_arc(spark, sf_dir):
    rows = tess(spark, sf_dir).contacts_only
    return _rounded(rows.select("structure_id", "id_a", "id_b", "area", "arc_length"), "area", "arc_length")


def contact_central(spark, sf_dir):
    return tess(spark, sf_dir).contacts_only.select("structure_id", "id_a", "id_b", "central")


def contacts_full(spark, sf_dir):
    rows = tess(spark, sf_dir).contacts_full.select(
        "structure_id", "a", "b", "d", "area", "arc_length", "solid_angle_a", "solid_angle_b", "pyramid_volume_a", "pyramid_volume_b"
    )
    return _rounded(rows, *rows.columns[3:])


def grouped_contacts(spark, sf_dir):
    rows = tessellate(grouped(spark, sf_dir), PROBE).contacts
    return _rounded(rows.select("structure_id", "id_a", "id_b", "area"), "area")


def cells(spark, sf_dir):
    return _rounded(tess(spark, sf_dir).cells, "sas_area", "volume", places=3)


def totals(spark, sf_dir):
    return _rounded(tess(spark, sf_dir).totals, "total_sas_area", "total_volume", "total_contact_area", places=2)


def per_ball(spark, sf_dir):
    rows = tess(spark, sf_dir).per_ball.select("structure_id", "ball_id", "sas_area", "volume")
    return _rounded(rows, "sas_area", "volume", places=3)


def _named_balls(n: int) -> list:
    """The balls of an edge or vertex; -1 for the surface."""
    return [F.coalesce(F.get("ball_indices", i), F.lit(-1)).alias(f"ball_{i}") for i in range(n)]


def network_edges(spark, sf_dir):
    rows = tess(spark, sf_dir).edges
    return _rounded(rows.select("structure_id", *_named_balls(3), "is_on_sas", "length"), "length")


def network_vertices(spark, sf_dir):
    rows = tess(spark, sf_dir).vertices
    return _rounded(rows.select("structure_id", *_named_balls(4), "is_on_sas", "x", "y", "z"), "x", "y", "z", places=2)


def periodic_images(spark, sf_dir):
    rows = images(overlap.spheres_of(balls(spark, sf_dir), PROBE), BOX).select("structure_id", "ball_id", F.col("image").cast("long").alias("image"), "x", "y", "z")
    return _rounded(rows, "x", "y", "z")


def periodic_overlaps(spark, sf_dir):
    t = tessellate(balls(spark, sf_dir), PROBE, BOX)
    return t.overlaps.select("structure_id", "a", "b", F.col("bimage").cast("long").alias("image"))


def periodic_contacts(spark, sf_dir):
    rows = tessellate(balls(spark, sf_dir), PROBE, BOX).contacts
    return _rounded(rows.select("structure_id", "id_a", "id_b", "area"), "area")


def periodic_contacts_only(spark, sf_dir):
    rows = tessellate(balls(spark, sf_dir), PROBE, BOX).contacts_only
    return _rounded(rows.select("structure_id", "id_a", "id_b", "area"), "area")


def periodic_cells(spark, sf_dir):
    return _rounded(tessellate(balls(spark, sf_dir), PROBE, BOX).cells, "sas_area", "volume", places=3)


def skew_overlaps(spark, sf_dir):
    t = tessellate(balls(spark, sf_dir), PROBE, SKEW)
    return t.overlaps.select("structure_id", "a", "b", F.col("bimage").cast("long").alias("image"))


def skew_contacts(spark, sf_dir):
    rows = tessellate(balls(spark, sf_dir), PROBE, SKEW).contacts
    return _rounded(rows.select("structure_id", "id_a", "id_b", "area"), "area")


def uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """balls of which every hundredth is up to twenty times as large, and some are a tenth as large."""
    size = F.when(F.col("ball_id") % 100 == 13, F.col("r") * (F.lit(2.0) + F.col("ball_id") % 19)).when(F.col("ball_id") % 10 == 4, F.col("r") * F.lit(0.1)).otherwise(F.col("r"))
    return balls(spark, sf_dir).withColumn("r", size)


def uneven_overlaps(spark, sf_dir):
    rows = tessellate(uneven(spark, sf_dir), PROBE).overlaps.withColumn("d", F.sqrt(overlap.squared()))
    return _rounded(rows.select("structure_id", "a", "b", "d"), "d")


# Atoms


ATOM_NAMES = ("N", "CA", "C", "O", "CB", "CG1", "1HB", "OD1", "SG", "ZN")
RESIDUES = ("ALA", "GLY", "HIS", "ASP", "LYS", "SER", "PHE", "DA", "HOH", "ZN", "CYX")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom records: a structure has 500 of them, in residues of ten and chains of a hundred."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey").cast("long")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    n = key % 500
    res = F.floor(n / 10)
    place = [((key * F.lit(m) % F.lit(k)).cast("double") / F.lit(50.0)).alias(c) for c, m, k in (("x", 7919, 997), ("y", 104729, 991), ("z", 1299709, 983))]
    return part.select(
        F.floor(key / 500).cast("long").alias("structure_id"), n.alias("ball_id"), F.when(res % 11 == 9, "HETATM").otherwise("ATOM").alias("record_name"),
        pick(ATOM_NAMES, n).alias("name"), pick(RESIDUES, res).alias("res_name"), F.chr(F.lit(65) + F.floor(n / 100).cast("int")).alias("chain_id"),
        (res + 1).cast("int").alias("res_seq"), F.when(res % 7 == 0, "B").otherwise("").alias("i_code"), *place,
    )


def group_chain(spark, sf_dir):
    return chain_groups(atoms(spark, sf_dir)).select("structure_id", "ball_id", "grp")


def group_residue(spark, sf_dir):
    return residue_groups(atoms(spark, sf_dir)).select("structure_id", "ball_id", "grp")


def group_selection(spark, sf_dir):
    return selection_groups(atoms(spark, sf_dir), SELECTIONS).select("structure_id", "ball_id", "grp")


SELECTION_QUERIES = {
    "sel_protein": "protein", "sel_backbone": "backbone", "sel_sidechain": "sidechain", "sel_nucleic": "nucleicacid", "sel_hetatm": "hetero", "sel_charged": "charged",
    "sel_hydrophobic": "hydrophobic", "sel_aromatic": "aromatic", "sel_acidic": "acidic", "sel_basic": "basic", "sel_polar": "polar", "sel_all": "all", "sel_none": "none",
    "sel_glob": "name \"C*\" '[NO]?*' and resname ?Y? [A-D]*", "sel_resid": "resid 3 to 9 20:25 44", "sel_bool": "not (chain A B or resname ALA) and name CA or hetatm",
}


def _selection(text):
    def query(spark, sf_dir):
        return atoms(spark, sf_dir).where(parse_selection(text)).select("structure_id", "ball_id")

    return query


def radii_lookup(spark, sf_dir):
    rows = atoms(spark, sf_dir)
    return rows.select("structure_id", "ball_id", Radii().column(F.col("res_name"), F.col("name")).alias("radius"))


def _file(rows: DataFrame, line) -> DataFrame:
    """One text a structure, its lines in the order of the balls."""
    text = rows.select("structure_id", F.struct("ball_id", line.alias("line")).alias("l")).groupBy("structure_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return text.select("structure_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"))


def xyzr_parse(spark, sf_dir):
    rows = balls(spark, sf_dir)
    line = F.when(F.col("ball_id") % 7 == 3, F.lit("# not a ball")).otherwise(F.format_string("A %d %.3f\t%.3f %.3f  %.3f", "ball_id", "x", "y", "z", "r"))
    return _rounded(parse_xyzr(_file(rows, line)), "x", "y", "z", "r", places=3)


def pdb_parse(spark, sf_dir):
    line = _pdb_line(F.col("ball_id") + 1)
    rows = parse_pdb(_file(atoms(spark, sf_dir), line), ParseOptions(exclude_heteroatoms=True))
    return _rounded(rows.select("structure_id", "ball_id", "serial", "name", "res_name", "chain_id", "res_seq", "i_code", "x", "y", "z"), "x", "y", "z", places=3)


def mmcif_parse(spark, sf_dir):
    fields = ["group_PDB", "id", "label_atom_id", "label_alt_id", "auth_comp_id", "auth_asym_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "type_symbol"]
    head = "data_x\nloop_\n" + "".join(f"_atom_site.{f}\n" for f in fields)
    line = F.format_string("%s %d '%s' . %s %s %d %s %.3f %.3f %.3f ?", "record_name", F.col("ball_id") + 1, "name", "res_name", "chain_id", "res_seq", F.when(F.col("i_code") == "", "?").otherwise(F.col("i_code")), "x", "y", "z")
    texts = _file(atoms(spark, sf_dir), line).withColumn("content", F.concat(F.lit(head), "content", F.lit("\n#\nloop_\n_other.a\n1\n")))
    rows = parse_mmcif(texts, ParseOptions(exclude_heteroatoms=True))
    return _rounded(_sid(rows.select("structure_id", "ball_id", "serial", "name", "res_name", "chain_id", "res_seq", "i_code", "x", "y", "z")), "x", "y", "z", places=3)


def _pdb_line(serial) -> Column:
    return F.concat(
        F.rpad("record_name", 6, " "), F.lpad(serial.cast("string"), 5, " "), F.lit(" "), F.rpad("name", 4, " "), F.lit(" "), F.lpad("res_name", 3, " "), F.lit(" "),
        F.col("chain_id"), F.lpad(F.col("res_seq").cast("string"), 4, " "), F.rpad("i_code", 1, " "), F.lit("   "), *[F.format_string("%8.3f", c) for c in "xyz"],
    )


def pdb_assembly(spark, sf_dir):
    """Files of two models read as an assembly; those whose number is even end after the first."""
    ends = F.when(F.col("ball_id") % 250 == 249, F.when(F.col("structure_id") % 2 == 0, F.lit("\nENDMDL\nEND")).otherwise(F.lit("\nENDMDL"))).otherwise("")
    rows = parse_pdb(_file(atoms(spark, sf_dir), F.concat(_pdb_line(F.col("ball_id") + 1), ends)), ParseOptions(as_assembly=True, include_hydrogens=True))
    return rows.select("structure_id", "ball_id", "serial", "name", "res_name", "chain_id")


def pdb_first_model(spark, sf_dir):
    ends = F.when(F.col("ball_id") % 250 == 249, F.lit("\nENDMDL")).otherwise("")
    rows = parse_pdb(_file(atoms(spark, sf_dir), F.concat(_pdb_line(F.col("ball_id") + 1), ends)), ParseOptions(include_hydrogens=True))
    return rows.select("structure_id", "ball_id", "serial", "name", "res_name", "chain_id")


def _models(spark, sf_dir, as_assembly: bool):
    """mmCIF files of up to five models, whose columns come in another order and with label names only."""
    fields = ["pdbx_PDB_model_num", "Cartn_z", "Cartn_y", "Cartn_x", "label_seq_id", "label_asym_id", "label_comp_id", "label_atom_id", "id", "group_PDB"]
    head = "data_x\n_entry.id 'a b'\nloop_\n" + "".join(f"_atom_site.{f}\n" for f in fields)
    line = F.format_string('%d %.3f %.3f %.3f %d %s\n%s "%s" %d %s', F.floor(F.col("ball_id") / 100) + 1, "z", "y", "x", "res_seq", "chain_id", "res_name", "name", F.col("ball_id") + 1, "record_name")
    texts = _file(atoms(spark, sf_dir), line).withColumn("content", F.concat(F.lit(head), "content", F.lit("\n# end\n")))
    rows = parse_mmcif(texts, ParseOptions(as_assembly=as_assembly, include_hydrogens=True))
    return _sid(rows.select("structure_id", "ball_id", "serial", "name", "res_name", "chain_id", "res_seq"))


def mmcif_first_model(spark, sf_dir):
    return _models(spark, sf_dir, False)


def mmcif_assembly(spark, sf_dir):
    return _models(spark, sf_dir, True)


def selected_contacts(spark, sf_dir):
    """Contacts between selections of parsed atoms, with radii from the rules."""
    rows = selection_groups(with_radii(atoms(spark, sf_dir)), SELECTIONS)
    return _rounded(tessellate(rows, PROBE).contacts.select("structure_id", "id_a", "id_b", "area"), "area")


# Whole plans


def icosahedron_points(spark, sf_dir):
    """The corners of an icosahedron on each ball."""
    points = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(c) for c, v in zip("xyz", p)]) for k, p in enumerate(sphere_points(0))])
    rows = balls(spark, sf_dir).select("structure_id", "ball_id", "x", "y", "z", "r", F.explode(points).alias("p"))
    rows = rows.select("structure_id", "ball_id", *[(F.col(c) + F.col(f"p.{c}") * F.col("r")).alias(c) for c in "xyz"])
    return _rounded(rows, "x", "y", "z")


def solvent(spark, sf_dir):
    """Solvent at the default depth, 162 points around each ball."""
    return _rounded(solvent_spheres(balls(spark, sf_dir), PROBE), "x", "y", "z", "weight", places=3)


def solvent_corners(spark, sf_dir):
    """Solvent at depth 0, which SQL can follow with its weights."""
    return _rounded(solvent_spheres(balls(spark, sf_dir), PROBE, depth=0), "x", "y", "z", "weight", places=3)


def solvent_points(spark, sf_dir):
    """Where solvent goes at the default depth."""
    t = tess(spark, sf_dir).kept()
    return _rounded(sample_points(t.balls, t.contacts, t.cells, PROBE).drop("k"), "x", "y", "z")


def json_document(spark, sf_dir):
    """What the JSON documents say, read back from their text: one row a structure."""
    schema = (
        "num_balls long, contacts array<struct<area:double,arc_length:double,central:boolean>>, cells array<struct<sas_area:double,volume:double>>, "
        "sas_areas array<double>, volumes array<double>"
    )
    rows = json_documents(tess(spark, sf_dir)).select("structure_id", F.from_json("json", schema).alias("d"))
    total = lambda c, of=lambda x: x: F.aggregate(c, F.lit(0.0), lambda s, x: s + F.coalesce(of(x), F.lit(0.0)))
    rows = rows.select(
        "structure_id", "d.num_balls", F.size("d.contacts").cast("long").alias("num_contacts"), F.size(F.filter("d.contacts", lambda c: c["central"])).cast("long").alias("num_central"),
        F.size("d.cells").cast("long").alias("num_cells"), F.size(F.filter("d.sas_areas", lambda x: x.isNull())).cast("long").alias("num_without"),
        total(F.col("d.contacts"), lambda c: c["area"]).alias("contact_area"), total(F.col("d.contacts"), lambda c: c["arc_length"]).alias("arc_length"),
        total(F.col("d.sas_areas")).alias("sas_area"), total(F.col("d.cells"), lambda c: c["volume"]).alias("volume"),
    )
    return _rounded(rows, *rows.columns[6:], places=2)


def face_polygons(spark, sf_dir):
    """The polygon of each face: its corners, and the area and length of boundary that they enclose."""
    rows = tess(spark, sf_dir).faces()
    vec = lambda p: g.Vec(p["x"], p["y"], p["z"])
    middle, normal = vec(F.col("barycenter")), vec(F.col("normal"))
    n = F.size("outer_points")
    rows = rows.withColumn("edges", F.arrays_zip(F.col("outer_points").alias("p"), F.concat(F.slice("outer_points", F.lit(2), n - 1), F.slice("outer_points", 1, 1)).alias("q")))
    total = lambda f: F.aggregate("edges", F.lit(0.0), lambda s, e: s + f(vec(e["p"]), vec(e["q"])))
    area = total(lambda p, q: p.minus(middle).cross(q.minus(middle)).dot(normal)) / 2.0
    rows = rows.select("structure_id", "a", "b", n.cast("long").alias("points"), area.alias("area"), total(g.distance).alias("boundary"))
    return _rounded(rows, "area", "boundary")


def pymol(spark, sf_dir):
    return pymol_lines(tess(spark, sf_dir))


def moved(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", F.when(F.col("ball_id") % 100 == 7, F.col("x") + 0.5).otherwise(F.col("x")))


def incremental_update(spark, sf_dir):
    """Contacts after some balls moved, which equal those of a full computation."""
    t = UpdateableTessellation()
    t.init(balls(spark, sf_dir), PROBE)
    t.update(moved(balls(spark, sf_dir)))
    return _rounded(t.contacts.select("structure_id", "id_a", "id_b", "area"), "area")


def incremental_cells(spark, sf_dir):
    """Cells after some balls moved: those of a full computation, but that hidden balls have none, and balls that the
    update reached and left with neighbours but without a contact have a whole one."""
    t = UpdateableTessellation()
    t.init(balls(spark, sf_dir), PROBE)
    t.update(moved(balls(spark, sf_dir)))
    return _rounded(t.cells.select("structure_id", "index", "sas_area", "volume"), "sas_area", "volume", places=3)


def exclusion(spark, sf_dir):
    t = UpdateableTessellation(with_backup=True)
    t.init(balls(spark, sf_dir), PROBE)
    t.set_exclusion(5)
    return _rounded(t.contacts.select("structure_id", "id_a", "id_b", "area"), "area")


def restore(spark, sf_dir):
    t = UpdateableTessellation(with_backup=True)
    t.init(balls(spark, sf_dir), PROBE)
    t.update(moved(balls(spark, sf_dir)))
    t.restore()
    return _rounded(t.contacts.select("structure_id", "id_a", "id_b", "area"), "area")


QUERIES = {
    f.__name__: f
    for f in (
        overlap_pairs, hidden_balls, neighbour_lists, pair_groups, contact_discs, clip_lines, contacts_area_arc, contact_central, contacts_full, grouped_contacts, cells, totals,
        per_ball, network_edges, network_vertices, periodic_images, periodic_overlaps, periodic_contacts, periodic_contacts_only, group_chain, group_residue, group_selection,
        radii_lookup, xyzr_parse, pdb_parse, mmcif_parse, icosahedron_points, solvent, solvent_corners, solvent_points, json_document, pymol, incremental_update, exclusion, restore,
        periodic_cells, skew_overlaps, skew_contacts, uneven_overlaps, pdb_assembly, pdb_first_model, mmcif_first_model, mmcif_assembly, selected_contacts, incremental_cells, face_polygons,
    )
} | {name: _selection(text) for name, text in SELECTION_QUERIES.items()}
