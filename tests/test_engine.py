"""Selections, parsers, updates, streams, the command line, and every query against its SQL."""

import json
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sphaera import __main__ as cli
from sphaera.catalog import oracles, queries
from sphaera.functions import geometry as g
from sphaera.functions.selection import SelectionError, glob, parse_selection, parse_selections
from sphaera.operators.periodic import PeriodicBox
from sphaera.plans.incremental import UpdateableTessellation
from sphaera.plans.tessellation import tessellate
from sphaera.sources.radii import Radii
from sphaera.sources.sinks import json_documents
from sphaera.sources.structures import ParseOptions, balls_from, detect_format, detect_format_from_line, parse_mmcif, parse_pdb, parse_xyzr, read_lines, read_structures, with_radii
from sphaera.streaming.follow import follow
from tests.support import compare

SF = "/root/testdata/sf0.001"
LINE3 = [(0, 0, 0, 1), (2, 0, 0, 1), (4, 0, 0, 1)]


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_sql(spark, name):
    compare(spark, SF, name)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert queries.solvent(spark, SF).count() > 0 and queries.pymol(spark, SF).count() > 0
    document = json.loads(json_documents(queries.tess(spark, SF)).first()["json"])
    assert document["num_balls"] == len(document["sas_areas"]) == 204


ATOMS = [
    (0, "ATOM", "CA", "ALA", "A", 1), (1, "ATOM", "CB", "GLY", "B", 2), (2, "HETATM", "ZN", "ZN", "A", -5), (3, "ATOM", "C1'", "DA", "not", 9), (4, "ATOM", None, None, None, None),
]


@pytest.mark.parametrize(
    "text, want",
    [
        ("all", [0, 1, 2, 3, 4]), ("NOT none", [0, 1, 2, 3, 4]), ("chain A B", [0, 1, 2]), ("segid A and not hetero", [0]), ("name C*", [0, 1, 3]), ('name "C1\'"', [3]), ("resname [AG]L?", [0, 1]),
        ("resid 1 to 2", [0, 1]), ("resi -5 9", [2, 3]), ("resseq 1:9", [0, 1, 3]), ("nucleic or chain B", [1, 3]), ('chain "not"', [3]), ("name [a", []), ("not protein and not resid 9", [2, 4]),
        ("(chain A or chain B) and name CA CB", [0, 1]), ("chain A or chain B and name CB", [0, 1, 2]), ("backbone", [0]), ("sidechain", [1]),
    ],
)
def test_selections(spark, text, want):
    df = spark.createDataFrame(ATOMS, "ball_id long, record_name string, name string, res_name string, chain_id string, res_seq int")
    assert sorted(r["ball_id"] for r in df.where(parse_selection(text)).collect()) == want


@pytest.mark.parametrize("text", ["", "chain", "resid", "resid 1 to", "resid 5:", "(all", "all all", "and", "chain 1", "a && b", "!all", "name $", "not"])
def test_selection_errors(spark, text):
    with pytest.raises(SelectionError):
        parse_selection(text)


def test_selection_lists(spark):
    with pytest.raises(SelectionError, match="at least two"):
        parse_selections(["all"])
    with pytest.raises(SelectionError) as e:
        parse_selections(["all", "chain"])
    assert e.value.position == 1
    df = spark.createDataFrame([("a+b",), ("a]b",), ("A",)], "s string")
    assert df.where(glob(F.col("s"), "a+*")).count() == 1 and df.where(glob(F.col("s"), "a?b")).count() == 2


PDB = """HEADER    X
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00           N
ATOM      2  CA BALA A   1      11.639   6.071  -5.147  1.00  0.00           C
ATOM      3 1HB  ALA A   1      11.639   6.071  -5.147  1.00  0.00           H
ATOM      x  C   ALA A   1      11.639   6.071  -5.147
HETATM    4 ZN   ZN  A   2A      1.000   2.000   3.000  1.00 12.50          ZN
HETATM    5  O   HOH A   3       1.000   2.000   3.000
ENDMDL
ATOM      6  N   GLY A   1       1.000   6.134  -6.504  1.00  0.00           N
END
ATOM      7  N   GLY A   1       1.000   6.134  -6.504  1.00  0.00           N
"""
CIF = """data_X
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.auth_atom_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.pdbx_PDB_model_num
ATOM 1 N "C'" ALA A 1 1.0 2.0 3.0 1 # a comment
HETATM 2 'Z N' ZN ZN B 2 4.0 5.0 6.0 1
ATOM 3 N N ALA A . 1.0 2.0 3.0 1
ATOM 4 N N ALA A 4 7.0 2.0 3.0 2
loop_
_other.x
1 2
"""


def test_parsers(spark):
    text = lambda t: spark.createDataFrame([("f", t)], "structure_id string, content string")
    rows = parse_pdb(text(PDB)).orderBy("ball_id").collect()
    assert [(r["ball_id"], r["name"], r["chain_id"], r["i_code"], r["b_factor"]) for r in rows] == [(0, "N", "A", "", 0.0), (1, "ZN", "A", "A", 12.5)]
    rows = parse_pdb(text(PDB), ParseOptions(True, True, True)).orderBy("ball_id").collect()
    assert [(r["serial"], r["name"], r["chain_id"]) for r in rows] == [(1, "N", "A"), (3, "HB1", "A"), (6, "N", "A2")]
    rows = parse_mmcif(text(CIF)).orderBy("ball_id").collect()
    assert [(r["serial"], r["name"], r["res_seq"], r["x"]) for r in rows] == [(1, "C'", 1, 1.0), (2, "ZN", 2, 4.0)]
    assert [r["chain_id"] for r in parse_mmcif(text(CIF), ParseOptions(as_assembly=True)).orderBy("ball_id").collect()] == ["A", "B", "A2"]
    rows = parse_xyzr(text("a 1 2 3 4\r\n# no\n1 2 3\nx y 1 2 3\n 1e1\t.5 -2. +3 \n")).orderBy("ball_id").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 1.0, 2.0, 3.0, 4.0), (1, 10.0, 0.5, -2.0, 3.0)]
    for parse in (parse_pdb, parse_mmcif, parse_xyzr):
        assert parse(text("")).count() == 0 and parse(text(PDB).where("false")).count() == 0


def test_mixed_formats_and_lines(spark, tmp_path):
    for name, text in (("a.pdb", PDB), ("b.cif", CIF), ("c.xyzr", "0 0 0 1\n")):
        (tmp_path / name).write_text(text)
    path = lambda *names: [str(tmp_path / n) for n in names]
    both = read_structures(spark, path("a.pdb", "b.cif"))
    assert sorted((r["structure_id"].rsplit("/", 1)[-1], r["name"]) for r in both.collect()) == [("a.pdb", "N"), ("a.pdb", "ZN"), ("b.cif", "C'"), ("b.cif", "ZN")]
    with pytest.raises(ValueError, match="XYZR"):
        read_structures(spark, path("a.pdb", "c.xyzr"))
    assert read_lines(spark, PDB.splitlines(True)).count() == 2 and read_lines(spark, ["", "x 1 2 3 4"]).first()["r"] == 4.0
    with pytest.raises(ValueError):
        read_lines(spark, ["hello"])


def test_vectors(spark):
    row = spark.range(1)
    v = lambda *x: g.Vec(*map(F.lit, map(float, x)))
    o, x, y, z = v(0, 0, 0), v(1, 0, 0), v(0, 1, 0), v(0, 0, 1)
    turned = g.rotate(z, F.lit(math.pi / 2), x)
    got = row.select(
        g.triangle_area(o, x, v(0, 2, 5)), g.min_angle(o, x, v(-1, 1, 0)), g.directed_angle(o, x, y, z), g.directed_angle(o, y, x, z), *turned,
        g.signed_distance(v(0, 0, 2), v(0, 0, 3), v(7, 7, 3.5)), g.halfspace(o, z, v(1, 1, 1)), g.halfspace(o, z, v(1, 1, -1)), g.halfspace(o, z, x),
    ).first()
    assert list(got) == pytest.approx([math.sqrt(29) / 2, 3 * math.pi / 4, math.pi / 2, 3 * math.pi / 2, 0, 1, 0, 1.5, 1, -1, 0])


def test_formats():
    assert [detect_format(p) for p in ("a.PDB", "b.ent", "c.pdb1", "d.cif", "e.mmCIF", "f.xyzr", "g", "h.txt", "/x.pdb/y")] == ["pdb", "pdb", "pdb", "mmcif", "mmcif", "xyzr", None, None, None]
    assert [detect_format_from_line(x) for x in ("data_1", "loop_", "ATOM  ", "A 1 2 3 4")] == ["mmcif", "mmcif", "pdb", "xyzr"]
    with pytest.raises(ValueError):
        detect_format_from_line("hello")


def test_radii(spark):
    df = spark.createDataFrame([("ALA", "CB"), ("ALA", "CG"), ("ARG", "NE1"), ("XXX", "CL1"), ("XXX", "Q"), ("HEM", "FE"), ("XXX", ""), ("CA", "CA")], "res_name string, name string")
    assert [r["r"] for r in with_radii(df).collect()] == [1.92, 1.8, 1.62, 1.81, 1.8, 1.33, 1.8, 1.0]
    custom = Radii.empty().with_text("# x\nALA * 3.0\n* Q* 2.5\n")
    assert [r["r"] for r in with_radii(df, custom).collect()] == [3.0, 3.0, 1.8, 1.8, 2.5, 1.8, 1.8, 1.8]
    for bad in ("ALA CB", "ALA CB x", "ALA CB -1"):
        with pytest.raises(ValueError):
            Radii().with_text(bad)


def test_inputs(spark):
    assert balls_from(spark, [{"x": 1, "y": 2, "z": 3, "r": 4}]).first()["r"] == 4
    for bad, error in (([(1, 2, 3)], ValueError), ([5], TypeError), ([{"x": 1}], KeyError)):
        with pytest.raises(error):
            balls_from(spark, bad)
    assert PeriodicBox.from_dict({"corners": [(0, 0, 0), (1, 2, 3)]}) == PeriodicBox.from_dict({"vectors": [(1, 0, 0), (0, 2, 0), (0, 0, 3)]})
    for bad in ({}, {"corners": [(0, 0, 0)]}, {"vectors": [(1, 0), (0, 1), (0, 0)]}):
        with pytest.raises(ValueError):
            PeriodicBox.from_dict(bad)


def table(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


def same(t, full):
    a, b = table(t.contacts, "id_a", "id_b"), table(full.contacts, "id_a", "id_b")
    assert a.keys() == b.keys() and all(a[k]["area"] == pytest.approx(b[k]["area"], abs=1e-9) for k in a)
    a, b = table(t.cells, "index"), table(full.cells, "index")
    assert a.keys() == b.keys() and all(a[k]["sas_area"] == pytest.approx(b[k]["sas_area"], abs=1e-9) for k in a)


@pytest.mark.parametrize("box", [None, PeriodicBox.from_corners((0, 0, 0), (40, 8, 8))])
def test_updates_equal_full_computations(spark, box):
    rows = [(1.6 * i % 40, 1.1 * (i % 3), 0.9 * (i % 4), 1.0 + 0.1 * (i % 3)) for i in range(25)]
    t = UpdateableTessellation(with_backup=True)
    assert t.init(balls_from(spark, rows), 0.7, box)
    rows[3] = (rows[3][0] + 0.4, *rows[3][1:])
    before = table(t.contacts, "id_a", "id_b")
    assert t.update(balls_from(spark, rows)) and not t.last_update_was_full_reinit
    assert [r["ball_id"] for r in t.changed.collect()] == [3]
    same(t, tessellate(balls_from(spark, rows), 0.7, box))
    assert not t.update(balls_from(spark, rows))
    assert t.restore() and not t.restore()
    assert t.update(balls_from(spark, rows[:20])) and t.last_update_was_full_reinit
    assert t.restore() and before.keys() >= set()
    same(t, tessellate(balls_from(spark, rows), 0.7, box))


def test_exclusion(spark):
    t = UpdateableTessellation(with_backup=True)
    t.init(balls_from(spark, LINE3), 0.5)
    sizes = lambda: (t.contacts.count(), t.cells.count())
    assert sizes() == (2, 3)
    assert t.set_exclusion(1) and sizes() == (0, 2) and not t.set_exclusion(1)
    assert t.set_exclusion(1, False) and sizes() == (2, 3)
    t.set_exclusion(1)
    assert [r["ball_id"] for r in t.excluded.collect()] == [1] and t.collisions.first()["collisions"] == 2
    assert sorted(r["ball_id"] for r in t.colliding(1).collect()) == [0, 2]
    assert t.restore() and sizes() == (2, 3) and t.contacts_for(1).count() == 2


def test_many_changes_start_over(spark):
    rows = [(2.0 * i, 0, 0, 1) for i in range(20)]
    t = UpdateableTessellation()
    t.init(balls_from(spark, rows), 0.5)
    t.update(balls_from(spark, [(x + 0.1 * (i < 11), *r) for i, (x, *r) in enumerate(rows)]))
    assert t.last_update_was_full_reinit and not t.restore()


def test_stream(spark, tmp_path):
    t = UpdateableTessellation()
    t.init(balls_from(spark, LINE3), 0.5)
    schema = "structure_id int, ball_id long, x double, y double, z double, r double"
    spark.createDataFrame([(0, 1, 20.0, 0.0, 0.0, 1.0)], schema).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = follow(stream, t, lambda x, n: seen.append(x.contacts.count()), checkpointLocation=str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert seen == [0]


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "a.xyzr"
    path.write_text("0 0 0 1\n0.5 0 0 1\n1 0 0 1\n")
    assert cli.main([str(path), "--probe", "1.0", "--pymol", str(tmp_path / "a.py"), "-q"]) == 0
    document = json.loads(capsys.readouterr().out)
    assert len(document["contacts"]) == 2 and (tmp_path / "a.py").read_text().count("TRIANGLE_FAN") == 2
    cli.main([str(path), "--output", str(tmp_path / "out"), "--periodic-box-corners", "0", "0", "0", "20", "20", "20", "-q"])
    assert list((tmp_path / "out").glob("part-*"))
    with pytest.raises(SystemExit):
        cli.main([str(path), "--inter-chain", "-q"])
