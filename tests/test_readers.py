"""Structure files in many byte ranges: the same atoms as from the whole text."""

import random

import pytest

from sphaera.sources import structures
from sphaera.sources.structures import ParseOptions, file_lines, may_split, mmcif_atoms, parse_mmcif, parse_pdb, parse_xyzr, pdb_atoms, read_structures, xyzr_balls

NAMES = ("N", "CA", "C", "O", "1HB", "O5'", "OD1", "H")
HEAD = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "auth_asym_id", "pdbx_PDB_model_num"]


@pytest.fixture
def ranges(spark):
    """Byte ranges of 700 bytes: ends of lines, rows and headers come to lie everywhere."""
    keys = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "300b"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def pdb_text(rng, models, end=None):
    lines, serial = ["HEADER    TEST", "REMARK   1"], 0
    for m in range(models):
        lines.append(f"MODEL     {m + 1:4d}")
        for i in range(rng.randrange(20, 60)):
            serial += 1
            name, kind, alt = rng.choice([n for n in NAMES if "'" not in n]), rng.choice(["ATOM", "HETATM"]), rng.choice(["", "", "A", "B"])
            res = rng.choice(["ALA", "GLY", "HOH"])
            lines.append(f"{kind:<6}{serial:5d} {name:<4}{alt:1}{res:>3} {rng.choice('AB')}{i // 8 + 1:4d}    {rng.uniform(-9, 9):8.3f}{rng.uniform(-9, 9):8.3f}{rng.uniform(-9, 9):8.3f}  1.00 10.00")
        lines.append("ENDMDL")
        if end == m:
            lines.append("END")
    return "\n".join(lines) + "\n"


def cif_text(rng, models):
    """Two loops of atoms with other columns between other loops; rows of several lines, quotes, comments."""
    lines = ["data_x", "_entry.id X", "# comment", "loop_", "_other.a", "_other.b", "1 '2 3'", "4 loop"]
    serial = 0
    for head in (HEAD, HEAD[::-1]):
        lines += ["#", "loop_", *[f"_atom_site.{h}" for h in head]]
        for m in models:
            for i in range(rng.randrange(15, 40)):
                serial += 1
                name = rng.choice(NAMES)
                row = dict(zip(HEAD, [rng.choice(["ATOM", "HETATM"]), serial, name[0] if name[0] != "1" else "H", f'"{name}"' if "'" in name else name, rng.choice([".", "A", "B"]), rng.choice(["ALA", "DA", "HOH"]), "A", i // 8 + 1, "?",
                                       *[f"{rng.uniform(-9, 9):.3f}" for _ in range(3)], rng.choice(["A", "'B C'"]), m]))
                values = [str(row[h]) for h in head]
                cut = rng.randrange(1, 13) if rng.random() < 0.2 else None
                lines += [" ".join(values[:cut]), *([" ".join(values[cut:])] if cut else [])]
                if rng.random() < 0.05:
                    lines.append("# a comment between rows")
        lines += ["_single.value 'a _b c'", "loop_", "_more.x", "'loop_' _y"]
    return "\n".join(lines) + "\n"


def rows(df, structures):
    out = {}
    for r in df.collect():
        out.setdefault(str(r["structure_id"]).rsplit("/", 1)[-1], []).append(tuple(r)[1:])
    assert all(sorted(x[0] for x in v) == list(range(len(v))) for v in out.values())
    return {k: sorted(v) for k, v in out.items()}


def written(tmp_path, texts):
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def whole(spark, texts):
    return spark.createDataFrame(list(texts.items()), "structure_id string, content string")


@pytest.mark.parametrize("assembly", [False, True])
def test_pdb_in_ranges(spark, tmp_path, ranges, assembly):
    rng = random.Random(1)
    texts = {f"{i}.pdb": pdb_text(rng, m, end) for i, (m, end) in enumerate([(1, None), (4, None), (6, 2), (3, 0), (0, None)])}
    folder, options = written(tmp_path, texts), ParseOptions(as_assembly=assembly, include_hydrogens=assembly)
    lines = file_lines(spark, folder)
    assert lines.select("structure_id", "part").distinct().count() > 12 and may_split(spark, folder)
    got, want = rows(pdb_atoms(lines, True, options), texts), rows(parse_pdb(whole(spark, texts), options), texts)
    assert got == want and len(want) == 4
    if assembly:
        assert {r[6] for r in want["1.pdb"]} >= {"A", "A2", "A4"} and max(int(r[6][1:] or 1) for r in want["2.pdb"]) == 3


@pytest.mark.parametrize("assembly", [False, True])
def test_mmcif_in_ranges(spark, tmp_path, ranges, assembly):
    rng = random.Random(2)
    texts = {f"{i}.cif": cif_text(rng, m) for i, m in enumerate([["1"], ["1", "2", "3"], ["7", "1"], [], ["?"]])}
    folder, options = written(tmp_path, texts), ParseOptions(as_assembly=assembly, include_hydrogens=True)
    lines = file_lines(spark, folder)
    assert lines.where("split").select("structure_id", "part").distinct().count() > 20
    got, want = rows(mmcif_atoms(lines, True, options), texts), rows(parse_mmcif(whole(spark, texts), options), texts)
    assert got == want and len(want) == 4
    assert {r[6] for r in want["0.cif"]} == {"A", "B C"}
    models = lambda name: {r[6].removeprefix("B C").removeprefix("A") for r in want[name]}
    assert models("1.cif") == ({"", "2", "3"} if assembly else {""}) and models("2.cif") == ({"", "7"} if assembly else {""})


def test_xyzr_in_ranges(spark, tmp_path, ranges):
    rng = random.Random(3)
    texts = {f"{i}.xyzr": "".join("# note\n" if rng.random() < 0.1 else f"A {k} {rng.uniform(-9, 9):.4f}\t{rng.uniform(-9, 9):.4f} 1e1 .5\n" for k in range(n)) for i, n in enumerate([0, 3, 200])}
    folder = written(tmp_path, texts)
    assert rows(xyzr_balls(file_lines(spark, folder), True), texts) == rows(parse_xyzr(whole(spark, texts)), texts)


def test_files_of_both_kinds(spark, tmp_path, ranges):
    rng = random.Random(4)
    written(tmp_path, {"a.pdb": pdb_text(rng, 2), "b.cif": cif_text(rng, ["1", "2"])})
    paths = [f"{tmp_path}/a.pdb", f"{tmp_path}/b.cif"]
    split = rows(read_structures(spark, paths), paths)
    spark.conf.set("spark.sql.files.openCostInBytes", "4m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert not may_split(spark, paths)
    assert rows(read_structures(spark, paths), paths) == split


def test_states_of_parts():
    """Whatever the cut, the state after two parts is the state after their lines; so are rows."""
    rng = random.Random(5)
    lines = cif_text(rng, ["1", "2"]).split("\n")
    whole = structures._AtomLoop()
    want = [tuple(r) for line in lines for r in whole.rows(line)]
    for size in (1, 2, 7, 30):
        state, got = (structures.OUTSIDE, [], []), []
        for i in range(0, len(lines), size):
            loop, part = structures._AtomLoop(*state), structures._PartSummary()
            for line in lines[i : i + size]:
                got += [tuple(r) for r in loop.rows(line)]
                part.take(line)
            state = structures._after(state, part.state())
            assert state[0] == loop.state and (state[0] == structures.OUTSIDE or (state[1], state[2]) == (loop.header, loop.row))
        assert got == want


@pytest.mark.parametrize("setting,n", [("4194304", 4194304), ("128MB", 128 << 20), ("64k", 65536), ("700b", 700)])
def test_sizes_in_settings(setting, n):
    assert structures._bytes(setting) == n
