"""Readers of XYZR, PDB and mmCIF files into tables of atoms or balls.

Files are read by byte ranges, as Spark splits them, line by line. Atoms are numbered within their range as its
lines go by; one row for each range then tells how many atoms, ends of models and the like came before it. So a file of
any size takes as many tasks as it has ranges, and no file is ever one row.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sphaera.sources.radii import Radii
from sphaera.staging import staged

ATOM = (
    "record_name string, serial int, name string, alt_loc string, res_name string, chain_id string, res_seq int, i_code string, "
    "x double, y double, z double, element string, b_factor double"
)
_EXTENSIONS = {"pdb": "pdb", "ent": "pdb", "pdb1": "pdb", "cif": "mmcif", "mmcif": "mmcif", "xyzr": "xyzr"}
_NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


@dataclass(frozen=True)
class ParseOptions:
    exclude_heteroatoms: bool = False
    include_hydrogens: bool = False
    as_assembly: bool = False


def detect_format(path: str) -> str | None:
    """The format that a file's extension tells."""
    return _EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None


def detect_format_from_line(line: str) -> str:
    """The format that a file's first line tells."""
    line = line.strip()
    if line.startswith(("data_", "_", "loop_")):
        return "mmcif"
    if line.startswith(("ATOM", "HETATM", "HEADER", "REMARK")):
        return "pdb"
    parts = line.split()
    if len(parts) >= 4 and all(re.fullmatch(_NUMBER, p) for p in parts[-4:]):
        return "xyzr"
    raise ValueError(f"cannot tell the format of a file that begins with {line[:60]!r}")


def file_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(structure_id, part, split, line) of files, named by their path, in the order of the file within each part: where
    the byte range begins that a line is read with. split tells whether a file has several."""
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_block_length", "file_size")]
    return spark.read.text(paths).select(meta[0].alias("structure_id"), meta[1].alias("part"), (meta[2] < meta[3]).alias("split"), F.col("value").alias("line"))


def text_lines(texts: DataFrame) -> DataFrame:
    """The same of whole texts (structure_id, content), of which each is one part."""
    return texts.select("structure_id", F.lit(0).cast("long").alias("part"), F.lit(False).alias("split"), F.explode(F.split("content", "\r?\n")).alias("line"))


def _bytes(setting: str) -> int:
    n, unit = re.fullmatch(r"(\d+)\s*([bkmgt]?)b?", setting.strip().lower()).groups()
    return int(n) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 0)


def may_split(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether one of the files is long enough for Spark to read it in several byte ranges."""
    least = min(_bytes(spark.conf.get(f"spark.sql.files.{c}")) for c in ("openCostInBytes", "maxPartitionBytes"))
    longest = spark.read.format("binaryFile").load(paths).agg(F.max("length")).first()[0]
    return (longest or 0) > least


def number(text: Column) -> Column:
    return F.when(text.rlike(f"^{_NUMBER}$"), text.try_cast("double"))


#: The most rows of parts, or of files, that are broadcast.
FEW_PARTS = 200_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW_PARTS + 1).count() <= FEW_PARTS else df


def _numbered(rows: DataFrame, split: bool, only_first: bool = False) -> DataFrame:
    """The kept rows with ball_id, their number in the file, and models, how many models ended before.

    rows come in the order of lines, with structure_id, part, valid, kept, stop (the file ends here), ends_model and
    model. With only_first, only rows of the model of the file's first valid row count. Where files may be split, each
    part also gives a row with its totals, and numbers go on from those of the parts before.
    """
    marks = ("structure_id", "part", "valid", "kept", "stop", "ends_model", "model")
    own = [c for c in rows.columns if c not in marks]
    extra = "at long, models long, model string, n long, stopped boolean, first string"
    schema = T.StructType([rows.schema["structure_id"], T.StructField("part", T.LongType()), *T._parse_datatype_string(extra).fields, *[T.StructField(c, rows.schema[c].dataType) for c in own]])
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    rows = rows.select(*marks, *own)

    def run(batches):
        key, stopped, models, first, counts = None, False, 0, None, {}

        def totals():
            row = {"structure_id": key[0], "part": key[1], "models": models, "n": sum(counts.values()), "stopped": stopped, "first": first}
            return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            if not len(batch):
                continue
            differ = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
            edges = [0, *(np.nonzero(differ[0] | differ[1])[0] + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:]):
                here = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                if here != key:
                    if key is not None and split:
                        yield totals()
                    key, stopped, models, first, counts = here, False, 0, None, {}
                if stopped:
                    continue
                lines = batch.slice(a, b - a)
                valid, kept, stop, ends = (lines.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in range(2, 6))
                if stop.any():
                    stopped = True
                    lines, valid, kept, ends = (x[: int(stop.argmax())] for x in (lines, valid, kept, ends))
                before = models + np.cumsum(ends) - ends
                models += int(ends.sum())
                model = lines.column(6)
                if first is None and valid.any():
                    first = model[int(valid.argmax())].as_py()
                if only_first and not split:
                    kept &= pc.equal(model, pa.scalar(first, pa.string())).fill_null(False).to_numpy(zero_copy_only=False) if first is not None else False
                at = np.zeros(len(lines), np.int64)
                names = model.unique().to_pylist() if only_first else [None]
                for name in names:
                    mine = kept & pc.equal(model, pa.scalar(name, pa.string())).to_numpy(zero_copy_only=False) if only_first else kept
                    at[mine] = counts.get(name, 0) + np.arange(int(mine.sum()))
                    counts[name] = counts.get(name, 0) + int(mine.sum())
                keep = pa.array(kept)
                new = {"at": pa.array(at), "models": pa.array(before), "model": model}
                new |= {n: lines.column(lines.schema.get_field_index(n)) for n in ("structure_id", "part", *own)}
                n = int(kept.sum())
                yield pa.RecordBatch.from_arrays([new[f.name].filter(keep).cast(f.type) if f.name in new else pa.nulls(n, f.type) for f in arrow], schema=arrow)
        if key is not None and split:
            yield totals()

    found = rows.mapInArrow(run, schema)
    if not split:
        return found.select("structure_id", F.col("at").alias("ball_id"), "models", "model", *own)
    found = staged(found, "numbered")
    parts, atoms = found.where("at is null"), found.where("at is not null")
    if only_first:
        first = parts.where("first is not null").groupBy("structure_id").agg(F.min_by("first", "part").alias("first_model"))
        atoms = atoms.join(_few(first), "structure_id").where("model = first_model")
        counted = atoms.groupBy("structure_id", "part").agg(F.count("*").alias("n"))
        parts = parts.drop("n").join(counted, ["structure_id", "part"], "left").fillna(0, ["n"])
    before = Window.partitionBy("structure_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "model_base": F.coalesce(F.sum("models").over(before), F.lit(0)), "gone": F.coalesce(F.max("stopped").over(before), F.lit(False))}
    parts = parts.select("structure_id", "part", *[c.alias(n) for n, c in sums.items()])
    atoms = atoms.join(_few(parts), ["structure_id", "part"]).where("not gone")
    return atoms.select("structure_id", (F.col("at") + F.col("base")).alias("ball_id"), (F.col("models") + F.col("model_base")).alias("models"), "model", *own)


def xyzr_balls(lines: DataFrame, split: bool) -> DataFrame:
    """(structure_id, ball_id, x, y, z, r) of lines whose last four fields are numbers; others are dropped."""
    fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.select("structure_id", "part", fields.alias("f")).select("structure_id", "part", *[F.when(F.size("f") >= 4, number(F.get("f", F.size("f") - 4 + i))).alias(c) for i, c in enumerate("xyzr")])
    good = F.expr("x is not null and y is not null and z is not null and r is not null")
    return _numbered(_marked(rows, good, good), split).drop("models", "model")


def _marked(rows: DataFrame, valid: Column, kept: Column, stop: Column | None = None, ends_model: Column | None = None) -> DataFrame:
    marks = {n: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False) for n, c in (("valid", valid), ("kept", kept), ("stop", stop), ("ends_model", ends_model))}
    return rows.withColumns(marks if "model" in rows.columns else marks | {"model": F.lit(None).cast("string")})


def parse_xyzr(texts: DataFrame) -> DataFrame:
    """xyzr_balls() of whole texts (structure_id, content)."""
    return xyzr_balls(text_lines(texts), False)


def _defined(c: Column) -> Column:
    return F.when(c.isin(".", "?"), "").otherwise(c)


def _atom_name(c: Column) -> Column:
    """Leading digits go to the end."""
    return F.regexp_replace(c, r"^(\d+)(\D.*)$", "$2$1")


def acceptable(a, options: ParseOptions) -> Column:
    """Which atoms are kept; ``a`` gives fields by name."""
    keep = a["alt_loc"].isin("", "A", "1", ".") & (a["res_name"] != "HOH")
    if options.exclude_heteroatoms:
        keep = keep & (a["record_name"] != "HETATM")
    if not options.include_hydrogens:
        keep = keep & ~(a["name"].startswith("H") | a["element"].isin("H", "D"))
    return keep


def pdb_atoms(lines: DataFrame, split: bool, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Atoms of the lines of PDB files. Reading ends at END, and at the first ENDMDL unless as_assembly, where the chains
    of later models get the model's number as a suffix. Lines without a name, a serial or residue number or
    coordinates are dropped."""
    part = lambda a, b: F.trim(F.substring("line", a, b - a + 1))
    whole = lambda a, b: F.when(part(a, b).rlike(r"^[+-]?\d+$"), part(a, b).try_cast("int"))
    fields = {
        "record_name": part(1, 6), "serial": whole(7, 11), "name": _atom_name(part(13, 16)), "alt_loc": _defined(part(17, 17)),
        "res_name": _defined(part(18, 20)), "chain_id": _defined(part(22, 22)), "res_seq": whole(23, 26), "i_code": _defined(part(27, 27)),
        "x": number(part(31, 38)), "y": number(part(39, 46)), "z": number(part(47, 54)), "element": _defined(part(77, 78)),
        "b_factor": F.coalesce(number(part(61, 66)), F.lit(0.0)),
    }
    atom = F.col("record_name").isin("ATOM", "HETATM") & F.expr("x is not null and y is not null and z is not null and serial is not null and res_seq is not null and name <> ''")
    ends = F.col("record_name") == "ENDMDL"
    stop = F.col("record_name") == "END" if options.as_assembly else F.col("record_name").isin("END", "ENDMDL")
    rows = lines.select("structure_id", "part", *[c.alias(n) for n, c in fields.items()])
    rows = rows.where(atom | F.col("record_name").isin("END", "ENDMDL"))
    kept = atom & acceptable({n: F.col(n) for n in fields}, options)
    rows = _numbered(_marked(rows, atom, kept, stop, ends), split)
    if options.as_assembly:
        rows = rows.withColumn("chain_id", F.when(F.col("models") > 0, F.concat("chain_id", (F.col("models") + 1).cast("string"))).otherwise(F.col("chain_id")))
    return rows.drop("models", "model").withColumn("alt_loc", F.lit(""))


def parse_pdb(texts: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """pdb_atoms() of whole texts (structure_id, content)."""
    return pdb_atoms(text_lines(texts), False, options)


_CIF_TOKEN = re.compile(r"""#[^\n]*|'([^'\n]*)(?:'|$)|"([^"\n]*)(?:"|$)|(\S+)""", re.M)
# The columns of the atom loop that are read; where two are named, the first is preferred if
# the loop has it at all.
_CIF_FIELDS = {
    "model": ("pdbx_PDB_model_num",), "record_name": ("group_PDB",), "serial": ("id",), "name": ("auth_atom_id", "label_atom_id"), "alt_loc": ("label_alt_id",),
    "res_name": ("auth_comp_id", "label_comp_id"), "chain_id": ("auth_asym_id", "label_asym_id"), "res_seq": ("auth_seq_id", "label_seq_id"),
    "i_code": ("pdbx_PDB_ins_code",), "x": ("Cartn_x",), "y": ("Cartn_y",), "z": ("Cartn_z",), "element": ("type_symbol",), "b_factor": ("B_iso_or_equiv",),
}


def _cif_tokens(text: str) -> Iterator[tuple[str, bool]]:
    """Tokens and whether they are quoted. Texts between semicolons are not known."""
    for m in _CIF_TOKEN.finditer(text):
        if m.lastindex:
            yield m[m.lastindex], m.lastindex < 3


#: The most columns of an atom loop that is read across parts.
MOST_COLUMNS = 1000
OUTSIDE, HEADER, BODY = range(3)


def _is_control(token: str) -> bool:
    return token == "loop_" or token.startswith(("_", "data_"))


class _AtomLoop:
    """Reads lines for the rows of atom loops. What a line means depends on the state: outside, in the header (whose
    columns have been seen), or in the body (and the values of a row that is not complete)."""

    def __init__(self, state: int = OUTSIDE, header: Iterable[str] = (), row: Iterable[str] = ()):
        self.state, self.header, self.row = state, list(header), list(row)

    def rows(self, line: str) -> list[list[str]]:
        """The rows that this line completes."""
        if self.state == BODY and not self.row and not ("'" in line or '"' in line or "#" in line):
            values = line.split()
            if len(values) == len(self.header) and not _is_control(values[0]):
                return [values]
        return self.completed(_cif_tokens(line))

    def completed(self, tokens: Iterable[tuple[str, bool]]) -> list[list[str]]:
        """The rows that these tokens complete."""
        found = []
        for token, quoted in tokens:
            if self.state == HEADER:
                if token.startswith("_atom_site."):
                    self.header.append(token[11:])
                    continue
                self.state, self.row = (BODY if self.header else OUTSIDE), []
            if self.state == BODY:
                if self.row or quoted or not _is_control(token):
                    self.row.append(token)
                    if len(self.row) == len(self.header):
                        found.append(self.row)
                        self.row = []
                    continue
                self.state = OUTSIDE
            if token == "loop_" and not quoted:
                self.state, self.header = HEADER, []
        return found


class _PartSummary:
    """What a part of a file does to any state it may begin in: the values before its first control token, the names of
    atom columns that it begins with, the values after those, and the state that the rest ends in."""

    def __init__(self):
        self.lead = self.body = 0
        self.last: deque[str] = deque(maxlen=MOST_COLUMNS)
        self.names: list[str] = []
        self.rest: _AtomLoop | None = None

    def take(self, line: str) -> None:
        if self.rest is not None:
            self.rest.rows(line)
            return
        tokens = list(_cif_tokens(line))
        for i, (token, quoted) in enumerate(tokens):
            if quoted or not _is_control(token):
                if self.names:
                    self.body += 1
                else:
                    self.lead += 1
                self.last.append(token)
            elif token.startswith("_atom_site.") and not self.lead and not self.body:
                self.names.append(token[11:])
            else:
                self.rest = _AtomLoop()
                self.rest.completed(tokens[i:])
                return

    def state(self) -> str:
        rest = self.rest and (self.rest.state, self.rest.header, self.rest.row)
        return json.dumps((self.lead, self.names, self.body, list(self.last), rest))


def _after(state: tuple[int, list[str], list[str]], part: str) -> tuple[int, list[str], list[str]]:
    """The state after a part that begins in a state; a control token is taken to be where a row begins."""
    lead, names, body, last, rest = json.loads(part)
    kind, header, row = state
    values = 0
    if kind == HEADER and not lead and names:
        header, values = header + names, body
        kind = BODY if body else HEADER
    elif kind == HEADER and lead:
        kind, values = (BODY if header else OUTSIDE), lead
    elif kind == BODY:
        kind, values = (OUTSIDE, 0) if names else (BODY, lead)
    if rest is not None:
        return tuple(rest)
    if kind != BODY:
        return kind, header, []
    if len(header) > MOST_COLUMNS:
        raise ValueError(f"an atom loop of more than {MOST_COLUMNS} columns")
    open_values = (len(row) + values) % len(header)
    return kind, header, (row + last)[-open_values:] if open_values else []


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[str]]]:
    """The lines of a batch (structure_id, part, line) by part."""
    differ = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
    edges = [0, *(np.nonzero(differ[0] | differ[1])[0] + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield (batch.column(0)[a].as_py(), batch.column(1)[a].as_py()), batch.column(2).slice(a, b - a).to_pylist()


def _cif_states(lines: DataFrame) -> dict[tuple, tuple]:
    """The state in which each part but the first begins, of the files that have several. The driver gets one short row
    for each byte range of these."""

    def run(batches):
        key, part = None, None

        def given():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([part.state()])], names=["structure_id", "part", "state"])

        for batch in batches:
            for here, own in _runs(batch):
                if here != key:
                    if key is not None:
                        yield given()
                    key, part = here, _PartSummary()
                for line in own:
                    part.take(line)
        if key is not None:
            yield given()

    found = lines.where("split").select("structure_id", "part", "line").mapInArrow(run, "structure_id string, part long, state string").toArrow()
    states, file, state = {}, None, (OUTSIDE, [], [])
    for own, part, summary in sorted(zip(*(found.column(i).to_pylist() for i in range(3)))):
        if own != file:
            file, state = own, (OUTSIDE, [], [])
        if state[0] != OUTSIDE:
            states[own, part] = state
        state = _after(state, summary)
    return states


def mmcif_atoms(lines: DataFrame, split: bool, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Atoms of the lines of mmCIF files, of the first model only unless as_assembly, where the chains of models other
    than "1" get the model's name as a suffix. A file in several parts is read twice: first for the state in which
    each part begins, such as the columns of the atom loop and the values of a row that lies across."""
    lines = lines.select(F.col("structure_id").cast("string"), "part", "split", "line")
    states = lines.sparkSession.sparkContext.broadcast(_cif_states(lines)) if split else None
    names = list(_CIF_FIELDS)

    def run(batches):
        key, loop, places, header = None, None, [], None
        for batch in batches:
            out = []
            for here, own in _runs(batch):
                if here != key:
                    key, loop, header = here, _AtomLoop(*(states.value.get(here, ()) if states else ())), None
                for line in own:
                    for row in loop.rows(line):
                        if header is not loop.header:
                            header = loop.header
                            places = [next((header.index(n) for n in options if n in header), None) for options in _CIF_FIELDS.values()]
                        out.append((*here, *[row[i] if i is not None else "" for i in places]))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]], names=["structure_id", "part", *names])

    raw = lines.drop("split").mapInArrow(run, "structure_id string, part long, " + ", ".join(f"{n} string" for n in names))
    whole = lambda c: F.when(F.col(c).rlike(r"^[+-]?\d+$"), F.col(c).try_cast("int"))
    fields = {
        "record_name": F.col("record_name"), "serial": whole("serial"), "name": _atom_name(_defined(F.col("name"))), "alt_loc": _defined(F.col("alt_loc")),
        "res_name": _defined(F.col("res_name")), "chain_id": _defined(F.col("chain_id")), "res_seq": whole("res_seq"), "i_code": _defined(F.col("i_code")),
        "x": number(F.col("x")), "y": number(F.col("y")), "z": number(F.col("z")), "element": _defined(F.col("element")), "b_factor": F.coalesce(number(F.col("b_factor")), F.lit(0.0)),
    }
    rows = raw.select("structure_id", "part", "model", *[c.alias(n) for n, c in fields.items()])
    atom = F.col("record_name").isin("ATOM", "HETATM") & F.expr("x is not null and y is not null and z is not null and serial is not null and res_seq is not null and name <> ''")
    kept = atom & acceptable({n: F.col(n) for n in fields}, options)
    rows = _numbered(_marked(rows, atom, kept), split, only_first=not options.as_assembly)
    if options.as_assembly:
        rows = rows.withColumn("chain_id", F.when(F.col("model").isin("1", ""), F.col("chain_id")).otherwise(F.concat("chain_id", "model")))
    return rows.drop("models", "model").withColumn("alt_loc", F.lit(""))


def parse_mmcif(texts: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """mmcif_atoms() of whole texts (structure_id, content)."""
    return mmcif_atoms(text_lines(texts), False, options)


def with_radii(atoms: DataFrame, radii: Radii | None = None) -> DataFrame:
    return atoms.withColumn("r", (radii or Radii()).column(F.col("res_name"), F.col("name")))


def _parsed(lines: DataFrame, split: bool, format: str, options: ParseOptions, radii: Radii | None) -> DataFrame:
    if format == "xyzr":
        return xyzr_balls(lines, split)
    return with_radii((pdb_atoms if format == "pdb" else mmcif_atoms)(lines, split, options), radii)


def read_structures(
    spark: SparkSession, paths: str | list[str], options: ParseOptions = ParseOptions(), radii: Radii | None = None, format: str | None = None
) -> DataFrame:
    """Atoms with radii, or the balls of XYZR files. The format is told by the caller, or by the extension of
    each path or else its first line; PDB and mmCIF files may come together, XYZR files, which have no atoms,
    only by themselves."""
    by_format: dict[str, list[str]] = {}
    for path in [paths] if isinstance(paths, str) else paths:
        own = format or detect_format(path) or detect_format_from_line((spark.read.text(path).first() or {"value": ""})["value"])
        by_format.setdefault(own, []).append(path)
    if "xyzr" in by_format and len(by_format) > 1:
        raise ValueError("XYZR files have no atoms; read them apart from other formats")
    parts = [_parsed(file_lines(spark, own), may_split(spark, own), f, options, radii) for f, own in by_format.items()]
    return reduce(DataFrame.unionByName, parts)


def read_lines(
    spark: SparkSession, lines: Iterable[str], options: ParseOptions = ParseOptions(), radii: Radii | None = None, format: str | None = None, structure_id: str = "-"
) -> DataFrame:
    """The same from the lines of one structure, such as standard input; a format that cannot be told from the
    first line that is not empty is an error. Lines of one structure pass through the driver, as they come."""
    lines = [x.rstrip("\r\n") for x in lines]
    format = format or detect_format_from_line(next((x for x in lines if x.strip()), ""))
    texts = spark.createDataFrame([(structure_id, "\n".join(lines))], "structure_id string, content string")
    return _parsed(text_lines(texts), False, format, options, radii)


def balls_from(spark: SparkSession, balls) -> DataFrame:
    """A table of one structure from an iterable of (x, y, z, r), of dicts, or an array of four columns."""
    rows = []
    for i, b in enumerate(balls):
        if isinstance(b, dict):
            rows.append((i, *[float(b[k]) for k in "xyzr"]))
            continue
        try:
            values = [float(v) for v in b]
        except TypeError:
            raise TypeError(f"ball {i} is neither a sequence of numbers nor a dict") from None
        if len(values) != 4:
            raise ValueError(f"ball {i} needs x, y, z and r")
        rows.append((i, *values))
    return spark.createDataFrame(rows, "ball_id long, x double, y double, z double, r double")
