"""Tessellate structure files: python -m sphaera FILE... --output FOLDER"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sphaera.operators.groups import chain_groups, residue_groups, selection_groups
from sphaera.operators.periodic import PeriodicBox
from sphaera.plans.tessellation import tessellate
from sphaera.sources.radii import Radii
from sphaera.sources.sinks import json_documents, pymol_script
from sphaera.sources.structures import ParseOptions, read_lines, read_structures


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m sphaera", description=__doc__)
    p.add_argument("input", nargs="+", help="PDB, mmCIF or XYZR files; - is standard input")
    p.add_argument("--output", help="folder for one JSON document a file; else they go to standard output")
    p.add_argument("--probe", type=float, default=1.4)
    p.add_argument("--format", choices=("pdb", "mmcif", "xyzr"))
    p.add_argument("--radii-file", help="radius rules on top of the default ones")
    p.add_argument("--exclude-heteroatoms", action="store_true")
    p.add_argument("--include-hydrogens", action="store_true")
    p.add_argument("--as-assembly", action="store_true")
    p.add_argument("--periodic-box-corners", type=float, nargs=6, metavar="N")
    p.add_argument("--periodic-box-directions", type=float, nargs=9, metavar="N")
    group = p.add_mutually_exclusive_group()
    group.add_argument("--selections", help="two or more selections, with semicolons between them")
    group.add_argument("--inter-chain", action="store_true")
    group.add_argument("--inter-residue", action="store_true")
    p.add_argument("--pymol", help="a PyMOL script of the first file goes here")
    p.add_argument("--processors", default="*", help="threads in local mode")
    p.add_argument("--measure-running-time", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    return p.parse_args(args)


def main(args: list[str] | None = None) -> int:
    a = arguments(args)
    builder = SparkSession.builder.appName("sphaera").config("spark.ui.showConsoleProgress", "false")
    spark = (builder if SparkSession.getActiveSession() else builder.master(f"local[{a.processors}]")).getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "ERROR" if a.quiet else "WARN")
    began = time.time()
    radii = Radii()
    if a.radii_file:
        radii = radii.with_text("\n".join(r["value"] for r in spark.read.text(a.radii_file).collect()))
    options = ParseOptions(a.exclude_heteroatoms, a.include_hydrogens, a.as_assembly)
    atoms = read_lines(spark, sys.stdin, options, radii, a.format) if a.input == ["-"] else read_structures(spark, a.input, options, radii, a.format)
    if a.selections or a.inter_chain or a.inter_residue:
        if "chain_id" not in atoms.columns:
            raise SystemExit("XYZR files have no atom records to group")
        atoms = selection_groups(atoms, a.selections.split(";")) if a.selections else chain_groups(atoms) if a.inter_chain else residue_groups(atoms)
    box = None
    if c := a.periodic_box_corners:
        box = PeriodicBox.from_corners(c[:3], c[3:])
    elif c := a.periodic_box_directions:
        box = PeriodicBox.from_vectors(c[:3], c[3:6], c[6:])
    result = tessellate(atoms, a.probe, box).kept(bool(a.pymol))
    documents = json_documents(result)
    if a.output:
        documents.select(F.col("json").alias("value")).write.mode("overwrite").text(a.output)
    else:
        for row in documents.orderBy("structure_id").toLocalIterator():
            print(row["json"])
    if a.pymol:
        sid = atoms.select("structure_id").first()
        with open(a.pymol, "w") as out:
            out.writelines(line + "\n" for line in pymol_script(result, sid and sid["structure_id"]))
    if a.measure_running_time:
        print(f"{time.time() - began:.3f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
