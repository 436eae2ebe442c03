"""Tessellations of whole tables of balls, and of structure files."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.operators import cells as cell_ops
from sphaera.operators import contacts as contact_ops
from sphaera.operators import faces as face_ops
from sphaera.operators import network
from sphaera.operators.groups import selection_groups
from sphaera.operators.overlap import Neighbourhoods, neighbourhoods, overlaps, spheres_of
from sphaera.operators.periodic import PeriodicBox, first_of_pair
from sphaera.sources.radii import Radii
from sphaera.sources.structures import ParseOptions, read_structures
from sphaera.staging import staged


@dataclass(frozen=True)
class Tessellation:
    """The tables of a tessellation, each a DataFrame that is computed when it is asked for.

    balls has ball_id, x, y, z, r and, as far as they apply, structure_id and grp. kept() gives one whose
    contacts, and with network their boundaries, are constructed once and written, for callers that need several
    tables: contacts, cells, totals, edges, vertices and faces then come from one overlap join and one pass.
    """

    balls: DataFrame
    probe: float = 0.0
    box: PeriodicBox | None = None
    written: DataFrame | None = None

    def kept(self, network: bool = False) -> Tessellation:
        if self.written is not None and (not network or "pieces" in self.written.columns):
            return self
        return replace(self, written=staged(contact_ops.measured(self.neighbourhoods, network), "contacts"))

    @cached_property
    def spheres(self) -> DataFrame:
        return spheres_of(self.balls, self.probe)

    @cached_property
    def overlaps(self) -> DataFrame:
        return overlaps(self.spheres, self.box)

    @cached_property
    def neighbourhoods(self) -> Neighbourhoods:
        return neighbourhoods(self.spheres, self.box)

    @property
    def neighbours(self) -> DataFrame:
        return self.neighbourhoods.rows()

    @cached_property
    def boundaries(self) -> DataFrame:
        if self.written is not None and "pieces" in self.written.columns:
            return contact_ops.contacts_full(self.written)
        return contact_ops.boundaries(self.neighbourhoods)

    @cached_property
    def measured(self) -> DataFrame:
        return contact_ops.measured(self.neighbourhoods) if self.written is None else self.written

    @cached_property
    def contacts_full(self) -> DataFrame:
        return contact_ops.contacts_full(self.measured)

    def _named(self, merge_inner: bool) -> DataFrame:
        if self.box and self.written is not None:
            found = first_of_pair(self.contacts_full, merge_inner)
        else:
            found = contact_ops.first_contacts(self.neighbourhoods, merge_inner) if self.box else self.contacts_full
            found = found.withColumns({"a_id": F.least("a", "b"), "b_id": F.greatest("a", "b")})
        return found.select("structure_id", F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), "area", "arc_length", "central")

    @property
    def contacts(self) -> DataFrame:
        """(structure_id, id_a, id_b, area, arc_length, central). In a box, a pair that touches both inside
        and across the border has a row for each."""
        return self._named(merge_inner=False)

    @property
    def contacts_only(self) -> DataFrame:
        """The same but that in a box, a pair has one row."""
        return self._named(merge_inner=True)

    @property
    def cells(self) -> DataFrame:
        if self.written is None:
            return cell_ops.cells_of(self.spheres, cell_ops.summaries_of_halves(contact_ops.half_sums(self.neighbourhoods)))
        return cell_ops.cells(self.spheres, self.measured)

    @property
    def totals(self) -> DataFrame:
        t = self.kept()
        return cell_ops.totals(self.balls, t.contacts, t.cells)

    @property
    def per_ball(self) -> DataFrame:
        return cell_ops.per_ball(self.balls, self.cells)

    @property
    def edges(self) -> DataFrame:
        return network.edges(self.boundaries)

    @property
    def vertices(self) -> DataFrame:
        return network.vertices(self.boundaries)

    def faces(self, angle_step: float = face_ops.ANGLE_STEP) -> DataFrame:
        """Polygons to draw; the periodic box does not count."""
        plain = Tessellation(self.balls, self.probe) if self.box else self
        return face_ops.faces(plain.boundaries, angle_step)


def tessellate(balls: DataFrame, probe: float = 1.4, box: PeriodicBox | None = None) -> Tessellation:
    """The radical tessellation of balls, constrained to their accessible surface, structure by structure."""
    return Tessellation(balls, float(probe), box)


def tessellate_files(
    spark, paths, probe: float = 1.4, selections: list[str] | None = None, options: ParseOptions = ParseOptions(), radii: Radii | None = None,
    box: PeriodicBox | None = None,
) -> Tessellation:
    """The tessellation of structure files; with selections, only contacts between different ones count."""
    atoms = read_structures(spark, paths, options, radii)
    if selections:
        if "chain_id" not in atoms.columns:
            raise ValueError("XYZR files have no atom records to select from")
        atoms = selection_groups(atoms, selections)
    return tessellate(atoms, probe, box)
