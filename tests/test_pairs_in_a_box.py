"""In a box, the one contact of a pair is chosen where its contacts are made."""

import pytest
from pyspark.sql import functions as F

from sphaera.catalog import queries
from sphaera.operators.periodic import first_of_pair
from sphaera.plans.tessellation import tessellate


@pytest.mark.parametrize("merge_inner", [False, True])
def test_first_contacts_of_pairs_without_an_aggregation(spark, merge_inner):
    """all contacts were shuffled and sorted to find the first one of each pair."""
    rows = queries.balls(spark, "/root/testdata/sf0.001").where("structure_id = 0")
    t = tessellate(rows.withColumns({c: F.col(c) % 12 for c in "xyz"}), 1.4, queries.SKEW)
    got = t.contacts_only if merge_inner else t.contacts
    want = first_of_pair(t.contacts_full, merge_inner)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    known = sorted(map(tuple, want.select("structure_id", "a_id", "b_id", "area", "arc_length", "central").collect()))
    assert known and sorted(map(tuple, got.collect())) == known
    kept = t.kept()
    assert sorted(map(tuple, (kept.contacts_only if merge_inner else kept.contacts).collect())) == known
