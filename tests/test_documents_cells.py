"""JSON documents find the cells once."""

from sphaera.catalog import queries
from sphaera.operators import cells as cell_ops
from sphaera.sources.sinks import json_documents


def test_documents_find_the_cells_once(spark, monkeypatch):
    """the cells were aggregated from all contacts three times: for themselves, the balls and the totals."""
    made, inner = [], cell_ops.cells
    monkeypatch.setattr(cell_ops, "cells", lambda *args, **options: (made.append(1), inner(*args, **options))[1])
    rows = json_documents(queries.tess(spark, "/root/testdata/sf0.001"))
    assert rows.count() and len(made) == 1
