"""Run a query and its SQL over one folder and compare the rows."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(df):
    names = sorted(df.columns)

    def plain(v):
        if not isinstance(v, (list, tuple, dict, np.ndarray)) and pd.isna(v):
            return None
        v = v.item() if hasattr(v, "item") and not isinstance(v, np.ndarray) else v
        # pandas has whole numbers with nulls as floats.
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return names, sorted(repr(tuple(map(plain, r))) for r in df[names].itertuples(index=False, name=None))


def compare(spark, folder, name):
    import __spark_entry__

    db = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        db.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    got = _rows(__spark_entry__.queries()[name](spark, folder).toPandas())
    want = _rows(db.sql(__spark_entry__.oracle_sql()[name]).df())
    assert got == want
