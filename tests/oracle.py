"""Runs a query and its SQL over one folder and compares the rows."""

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings dataset manifest dataset_snapshots run_metrics eval_items mix_targets".split()


def connect(folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        path = Path(folder, f"{name}.parquet")
        if path.exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def assert_same(spark, folder, query, sql):
    got, want = query(spark, folder).toPandas(), connect(folder).sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want)
    for c in columns:
        if pd.api.types.is_numeric_dtype(got[c]) != pd.api.types.is_bool_dtype(got[c]) or pd.api.types.is_numeric_dtype(want[c]) != pd.api.types.is_bool_dtype(want[c]):
            got[c], want[c] = (pd.to_numeric(x[c]).astype("float64") for x in (got, want))
    text = lambda frame: frame[columns].astype(str).replace({"NaT": "None", "<NA>": "None", "nan": "None"}).sort_values(columns).reset_index(drop=True)
    a, b = text(got), text(want)
    different = (a != b).any(axis=1)
    assert not different.any(), f"\n{a[different].head(3)}\n{b[different].head(3)}"
