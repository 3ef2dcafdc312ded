"""Spark's rows and DuckDB's as sorted, rounded tuples."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or isinstance(v, (float, np.floating)) and np.isnan(v):
        return None
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else round(float(v), 5)
    return int(v) if isinstance(v, np.integer) else v


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(repr(tuple(plain(v) for v in r)) for r in pdf.itertuples(index=False, name=None))


def assert_same(spark, sf, query, sql):
    got, want = query(spark, sf).toPandas(), connect(sf).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
