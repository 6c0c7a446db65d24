"""Compare a query's rows with those of its SQL in DuckDB, on the same Parquet files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.01")


def connect(folder=DATA):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    q = con.execute(sql)
    names = [d[0] for d in q.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(tuple(shown(r[i]) for i in at) for r in q.fetchall())
