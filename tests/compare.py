"""Row-set comparison of a Spark result with DuckDB SQL on the same tables."""

import datetime as dt
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def clean(x):
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(clean(r[c]) for c in cols) for r in df.collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return [rel.columns[i] for i in order], Counter(tuple(clean(r[i]) for i in order) for r in rel.fetchall())
