"""Compares a query with its SQL, run by DuckDB on the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return f"{float(v):.6g}"
    return v if isinstance(v, bool) else str(v)


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    columns = sorted(df.columns)
    got = sorted(str([cell(r[c]) for c in columns]) for r in df.collect())
    found = con.sql(sql)
    names = list(found.columns)
    assert sorted(names) == columns
    wanted = sorted(str([cell(dict(zip(names, row))[c]) for c in columns]) for row in found.fetchall())
    assert got == wanted
