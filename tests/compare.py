"""Rows of a Spark result against rows of DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) else str(v)


def rows(columns, found):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in at], sorted((tuple(cell(r[k]) for k in at) for r in found), key=str)


def same(df, con, sql):
    rel = con.sql(sql)
    assert rows(df.columns, map(tuple, df.collect())) == rows(rel.columns, rel.fetchall())
