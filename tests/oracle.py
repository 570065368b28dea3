"""Compares a query with its SQL in DuckDB, as multisets of rows with sorted columns."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v + 0.0:.6g}" if abs(v) >= 1e-9 else "0"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, (len(bad), bad[:3])
    types = dict(df.dtypes)
    for name, kind in zip(rel.columns, rel.types, strict=True):
        wide = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}}
        assert str(kind) in wide.get(types[name], {str(kind)}), (name, types[name], str(kind))
    return len(got)
