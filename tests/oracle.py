"""Compares a query with its DuckDB equivalent."""

import datetime
import os

import duckdb


def connection(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def value(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def both(df, sql, sf_dir):
    """Both results as sorted rows, columns by name."""
    cols = sorted(df.columns)
    ours = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = connection(sf_dir).sql(sql)
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    return ours, sorted((tuple(value(r[k]) for k in at) for r in found.fetchall()), key=repr)
