"""Compares a query with its SQL as the driver does: rows, columns and values, in any order."""

import glob
import os

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(x.asDict() if hasattr(x, "asDict") else x for x in r) for r in df.collect()])
    found = connect(sf_dir).execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    return len(want[1])
