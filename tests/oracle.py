"""Compare a query with its SQL twin on the given tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def check(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    want = database(sf_dir).sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    mine = [tuple(cell(r[c]) for c in cols) for r in got.collect()]
    theirs = [tuple(map(cell, r)) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()]
    order = lambda row: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)
    assert sorted(mine, key=order) == sorted(theirs, key=order)
