"""Holds a query's rows against its SQL in DuckDB."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v.item() if hasattr(v, "item") else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=repr)


def compare(spark, connection, query, sql, sf_dir):
    mine = query(spark, sf_dir)
    theirs = connection.sql(sql)
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = rows(mine.columns, mine.collect()), rows(theirs.columns, theirs.fetchall())
    assert len(a) == len(b)
    assert a == b
