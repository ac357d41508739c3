"""Comparison of a query with its SQL: same columns and the same rows in any order."""

import math

import duckdb

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """Text of a value; null, NaN and the empty string stay three values."""
    if value is None:
        return "\0null"
    if isinstance(value, float) and math.isnan(value):
        return "\0nan"
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


def expected(sql, folder=FOLDER):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def actual(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df.select(*(df[n] for n in names)).collect())
