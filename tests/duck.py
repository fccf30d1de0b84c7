"""Rows of DuckDB and of Spark in one comparable form."""

import datetime as dt
import decimal
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def oracle(sql, sf):
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        found = db.sql(sql)
        names = [x.lower() for x in found.columns]
        return names, found.fetchall()


def counted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, sql, sf):
    names, rows = oracle(sql, sf)
    assert sorted(x.lower() for x in df.columns) == sorted(names)
    got, wanted = counted([x.lower() for x in df.columns], df.collect()), counted(names, rows)
    assert got == wanted, (list((got - wanted).items())[:3], list((wanted - got).items())[:3])
