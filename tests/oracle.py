"""Runs a query and its SQL side by side."""

import datetime
import os

import duckdb


def _value(x):
    if isinstance(x, float):
        return round(x, 6)
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


def _rows(rows):
    return sorted([tuple(map(_value, r)) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    df = query(spark, sf_dir)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.select(names).collect()) == _rows(got.fetchall())
