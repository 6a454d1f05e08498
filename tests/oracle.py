"""Runs a query and its SQL over the same tables and gives both results in one form."""

import os
from pathlib import Path

import duckdb
import pytest

DATA = os.environ.get("CARDLOOM_TESTDATA", "/root/testdata/sf0.001")


def connect():
    if not Path(DATA).is_dir():
        pytest.skip(f"{DATA} isn't there")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(map(plain, value.values()))
    return value


def both(con, spark, function, sql):
    frame, relation = function(spark, DATA), con.sql(sql)
    names = sorted(frame.columns)
    assert names == sorted(relation.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)
    places = [list(relation.columns).index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in places) for r in relation.fetchall()), key=repr)
    return ours, theirs
