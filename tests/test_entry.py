"""The driver's contract: every decision query gives the rows of its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gatewright.plans.catalog import ORACLES, QUERIES


def plain(value):
    if value is None or isinstance(value, str):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else int(value) if value == int(value) else round(value, 6)
    try:
        return None if value != value else value
    except TypeError:
        return None


def rows(frame):
    frame = frame[sorted(frame)].astype(object)
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def sql(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def test_entry_gives_rows(spark, sf):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, sql, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        wanted = sql.sql(ORACLES[name]).df()
        assert sorted(found) == sorted(wanted)
        assert rows(found) == rows(wanted)
    else:
        assert len(found) > 0
