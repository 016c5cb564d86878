"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from shelfmark.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf, duck):
    got = QUERIES[name](spark, sf)
    rows = duck.execute(ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = Counter(repr([plain(r[names.index(c)]) for c in order]) for r in rows.fetchall())
    have = Counter(repr([plain(r[c]) for c in order]) for r in got.collect())
    assert have == want
