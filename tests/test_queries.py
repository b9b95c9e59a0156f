"""Each registered fact query against its SQL, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from factloom import queries, rule_queries

ORACLES, QUERIES = queries.ORACLES | rule_queries.ORACLES, queries.QUERIES | rule_queries.QUERIES
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return out


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER)
    want = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    order = {d[0]: i for i, d in enumerate(want.description)}
    expected = sorted((tuple(plain(r[order[c]]) for c in columns) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == expected
