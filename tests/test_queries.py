"""Every order-flow query against its SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

from tidebar.plans.oracles import ORACLES
from tidebar.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(x):
    return None if isinstance(x, float) and math.isnan(x) else x


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"audit_columns", "audit_features", "sweep_replay_audit", "stage1_replay_audit", "feature_selection", "long_short_asymmetry"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([same(v) for _, v in sorted(zip(names, r, strict=True))]) for r in cursor.fetchall())
    got = sorted(repr([same(v) for _, v in sorted(zip(df.columns, r, strict=True))]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    found = QUERIES[name](spark, SF).count()
    assert found > 0 or name == "long_short_asymmetry"  # no sweep trade in the test part of so few bars
