"""Every registered query against its SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from ledgerlight import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return v if isinstance(v, (int, str, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    r = db.sql(registry.oracle_sql()[name])
    cols = sorted(r.columns)
    assert sorted(df.columns) == cols
    got = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=repr)
    want = sorted((tuple(map(plain, x)) for x in r.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    assert got == want


def test_queries_without_sql_run(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() >= 0
    assert registry.flagship(spark, SF).count() > 0
