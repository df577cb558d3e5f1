"""Every query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from sparkdossier.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(plain(v) for v in r) for r in want.fetchall())
    assert a == b


def test_queries_without_oracle_run(spark):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, SF).count() >= 1
