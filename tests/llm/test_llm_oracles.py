"""The queries that SQL can express, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from sparkdossier.llm.queries import ORACLE, QUERIES


def plain(v):
    if isinstance(v, float):
        return "None" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), db.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(v) for v in r) for r in want.fetchall())
