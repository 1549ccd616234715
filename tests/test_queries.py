"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__
from annolith.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _plain(rows):
    def one(x):
        if x is None or isinstance(x, float) and x != x:
            return None
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return round(float(x), 6) + 0.0
        return x.isoformat() if hasattr(x, "isoformat") else x

    return sorted(([one(x) for x in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    left = _plain([r[c] for c in order] for r in got.collect())
    right = _plain([r[names.index(c)] for c in order] for r in want.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_trained_search_reaches_its_recall(spark, sf_dir):
    """On all queries against brute force."""
    d = sf_dir.replace("sf0.001", "sf0.1")
    exact = {(r.query_id, r.vec_id) for r in QUERIES["exact_knn"](spark, d).collect()}
    found = {(r.query_id, r.vec_id) for r in QUERIES["ivfpq_trained_search"](spark, d).collect()}
    assert len(exact & found) / len(exact) >= 0.9
