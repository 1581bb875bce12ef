"""Every registered query of the main library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from acoustics_spark.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    if name in ORACLE_SQL:
        out = duck.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(out.columns)
        at = [out.columns.index(c) for c in df.columns]
        assert sorted(map(repr, map(tuple, rows))) == sorted(repr(tuple(r[i] for i in at)) for r in out.fetchall())


@pytest.mark.parametrize("name", ["merge_overlapping", "map_to_segments", "boxes_in_window", "assign_splits", "detection_stats"])
def test_no_cartesian_product_and_no_unbounded_single_partition(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
