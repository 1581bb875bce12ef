"""Tables of operators, and the filter that keeps texts out of shuffles."""

import os

import pytest
from acoustics_spark.llm import likely as filters
from acoustics_spark.llm.store import Tables, swept
from pyspark.sql import functions as F


def paths(df):
    return df._stored_at.removeprefix("file:")


def test_likely_loses_no_wanted_text(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("text_hash")).unionByName(spark.sql("SELECT -1L AS id, -1L AS text_hash UNION ALL SELECT 5L, 0L"))
    wanted = rows.filter("id % 10 = 5 OR id < 0").select("text_hash", F.lit(1).alias("other"))
    got = filters.likely(rows, wanted, "left_semi")
    assert got.columns == ["id", "text_hash"]
    assert {r.id for r in got.collect()} == {r.id for r in rows.collect() if r.id % 10 == 5 or r.id < 0}
    assert filters.likely(rows, wanted, "left_anti").count() == 3002 - got.count()
    monkeypatch.setattr(filters, "PLACES", 1 << 15)  # so few that others pass, too
    more = filters.likely(rows, wanted, "left_semi")
    assert got.subtract(more).isEmpty() and more.count() + filters.likely(rows, wanted, "left_anti").count() == 3002
    assert filters.likely(rows, wanted.limit(0), "left_semi").isEmpty()


def test_tables_are_deleted(spark):
    with swept():
        outer = Tables(spark, "outer")
        a, b, c = (outer.write(spark.range(n)) for n in (1, 2, 3))
        outer.drop(a)
        assert not os.path.exists(paths(a)) and b.count() == 2
        outer.keep_only(c)
        assert not os.path.exists(paths(b)) and c.count() == 3
    assert not os.path.exists(os.path.dirname(paths(c)))
    with pytest.raises(ZeroDivisionError), swept():
        kept = Tables(spark, "kept").write(spark.range(4))
        1 / 0  # noqa: B018
    assert kept.count() == 4


def test_settings_hold_while_a_table_is_written(spark):
    from acoustics_spark.llm.store import SETTINGS

    at = {k: spark.conf.get(k, None) for k in SETTINGS}
    sizes = spark.range(5000).coalesce(1).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "id long")
    assert Tables(spark, "sizes").write(sizes).count() == 5
    assert {k: spark.conf.get(k, None) for k in SETTINGS} == at
    with pytest.raises(Exception):  # noqa: B017
        Tables(spark, "bad").write(spark.range(1).select(F.raise_error(F.lit("no"))))
    assert {k: spark.conf.get(k, None) for k in SETTINGS} == at
