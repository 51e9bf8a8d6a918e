"""Runs on disk and their plans."""

import pytest
from pyspark.sql import functions as F

from lagoon.plans import catalogue
from lagoon.sources import runs
from tests.compare import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("codec", runs.CODECS)
def test_runs_round_trip(spark, tmp_path, codec):
    df = spark.range(500).select(F.concat(F.lit("k"), F.col("id")).alias("key"), "id")
    runs.write_run(df, "key", str(tmp_path / "run"), codec=codec)
    assert rows(runs.read_runs(spark, str(tmp_path / "run"))) == rows(df)


@pytest.mark.parametrize("codec", runs.CODECS)
@pytest.mark.parametrize("whole_first", [False, True])
def test_runs_under_every_filter(spark, tmp_path, codec, whole_first):
    """A run of 15,000 records read whole and under filters, in both orders."""
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_custkey")
    runs.write_run(orders, "o_custkey", str(tmp_path / "run"), codec=codec)
    filters = ["o_custkey IN (7, 77, 777)", "o_custkey = 7", "o_custkey BETWEEN 20 AND 40", "true"]
    for where in filters[::-1] if whole_first else filters:
        assert rows(runs.read_runs(spark, str(tmp_path / "run")).where(where)) == rows(orders.where(where))


def test_replay_stops_at_damage(spark):
    df = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("a", 2, True), ("b", 0, True)], "log string, at long, ok boolean")
    assert sorted((r["log"], r["at"]) for r in runs.replay(df, "log", "at", F.col("ok")).collect()) == [("a", 0), ("b", 0)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_bounds_and_columns_reach_the_scan(spark):
    plan = _plan(catalogue.queries()["lsm_range"](spark, SF))
    assert "GreaterThanOrEqual(o_custkey,200)" in plan and "LessThan(o_custkey,900)" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema")[1]


def test_newest_record_is_combined_before_the_shuffle(spark):
    plan = _plan(catalogue.queries()["latest_value"](spark, SF))
    assert "partial_max_by" in plan and "Window" not in plan


def test_no_cartesian_products(spark):
    for name in ("floor_lookup", "level_overlap", "pctl_floor", "kway_merge", "divergence"):
        assert "CartesianProduct" not in _plan(catalogue.queries()[name](spark, SF))


def test_no_python_in_declarative_queries(spark):
    for name in ("pctl_floor", "hdr_quantile", "dedup_latest", "floor_lookup", "fixed_window_limit", "fx_mul_modes", "saga_outcome", "cron_next", "cms_bounds_ok"):
        plan = _plan(catalogue.queries()[name](spark, SF))
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
