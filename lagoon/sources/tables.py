"""The test tables, and their double measures as whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as (g: type, seq: id, ts, x: value in hundredths)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("g"), F.col("event_id").alias("seq"), "ts", F.round(F.col("value") * 100).cast("long").alias("x"))


SAMPLES_SQL = "s AS (SELECT event_type AS g, event_id AS seq, ts, CAST(round(value * 100) AS BIGINT) AS x FROM events)"
