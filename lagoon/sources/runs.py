"""Sorted runs of keyed records as Parquet: the on-disk form of a log-structured store.

A run is sorted by key, so row-group statistics act as its sparse index, and a
Parquet bloom filter on the key answers most lookups of absent keys; both are used
by Spark's reader from an ordinary filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codecs of Parquet that take the place of block codecs; lz4 is its framed form, as Spark's filtered reads of the raw one fail on some pages. (O005, O239)
CODECS = ("lz4", "zstd", "snappy", "none")


def write_run(df: DataFrame, key: str, path: str, bloom: bool = True, codec: str = "zstd") -> None:
    """(O010, O046)"""
    if codec not in CODECS:
        raise ValueError(f"no codec {codec!r}")
    writer = df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.option("compression", codec)
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)


def read_runs(spark: SparkSession, *paths: str) -> DataFrame:
    """(O009)"""
    return spark.read.parquet(*paths)


def replay(frames: DataFrame, log: str, offset: str, intact: Column) -> DataFrame:
    """Frames of each log before its first damaged one. (O012)"""
    bad = frames.groupBy(log).agg(F.min(F.when(~intact, F.col(offset))).alias("_bad"))
    return frames.join(bad, log).where(F.col("_bad").isNull() | (F.col(offset) < F.col("_bad"))).drop("_bad")
