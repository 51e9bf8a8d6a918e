"""Last-write-wins merging, compaction and versioned reads of keyed records.

The newest record of a key is an aggregate (`max_by`), so partial results are
combined before the shuffle and a key with very many versions costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _newest(df: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def by_source(df: DataFrame, keys: list[str], source: str, position: str) -> DataFrame:
    """The record of the greatest source; within it the first. (O128, O197)"""
    return _newest(df, keys, F.struct(F.col(source), -F.col(position)))


def by_priority(df: DataFrame, keys: list[str], priority: str, source: str, position: str) -> DataFrame:
    """Greatest priority, then greatest source, then first. (O129)"""
    return _newest(df, keys, F.struct(F.col(priority), F.col(source), -F.col(position)))


def latest(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """(O131)"""
    return _newest(df, keys, F.col(seq))


def live(df: DataFrame, keys: list[str], seq: str, tombstone: str) -> DataFrame:
    """The newest record of each key, unless it is a tombstone. (O130, O160)"""
    return latest(df, keys, seq).where(~F.col(tombstone)).drop(tombstone)


def read_range(df: DataFrame, key: str, seq: str, tombstone: str, low, high) -> DataFrame:
    """Live records with low <= key < high; the bounds reach the scan. (O151)"""
    return live(df.where((F.col(key) >= low) & (F.col(key) < high)), [key], seq, tombstone)


def as_of(df: DataFrame, keys: list[str], seq: str, tombstone: str, version: int) -> DataFrame:
    """What a snapshot taken at a version sees. (O163, O164)"""
    return live(df.where(F.col(seq) <= version), keys, seq, tombstone)


def merge_level(df: DataFrame, keys: list[str], level: str, seq: str, at_least: int) -> DataFrame:
    """Tiered compaction: where a level has so many runs (column run), they become one run of the next level, tombstones kept. (O161)"""
    full = df.groupBy(level).agg(F.countDistinct("run").alias("_runs")).where(F.col("_runs") >= at_least).select(level)
    picked = df.join(full, level, "left_semi")
    return latest(picked.drop("run"), [level, *keys], seq).withColumn(level, F.col(level) + 1)


def manifest(df: DataFrame, level: str, run: str, key: str) -> DataFrame:
    """Least and greatest key and size of each run."""
    return df.groupBy(level, run).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))


def overlaps(runs: DataFrame, level: str, run: str) -> DataFrame:
    """Pairs of runs of neighbouring levels whose key ranges meet: what a levelled compaction reads together. (O162)"""
    a = runs.select(F.col(level).alias("level"), F.col(run).alias("run"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    b = runs.select((F.col(level) - 1).alias("level"), F.col(run).alias("below"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    return a.join(b, "level").where("a_low <= b_high AND b_low <= a_high").select("level", "run", "below")


def level_budget(base: int, fanout: int, level: Column) -> Column:
    """Keys that a level may hold: base * fanout ** (level - 1). (O202)"""
    return (F.lit(base) * F.pow(F.lit(fanout), level - 1)).cast("long")


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """(O157, O165)"""
    return df.join(gone.select(*keys), keys, "left_anti")
