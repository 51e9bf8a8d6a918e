"""Ordered lookups.

Keys and probes are sorted together by range partitions of equal shares; what the
partitions before one end with comes from one row for each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagoon.operators.ranks import ordered

MODES = ("floor", "ceiling", "predecessor", "successor")


def nearest(probes: DataFrame, keys: DataFrame, on: str, mode: str, into: str = "found") -> DataFrame:
    """The probes with the key at or next to theirs, or null: floor <=, ceiling >=, predecessor <, successor >. (O040-O043)"""
    if mode not in MODES:
        raise ValueError(f"no lookup {mode!r}")
    up = mode in ("ceiling", "successor")
    own_first = mode in ("floor", "ceiling")
    at = F.col(on) if not up else -F.col(on)
    rest = [c for c in probes.columns if c != on]
    marked = keys.select(on).distinct().select(on, F.lit(0 if own_first else 1).alias("_kind"), F.col(on).alias("_key"), F.lit(False).alias("_probe"), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in rest))
    asked = probes.select(on, F.lit(1 if own_first else 0).alias("_kind"), F.lit(None).cast(keys.schema[on].dataType).alias("_key"), F.lit(True).alias("_probe"), *rest)
    rows = ordered(marked.unionByName(asked).withColumn("_at", at), ["_at", "_kind", *rest])
    ends = rows.groupBy("_part").agg(F.max_by("_key", F.when(F.col("_key").isNotNull(), F.col("_row"))).alias("_end"))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    before = ends.select("_part", last("_end", Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row for each partition of the sort
    within = rows.withColumn("_in", last("_key", Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)))
    found = within.where("_probe").join(F.broadcast(before), "_part")
    return found.select(on, *rest, F.coalesce("_in", "_before").alias(into))


def disjoint_union(low: DataFrame, high: DataFrame, key: str) -> DataFrame:
    """All rows of two ranges of keys; fails unless every key of the first is below every key of the second. (O048, O159)"""
    ends = low.agg(F.max(key).alias("a")).crossJoin(high.agg(F.min(key).alias("b")))
    checked = ends.select(F.when(F.col("a") >= F.col("b"), F.raise_error(F.lit("the ranges of keys overlap")).cast("boolean")).alias("_bad"))
    return low.unionByName(high).crossJoin(F.broadcast(checked)).where("_bad IS NULL").drop("_bad")


def build_report(df: DataFrame, key: str) -> DataFrame:
    """Keys of a bulk build, and how many of them are there more than once; the latter must be 0 for `sorted_build`. (O148)"""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"))


def sorted_build(df: DataFrame, key: str) -> DataFrame:
    """The rows in order of their keys; fails where a key is there twice. (O148)"""
    n = F.count("*").over(Window.partitionBy(key))
    once = df.withColumn("_bad", F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("boolean")))
    return once.where("_bad IS NULL").drop("_bad").orderBy(key)


def lookup(df: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """All probes, with what is stored under their keys. (O044)"""
    return probes.join(df, keys, "left")


def between(df: DataFrame, key: str, low=None, high=None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """Rows of a key range; a bound of None is open-ended. (O144, O145, O149, O150)"""
    c = F.col(key)
    if low is not None:
        df = df.where(c > low if low_open else c >= low)
    if high is not None:
        df = df.where(c < high if high_open else c <= high)
    return df


def merge_sorted(*streams: DataFrame, by: list[str], descending: bool = False) -> DataFrame:
    """All rows of the streams in order. (O142, O143, O154)"""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out.orderBy(*(F.desc(c) if descending else F.asc(c) for c in by))


def ends(df: DataFrame, key: str) -> DataFrame:
    """First and last row by key. (O147)"""
    rows = F.struct(*df.columns)
    both = df.agg(F.min_by(rows, key).alias("first"), F.max_by(rows, key).alias("last"))
    return both.select(F.explode(F.array(F.struct(F.lit("first").alias("side"), F.col("first").alias("r")), F.struct(F.lit("last").alias("side"), F.col("last").alias("r")))).alias("e")).select("e.side", "e.r.*")


def top_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys; ties go to the lesser key. (O099, O152)"""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def split_at(df: DataFrame, key: str, pivot) -> tuple[DataFrame, DataFrame]:
    """(O158)"""
    return df.where(F.col(key) < pivot), df.where(F.col(key) >= pivot)


def prefix_fanout(df: DataFrame, key: str, depth: int) -> DataFrame:
    """Of each prefix of so many characters: different next characters, and the node size that holds them (4, 16, 48 or 256). (O124)"""
    rows = df.where(F.length(key) > depth).select(F.substring(key, 1, depth).alias("prefix"), F.substring(key, depth + 1, 1).alias("next")).distinct()
    n = F.col("children")
    return rows.groupBy("prefix").agg(F.count("*").alias("children")).withColumn("node", F.when(n <= 4, 4).when(n <= 16, 16).when(n <= 48, 48).otherwise(256))
