"""Exact order statistics without sorting a group in one task.

Values are counted by a coarse order-keeping bucket; the bucket that holds each
wanted rank is found in those few counts, and only its values are counted one by
one. Both counts are pre-aggregated before their shuffles.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.numeric import ordered_bucket
from lagoon.sources.scratch import scratch


def _targets(df: DataFrame, groups: list[str], x: str, quantiles: dict[str, float]) -> DataFrame:
    counts = df.where(F.col(x).isNotNull()).groupBy(*groups, ordered_bucket(x).alias("_b")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*groups)
    running = counts.withColumn("_cum", F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    asked = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(q)).alias("q")) for k, q in quantiles.items()))
    rows = running.select("*", F.explode(asked).alias("_a"))
    # rank by the floor rule in double arithmetic: 0-based min(n - 1, floor(q * n))
    rank = F.least(F.col("_n"), F.floor(F.col("_a.q") * F.col("_n").cast("double")) + 1)
    return rows.withColumn("_rank", rank).where("_rank <= _cum AND _rank > _cum - _c").select(*groups, "_b", F.col("_a.name").alias("_name"), (F.col("_rank") - F.col("_cum") + F.col("_c")).alias("_rank"), "_n")


def picks(df: DataFrame, groups: list[str], x: str, quantiles: dict[str, float], count: str = "n") -> DataFrame:
    """One row for each group: the value at each named quantile, and the number of values. Nulls don't count. (O050, O051)"""
    targets = _targets(df, groups, x, quantiles)
    wanted = targets.select(*groups, "_b").distinct()
    values = df.select(*groups, x).where(F.col(x).isNotNull()).withColumn("_b", ordered_bucket(x)).join(wanted, [*groups, "_b"], "left_semi")
    fine = values.groupBy(*groups, "_b", x).agg(F.count("*").alias("_c"))
    running = fine.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*groups, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)))
    found = running.join(targets, [*groups, "_b"]).where("_rank <= _cum AND _rank > _cum - _c")
    return found.groupBy(*groups).agg(*(F.max(F.when(F.col("_name") == k, F.col(x))).alias(k) for k in quantiles), F.max("_n").alias(count))


def at_ranks(df: DataFrame, groups: list[str], x: str, wanted: DataFrame, rank: str) -> DataFrame:
    """The rows of `wanted` (groups, any others, 0-based rank) with the value of that rank in its group as `x`. Nulls don't count."""
    rows = df.select(*groups, x).where(F.col(x).isNotNull()).withColumn("_b", ordered_bucket(x))
    running = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy(*groups, "_b").agg(F.count("*").alias("_c")).withColumn("_cum", F.sum("_c").over(running))
    here = (F.col(rank) < F.col("_cum")) & (F.col(rank) >= F.col("_cum") - F.col("_c"))
    targets = wanted.join(counts, groups).where(here).withColumn("_within", F.col(rank) - F.col("_cum") + F.col("_c")).drop("_c", "_cum")
    fine = rows.join(targets.select(*groups, "_b").distinct(), [*groups, "_b"], "left_semi").groupBy(*groups, "_b", x).agg(F.count("*").alias("_c"))
    placed = fine.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*groups, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)))
    return targets.join(placed, [*groups, "_b"]).where("_within < _cum AND _within >= _cum - _c").drop("_b", "_within", "_c", "_cum")


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows for an ordered fold by an iterator: each key's stand together in one partition, in order, and are sorted outside Python's memory."""
    dealt = df.repartition(*keys) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order)


_ROW_BITS = 33


def ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows, written once in a total order, with `_part`, the partition of the sort, and `_row`, which rises with the order. Partitions are ranges of equal shares, whatever value or stretch most rows have."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "ordered")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path).withColumn("_part", F.shiftright("_row", _ROW_BITS))


def positions(df: DataFrame, order: list[str], groups: list[str] | None = None, into: str = "offset") -> DataFrame:
    """Gapless 0-based positions in an order, overall or in each group: by range partitions, whose counts are added up, so a hot group or moment is spread like any other rows. (O013)"""
    groups = groups or []
    rows = ordered(df, [*groups, *order])
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each partition of the sort
    at = F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = rows.join(F.broadcast(starts), "_part").withColumn(into, at).drop("_part", "_start", "_row")
    if not groups:
        return placed
    first = placed.groupBy(*(F.col(g).alias(f"_of_{g}") for g in groups)).agg(F.min(into).alias("_first"))
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups]
    return placed.join(first, reduce(and_, same)).withColumn(into, F.col(into) - F.col("_first")).drop("_first", *(f"_of_{g}" for g in groups))


def offsets(df: DataFrame, order: list[str], bucket, groups: list[str] | None = None, into: str = "offset") -> DataFrame:
    """Gapless 0-based positions in an order, overall or in each group. `bucket` is an expression that keeps the order; only a bucket's rows are sorted together, and buckets are offset by their counts. (O013)"""
    groups = groups or []
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(*groups, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    placed = rows.join(starts, [*groups, "_b"])
    return placed.withColumn(into, F.col("_start") + F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(*order)) - 1).drop("_b", "_start")
