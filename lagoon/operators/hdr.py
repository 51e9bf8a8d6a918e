"""Log-linear histograms as rows (groups, bucket, c): mergeable by sum, visible to the optimiser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.numeric import bit_length, hdr_bucket, hdr_lower


def record(df: DataFrame, groups: list[str], x: str, bits: int, weight: Column | None = None) -> DataFrame:
    """(O070, O083)"""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*groups, hdr_bucket(x, bits).alias("bucket")).agg(n.alias("c"))


def backfill(df: DataFrame, x: str, interval: int) -> DataFrame:
    """Adds the samples that a stalled recorder left out: x - i, x - 2i, ... down to i. (O071)"""
    late = df.where((F.lit(interval) > 0) & (F.col(x) - interval >= interval))
    more = late.withColumn(x, F.explode(F.sequence(F.col(x) - interval, F.lit(interval).cast("long"), F.lit(-interval).cast("long"))))
    return df.unionByName(more)


def merge(*histograms: DataFrame) -> DataFrame:
    """(O077)"""
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    return out.groupBy(*(c for c in out.columns if c != "c")).agg(F.sum("c").alias("c"))


def decayed(df: DataFrame, groups: list[str], x: str, bits: int, age: Column, half_life: float) -> DataFrame:
    """Counts that halve with each half-life of age. (O079)"""
    return record(df, groups, x, bits, F.pow(F.lit(0.5), age / F.lit(half_life)))


def _running(h: DataFrame, groups: list[str]) -> DataFrame:
    w = Window.partitionBy(*groups)
    return h.withColumn("cum", F.sum("c").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("c").over(w))


def quantiles(h: DataFrame, groups: list[str], bits: int, qs: dict[str, float]) -> DataFrame:
    """Least value of the first bucket whose running count reaches max(1, floor(q * total)). (O072, O078)"""
    run = _running(h, groups)
    target = lambda q: F.greatest(F.lit(1), F.floor(F.lit(float(q)) * F.col("total").cast("double")))
    return run.groupBy(*groups).agg(F.sum("c").alias("n"), *(F.min(F.when(F.col("cum") >= target(q), hdr_lower("bucket", bits))).alias(k) for k, q in qs.items()))


def share_at_or_below(h: DataFrame, groups: list[str], bits: int, value: int) -> DataFrame:
    """(O073, O074)"""
    at = hdr_bucket(F.lit(value).cast("long"), bits)
    return h.groupBy(*groups).agg(
        F.round(F.sum(F.when(F.col("bucket") <= at, F.col("c")).otherwise(0)) / F.sum("c").cast("double"), 9).alias("share"),
        F.sum(F.when(F.col("bucket") == at, F.col("c")).otherwise(0)).alias("count_at"),
    )


def summary(h: DataFrame, groups: list[str], bits: int) -> DataFrame:
    """Least, largest and mean of the buckets' least values. (O075)"""
    low = hdr_lower("bucket", bits)
    return h.groupBy(*groups).agg(F.min(low).alias("min"), F.max(low).alias("max"), F.round(F.sum(low * F.col("c")) / F.sum("c").cast("double"), 6).alias("mean"), F.sum("c").alias("n"))


def linear_bands(h: DataFrame, groups: list[str], bits: int, width: int) -> DataFrame:
    """(O080)"""
    bands = h.groupBy(*groups, (F.floor(hdr_lower("bucket", bits) / width) * width).alias("lo")).agg(F.sum("c").alias("n"))
    w = Window.partitionBy(*groups).orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    return bands.select(*groups, "lo", (F.col("lo") + width).alias("hi"), "n", F.sum("n").over(w).alias("cumulative"))


def log_bands(h: DataFrame, groups: list[str], bits: int) -> DataFrame:
    """Power-of-two bands from 1, and one for 0. (O081, O196)"""
    low = hdr_lower("bucket", bits)
    bands = h.groupBy(*groups, bit_length(low).alias("band")).agg(F.sum("c").alias("n"))
    lo = F.when(F.col("band") == 0, 0).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.col("band") - 1, F.lit(0))))
    w = Window.partitionBy(*groups).orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    return bands.select(*groups, "band", lo.cast("long").alias("lo"), "n", F.sum("n").over(w).alias("cumulative"))


def percentile_steps(h: DataFrame, groups: list[str], bits: int, step: int) -> DataFrame:
    """The first bucket that reaches each percentage. (O082, O198)"""
    run = _running(h, groups)
    rows = run.select("*", F.explode(F.sequence(F.lit(step), F.lit(100), F.lit(step))).alias("pct"))
    reach = F.greatest(F.lit(1), F.ceil(F.col("total") * F.col("pct") / 100.0))
    return rows.where(F.col("cum") >= reach).groupBy(*groups, "pct").agg(F.min(hdr_lower("bucket", bits)).alias("value"))


def intervals(df: DataFrame, groups: list[str], ts: str, x: str, bits: int, every: str) -> DataFrame:
    """A histogram for each tumbling interval. (O084, O215)"""
    return record(df.withColumn("start", F.window(ts, every)["start"]), [*groups, "start"], x, bits)
