"""Exact statistics of integer samples by group. Empty groups don't exist; where a rule needs more values than a group has, its result is named in each function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.numeric import log2_bucket, ordered_bucket
from lagoon.operators.ranks import at_ranks, offsets, picks


def _ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0)), digits)


def facade(df: DataFrame, groups: list[str], x: str) -> DataFrame:
    """p50, p90, p99, p999, max and count. (O051)"""
    return picks(df, groups, x, {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999, "max": 1.0})


def sweep(df: DataFrame, groups: list[str], x: str, start: float, end: float, step: float) -> DataFrame:
    """(groups, q, value) on a grid whose points add up in double arithmetic; the end is there only if the grid meets it. (O052, O192)"""
    grid, q = [], start
    while q <= end + 1e-12:
        grid.append(q)
        q += step
    names = {f"q{i}": v for i, v in enumerate(grid)}
    wide = picks(df, groups, x, names)
    cells = F.array(*(F.struct(F.lit(round(v, 9)).alias("q"), F.col(k).alias("value")) for k, v in names.items()))
    return wide.select(*groups, F.explode(cells).alias("c")).select(*groups, "c.q", "c.value")


def means(df: DataFrame, groups: list[str], x: str) -> DataFrame:
    """Whole mean, cut towards zero, and the count. (O053)"""
    return df.groupBy(*groups).agg(F.expr(f"sum({x}) div count({x})").alias("mean"), F.count(x).alias("n"))


def moments(df: DataFrame, groups: list[str], x: str) -> DataFrame:
    """Spread and shape around the whole mean: stddev (0 below 2 values), cov (0 where the mean is 0), skewness (0 below 3), kurtosis in excess (0 below 4). (O054, O057-O059)"""
    centre = means(df, groups, x)
    d = (F.col(x) - F.col("mean")).cast("double")
    rows = df.join(centre, groups) if groups else df.crossJoin(F.broadcast(centre))
    sums = rows.groupBy(*groups).agg(F.max("mean").alias("mean"), F.max("n").alias("n"), *(F.sum(F.pow(d, F.lit(k))).alias(f"s{k}") for k in (2, 3, 4)))
    n = F.col("n")
    m2, m3, m4 = (F.col(f"s{k}") / n for k in (2, 3, 4))
    flat = F.col("s2") == 0
    sd = F.when(n < 2, 0).otherwise(F.round(F.sqrt(F.col("s2") / F.greatest(n - 1, F.lit(1))))).cast("long")
    return sums.select(
        *groups, "mean", sd.alias("stddev"), _ratio(sd, F.col("mean")).alias("cov"),
        F.round(F.when((n < 3) | flat, 0.0).otherwise(m3 / F.pow(m2, F.lit(1.5))), 6).alias("skewness"),
        F.round(F.when((n < 4) | flat, 0.0).otherwise(m4 / (m2 * m2) - 3), 6).alias("kurtosis"),
    )


def iqr(df: DataFrame, groups: list[str], x: str) -> DataFrame:
    """(O055)"""
    return picks(df, groups, x, {"p25": 0.25, "p75": 0.75}).select(*groups, F.greatest(F.col("p75") - F.col("p25"), F.lit(0)).alias("iqr"))


def mad(df: DataFrame, groups: list[str], x: str) -> DataFrame:
    """Median distance to the median, both by floor rank. (O056)"""
    middle = picks(df, groups, x, {"_median": 0.5}).drop("n")
    rows = df.join(middle, groups).withColumn("_d", F.abs(F.col(x) - F.col("_median")))
    return picks(rows, groups, "_d", {"mad": 0.5}).drop("n")


def tail_expectation(df: DataFrame, groups: list[str], x: str, q: float) -> DataFrame:
    """Whole mean of what is above the q-th value; without anything above, that value. (O060, O193)"""
    cut = picks(df, groups, x, {"cutoff": q}).drop("n")
    rows = df.join(cut, groups)
    above = F.col(x) > F.col("cutoff")
    tail = rows.groupBy(*groups, "cutoff").agg(F.sum(F.when(above, F.col(x))).alias("s"), F.count_if(above).alias("k"))
    return tail.select(*groups, "cutoff", F.expr("CASE WHEN k = 0 THEN cutoff ELSE s div k END").alias("cte"))


def hill(df: DataFrame, groups: list[str], x: str, k: int) -> DataFrame:
    """Tail index of the k largest: mean of ln(x / x_(k+1)); null where k < 2, not more than k values, or the pivot is 0. (O061)"""
    # coarse buckets first, so that only values of those that the k + 1 largest are in get sorted
    rows = df.select(*groups, x).where(F.col(x).isNotNull()).withColumn("_b", ordered_bucket(x))
    down = Window.partitionBy(*groups).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    upper = rows.groupBy(*groups, "_b").agg(F.count("*").alias("c")).withColumn("cum", F.sum("c").over(down)).where(f"cum - c <= {k}").select(*groups, "_b")
    counted = rows.join(upper, [*groups, "_b"], "left_semi").groupBy(*groups, x).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*groups).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, 0)
    above = counted.withColumn("cum", F.sum("c").over(w)).where(f"cum - c <= {k}")
    pivot = above.groupBy(*groups).agg(F.max(F.when((F.col("cum") > k) & (F.col("cum") - F.col("c") <= k), F.col(x))).alias("pivot"))
    rows = above.join(pivot, groups).where("pivot > 0")
    taken = F.greatest(F.lit(0), F.least(F.col("c"), F.lit(k) - (F.col("cum") - F.col("c"))))
    score = F.sum(taken * F.ln(F.col(x) / F.col("pivot"))) / k
    return rows.groupBy(*groups).agg(F.round(score, 6).alias("hill")).where(F.lit(k) >= 2)


def tail_fatness(df: DataFrame, groups: list[str], x: str) -> DataFrame:
    """p99 / p50. (O062)"""
    return picks(df, groups, x, {"p50": 0.5, "p99": 0.99}).select(*groups, _ratio(F.col("p99"), F.col("p50")).alias("fatness"))


def jitter(df: DataFrame, groups: list[str], x: str, order: str, bucket: Column, window: int = 32) -> DataFrame:
    """Coefficient of variation of the means of whole windows in arrival order, at most 1; 0 below two windows. (O063, O140)"""
    placed = offsets(df.select(*groups, x, order), [order], bucket, groups, "_at")
    means_ = placed.groupBy(*groups, F.floor(F.col("_at") / window).alias("_w")).agg(F.count("*").alias("_n"), F.avg(x).alias("_m")).where(f"_n = {window}")
    whole = means_.groupBy(*groups).agg(F.count("*").alias("k"), F.avg("_m").alias("m"), F.stddev_pop("_m").alias("s"))
    score = F.when((F.col("k") < 2) | (F.col("m") == 0), 0.0).otherwise(F.least(F.lit(1.0), F.col("s") / F.col("m")))
    every = df.select(*groups).distinct()
    return every.join(whole, groups, "left").select(*groups, F.round(F.coalesce(score, F.lit(0.0)), 6).alias("jitter"))


def log2_cdf(df: DataFrame, groups: list[str], x: str) -> DataFrame:
    """All 64 power-of-two buckets with their counts and running counts. (O064)"""
    counts = df.groupBy(*groups, log2_bucket(x).alias("bucket")).agg(F.count("*").alias("c"))
    frame = counts.select(*groups).distinct().select(*groups, F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bucket"))
    full = frame.join(counts, [*groups, "bucket"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    w = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("cumulative", F.sum("c").over(w)).withColumnRenamed("c", "n")


def ks_distance(df: DataFrame, side: str, x: str) -> DataFrame:
    """Largest distance between the distributions of the rows where side is true and where it is false; equal values count together. (O065, O191)"""
    counts = df.groupBy(x).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    # coarse ranges first, so that no task gets all values
    rows = counts.withColumn("_b", ordered_bucket(x))
    parts = rows.groupBy("_b").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    starts = parts.select("_b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ab"), *(F.sum(c).over(all_).alias(f"{c}n") for c in "ab"))
    w = Window.partitionBy("_b").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(F.broadcast(starts), "_b").select(*((F.col(f"{c}0") + F.sum(c).over(w)).alias(c) for c in "ab"), "an", "bn")
    gap = F.abs(F.try_divide(F.col("a").cast("double"), F.col("an")) - F.try_divide(F.col("b").cast("double"), F.col("bn")))
    return placed.agg(F.round(F.max(gap), 9).alias("ks"))


def cohens_d(df: DataFrame, side: str, x: str) -> DataFrame:
    """Difference of means over the pooled deviation; null for two values or fewer in all, 0 without spread. (O066, O194)"""
    v = F.col(x).cast("double")
    a, b = F.col(side), ~F.col(side)
    s = df.agg(*(f(F.when(c, v)).alias(f"{k}{n}") for c, n in ((a, "a"), (b, "b")) for f, k in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))))
    n = F.col("na") + F.col("nb")
    pooled = (F.coalesce("va", F.lit(0.0)) * (F.col("na") - 1) + F.coalesce("vb", F.lit(0.0)) * (F.col("nb") - 1)) / F.greatest(n - 2, F.lit(1))
    return s.select(F.round(F.when(n <= 2, None).when(pooled <= 0, 0.0).otherwise((F.col("mb") - F.col("ma")) / F.sqrt(pooled)), 6).alias("d"))


_STEP, _ADD, _MASK, _BLOCK, _CELLS = 6364136223846793005, 1442695040888963407, 2**64 - 1, 1 << 16, 4096


def _after(state: int, steps: int) -> int:
    """The generator's state some steps on, by squaring its step."""
    a, c = _STEP, _ADD
    while steps:
        if steps & 1:
            state = (state * a + c) & _MASK
        a, c = a * a & _MASK, (a + 1) * c & _MASK
        steps >>= 1
    return state


def _draws(blocks: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(_g, _round, _at, _c) of blocks of a group's one sequence of draws: how many of a round's draws are in each of _CELLS equal parts of the places or, where a block has the part `_only` of each round, at each place of that part."""
    kind = blocks.schema["_g"].dataType.simpleString()
    single = "_only" in blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        power = np.multiply.accumulate(np.full(_BLOCK, _STEP, np.uint64))
        add = np.cumsum(np.concatenate([np.ones(1, np.uint64), power[:-1]])) * np.uint64(_ADD)
        for b in batches:
            for i, (n, start) in enumerate(zip(b.column("_n").to_pylist(), b.column("_start").to_pylist(), strict=True)):
                m = min(_BLOCK, rounds * n - start)
                at = ((power[:m] * np.uint64(_after(seed & _MASK, start)) + add[:m]) % np.uint64(n)).astype(np.int64)
                turn = (start + np.arange(m)) // n
                cell, width = at * _CELLS // n, n if single else _CELLS
                if single:
                    mine = cell == np.array(b.column("_only")[i].as_py())[turn]
                    turn, cell = turn[mine], at[mine]
                found, c = np.unique(turn * width + cell, return_counts=True)
                own = b.column("_g").take(pa.array(np.full(len(found), i)))
                yield pa.RecordBatch.from_arrays([own, pa.array(found // width), pa.array(found % width), pa.array(c)], names=["_g", "_round", "_at", "_c"])

    spread = blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_g", "_start")
    made = spread.mapInArrow(run, f"_g {kind}, _round long, _at long, _c long").groupBy("_g", "_round", "_at").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy("_g", "_round").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return made.withColumn("_cum", F.sum("_c").over(w))


def bootstrap_ci(df: DataFrame, groups: list[str], x: str, q: float, rounds: int, confidence: float, seed: int) -> DataFrame:
    """Percentile interval of a quantile from resamples drawn by a fixed 64-bit generator. One group is one ordered draw, whose blocks are drawn apart; no task holds a group. (O067, O199)"""
    rows = df.where(F.col(x).isNotNull()).select(F.struct(*groups).alias("_g"), F.col(x).cast("long").alias("_x"))  # nulls in a struct are equal
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n"))
    blocks = sizes.select("_g", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") * rounds - 1, F.lit(_BLOCK).cast("long"))).alias("_start"))
    rank = F.least(F.col("_n") - 1, F.floor(F.lit(float(q)) * F.col("_n").cast("double")))
    parts = _draws(blocks, rounds, seed).join(sizes, "_g").withColumn("_rank", rank).where("_rank < _cum AND _rank >= _cum - _c")
    parts = parts.select("_g", "_round", F.col("_at").alias("_part"), (F.col("_rank") - F.col("_cum") + F.col("_c")).alias("_within"))
    only = parts.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_round", "_part")))["_part"].alias("_only"))  # one for each round
    places = _draws(blocks.join(only, "_g"), rounds, seed).join(parts, ["_g", "_round"]).where("_within < _cum AND _within >= _cum - _c")
    places = places.select("_g", "_round", F.col("_at").alias("_rank"))
    found = at_ranks(rows, ["_g"], "_x", places, "_rank")
    side = (1 - confidence) / 2
    return picks(found, ["_g"], "_x", {"low": side, "high": 1 - side}).select("_g.*", "low", "high")
