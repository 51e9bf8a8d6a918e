"""Telemetry: bucketed histograms, quantiles from them, exemplars, exposition lines and divergence."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.operators.ranks import in_order


def bounded_histogram(df: DataFrame, groups: list[str], x: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts for every upper bound and +Inf. (O085)"""
    at = F.array(*map(F.lit, bounds))
    place = F.size(F.filter(at, lambda b: b < F.col(x)))
    counts = df.groupBy(*groups, place.alias("_i")).agg(F.count("*").alias("_c"))
    frame = counts.select(*groups).distinct().select(*groups, F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))).alias("_i"))
    full = frame.join(counts, [*groups, "_i"], "left")
    w = Window.partitionBy(*groups).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    le = F.try_element_at(at, F.col("_i") + 1).cast("double")
    return full.select(*groups, F.coalesce(le, F.lit(float("inf"))).alias("le"), F.sum(F.coalesce("_c", F.lit(0))).over(w).alias("n"))


def histogram_quantile(h: DataFrame, groups: list[str], q: float) -> DataFrame:
    """Linear interpolation inside the bucket that reaches the rank; in the last one its lower bound. (O086)"""
    w = Window.partitionBy(*groups).orderBy("le")
    rows = h.withColumn("_n0", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("_lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_t", F.max("n").over(Window.partitionBy(*groups)))
    rank = F.lit(q) * F.col("_t")
    hit = rows.where((F.col("n") >= rank) & (F.col("_n0") < rank))
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * (rank - F.col("_n0")) / (F.col("n") - F.col("_n0"))
    return hit.groupBy(*groups).agg(F.round(F.min(F.when(F.col("le") == float("inf"), F.col("_lo")).otherwise(inside)), 6).alias("value"))


def exemplars(df: DataFrame, groups: list[str], x: str, arrival: str, k: int) -> DataFrame:
    """The k slowest of each group; of equals the earlier. (O139)"""
    number = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(x), arrival))
    return df.withColumn("_k", number).where(F.col("_k") <= k).drop("_k")


def _retained(df: DataFrame, groups: list[str], x: str, arrival: str, k: int) -> DataFrame:
    """Rows that are among the k greatest of those up to them; of equals the earlier ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []
        for b in batches:
            kept = []
            for i, (v, *key) in enumerate(zip(*(b.column(c).to_pylist() for c in (x, *groups)), strict=True)):
                if key != of:
                    of, held = key, []
                if len(held) < k:
                    heapq.heappush(held, v)
                elif v > held[0]:
                    heapq.heapreplace(held, v)
                else:
                    continue
                kept.append(i)
            yield b.take(pa.array(kept, pa.int64()))

    return in_order(df, groups, [arrival]).mapInArrow(run, df.schema)


def retained_exemplars(df: DataFrame, groups: list[str], x: str, arrival: str, k: int, every: int = 1 << 16) -> DataFrame:
    """Every sample that was among the k slowest of its group when it arrived, in order of `arrival`, a number that no two share; nulls are no samples. How many there are is what a reservoir's counter shows. (O120, O139)

    What isn't among the k greatest of its own stretch of `every` arrivals up to it never
    is among those of all, so stretches are sifted side by side, and only the few rows
    that they leave go by in order.
    """
    rows = df.where(F.col(x).isNotNull()).withColumn("_s", F.floor(F.col(arrival) / every))
    return _retained(_retained(rows, [*groups, "_s"], x, arrival, k).drop("_s"), groups, x, arrival, k)


def slowest(df: DataFrame, groups: list[str], x: str, k: int) -> DataFrame:
    """(O153)"""
    return df.groupBy(*groups).agg(F.max(x).alias("max")).orderBy(F.desc("max"), *groups).limit(k)


def divergence(expected: DataFrame, observed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose values differ or are on one side only. (O047)"""
    a = expected.select(*keys, F.col(value).alias("expected"))
    b = observed.select(*keys, F.col(value).alias("observed"))
    return a.join(b, keys, "full_outer").where(~F.col("expected").eqNullSafe(F.col("observed")))


def metric_name(name: Column) -> Column:
    """Other characters than letters, digits, _ and : become _, and so does what stands before a leading digit. (O189)"""
    clean = F.regexp_replace(name, "[^a-zA-Z0-9_:]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def label_value(value: Column) -> Column:
    """(O189)"""
    v = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.replace(v, F.lit('"'), F.lit('\\"'))


def exposition(name: Column, labels: Column, value: Column) -> Column:
    """One line of the text format; labels sorted by name. (O026)"""
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), label_value(e["value"]), F.lit('"')))
    return F.concat(metric_name(name), F.lit("{"), F.concat_ws(",", parts), F.lit("} "), value.cast("string"))


def summary_rows(df: DataFrame, stage: str, values: list[str]) -> DataFrame:
    """A row for each percentile of a stage. (O029)"""
    cells = F.array(*(F.struct(F.lit(v).alias("percentile"), F.col(v).cast("long").alias("value")) for v in values))
    return df.select(stage, F.explode(cells).alias("c")).select(stage, "c.*")


def spans(df: DataFrame, timer: str, since_start: str, order: str) -> DataFrame:
    """Marks of a timer as spans, each from the mark before. (O030)"""
    w = Window.partitionBy(timer).orderBy(since_start, order)
    return df.withColumn("start", F.coalesce(F.lag(since_start).over(w), F.lit(0))).withColumn("end", F.col(since_start))


def stage_counters(df: DataFrame, stage: str, dropped: str) -> DataFrame:
    """Operations of each stage and how many of them were dropped. (O120)"""
    return df.groupBy(stage).agg(F.count("*").alias("ops_total"), F.count_if(F.col(dropped)).alias("dropped_total"))


def in_flight(df: DataFrame, groups: list[str], start: str, end: str, every: int) -> DataFrame:
    """(groups, at, most, left) for each stretch of `every` in which something starts or ends: the most operations under way at once, and those under way when it ends. An operation is under way from its start up to, and not at, its end; those without an end stay. (O120)

    Starts and ends of one time are netted; only a stretch's times are sorted together,
    and the sums of the stretches before are added.
    """
    edge = lambda c, n: df.where(F.col(c).isNotNull()).select(*groups, F.col(c).alias("_t"), F.lit(n).alias("_n"))
    moves = edge(start, 1).unionByName(edge(end, -1)).groupBy(*groups, "_t").agg(F.sum("_n").alias("_n"))
    moves = moves.withColumn("at", F.floor(F.col("_t") / every) * every)
    inside = moves.withColumn("_run", F.sum("_n").over(Window.partitionBy(*groups, "at").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)))
    stretches = inside.groupBy(*groups, "at").agg(F.max("_run").alias("_most"), F.sum("_n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stretches.select(*groups, "at", (before + F.greatest("_most", F.lit(0))).alias("most"), (before + F.col("_n")).alias("left"))


def timer_totals(spans_: DataFrame, timer: str) -> DataFrame:
    """Spans of each timer, their total and their greatest length. (O123)"""
    length = F.col("end") - F.col("start")
    return spans_.groupBy(timer).agg(F.count("*").alias("spans"), F.sum(length).alias("total"), F.max(length).alias("longest"))


def due(df: DataFrame, now: Column, refreshed: str, interval: Column) -> DataFrame:
    """What was refreshed an interval ago or longer. (O221)"""
    return df.where(now - F.col(refreshed) >= interval)
