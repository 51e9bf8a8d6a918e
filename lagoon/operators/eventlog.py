"""Event logs: offsets, reads, folds, JSON, sagas and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.operators.ranks import positions
from lagoon.sources.scratch import scratch


def append_offsets(df: DataFrame, ts: str, tie: str) -> DataFrame:
    """0-based gapless offsets in order of time; bursts are spread over as many tasks as other stretches of so many rows. (O013)"""
    return positions(df, [ts, tie])


def read_from(log: DataFrame, offset: int) -> DataFrame:
    return log.where(F.col("offset") >= offset)  # (O014, O015)


def by_topic(log: DataFrame, topic_col: str, topic: str) -> DataFrame:
    return log.where(F.col(topic_col) == topic)  # (O016)


def event_json(topic: Column, level: Column, at: Column, message: Column, attributes: Column) -> Column:
    """Fields in fixed order, attributes sorted by name, absent fields left out. (O018, O182)"""
    sorted_ = F.map_from_entries(F.array_sort(F.map_entries(attributes)))
    return F.to_json(F.struct(topic.alias("topic"), level.alias("level"), at.alias("at"), message.alias("message"), F.when(F.size(attributes) > 0, sorted_).alias("attributes")))


def transitions(df: DataFrame, scope: str, ts: str, status: str, tie: str | None = None) -> DataFrame:
    """Changes of a status, of equal times in order of `tie` (else of the status itself); the first one of a scope is its baseline. (O132)"""
    w = Window.partitionBy(scope).orderBy(ts, tie or status)
    rows = df.withColumn("before", F.lag(status).over(w))
    return rows.where(F.col("before").isNotNull() & (F.col("before") != F.col(status)))


def transition_counts(changes: DataFrame, scope: str, status: str) -> DataFrame:
    """(O118, O119)"""
    return changes.groupBy(scope, F.col("before").alias("from"), F.col(status).alias("to")).agg(F.count("*").alias("n"))


def event_counts(df: DataFrame, topic: str, level: str) -> DataFrame:
    """(O119)"""
    return df.groupBy(topic, level).agg(F.count("*").alias("n"))


#: Statuses from best to worst. (O113)
STATUSES = ("UP", "UNKNOWN", "WARN", "DEGRADED", "DOWN")


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUSES)), status) - 1


def status_name(rank: Column) -> Column:
    """The empty fold is UP. (O113)"""
    return F.element_at(F.array(*map(F.lit, STATUSES)), F.coalesce(rank, F.lit(0)).cast("int") + 1)


def worst(df: DataFrame, groups: list[str], status: str) -> DataFrame:
    """(O113, O114)"""
    return df.groupBy(*groups).agg(status_name(F.max(status_rank(F.col(status)))).alias("status"))


def views(df: DataFrame, kinds: Column, into: str = "kind") -> DataFrame:
    """A row for each kind of probe that a component answers to. (O034)"""
    return df.withColumn(into, F.explode(kinds))


def health_view(df: DataFrame, groups: list[str], status: str, critical: str) -> DataFrame:
    """Worst status, where what isn't critical counts as WARN at most. (O115)"""
    rank = status_rank(F.col(status))
    shown = F.when(~F.col(critical) & (rank >= 3), 2).otherwise(rank)
    return df.groupBy(*groups).agg(status_name(F.max(shown)).alias("status"))


def effective(nodes: DataFrame, node: str, parent: str, status: str) -> DataFrame:
    """(node, status) of nested components: the worst of a node's own status and all below it, however deep; a null parent is the top. A node may have several parents, and nodes that contain each other share the worst of all. (O114)

    Each step hands statuses one level up, until none gets worse.
    """
    spark = nodes.sparkSession
    rows = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), status_rank(F.col(status)).alias("r"))
    edges = rows.where("parent IS NOT NULL").select("node", "parent").distinct()
    now = rows.groupBy("node").agg(F.max("r").alias("r"))
    while True:
        up = edges.join(now, "node").groupBy(F.col("parent").alias("node")).agg(F.max("r").alias("below"))
        path = scratch(spark, "status")
        step = now.join(up, "node", "left").select("node", F.greatest("r", "below").alias("r"), F.coalesce(F.col("below") > F.col("r"), F.col("below").isNotNull()).alias("moved"))
        step.write.parquet(path)
        done = spark.read.schema(step.schema).parquet(path)
        now = done.select("node", "r")
        if done.where("moved").isEmpty():
            return now.select("node", status_name(F.col("r")).alias("status"))


def health_json(entries: DataFrame, groups: list[str], name: str, status: str, age_ms: str, stale_: str, refreshed_at: Column) -> DataFrame:
    """(groups, json): the worst status, and every component by name in order. (O183)"""
    entry = F.struct(F.col(name).alias("k"), F.struct(F.col(status).alias("status"), F.col(age_ms).alias("age_ms"), F.col(stale_).alias("stale")).alias("v"))
    rows = entries.groupBy(*groups).agg(status_name(F.max(status_rank(F.col(status)))).alias("status"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("components"))
    return rows.select(*groups, F.to_json(F.struct("status", refreshed_at.alias("refreshed_at"), "components")).alias("json"))


def http_code(status: Column) -> Column:
    """(O116)"""
    return F.when(status == "DOWN", 503).otherwise(200)


def stale(now: Column, refreshed: Column, interval: Column, factor: float) -> Column:
    """(O117)"""
    return (now - refreshed).cast("double") > interval.cast("double") * factor


def saga_reports(steps: DataFrame, saga: str, position: str, step: str, forward_ok: str, compensate_ok: str) -> DataFrame:
    """Outcome of each saga: steps run forward up to the first failure, then those before it are compensated in reverse. (O223)"""
    failed = steps.groupBy(saga).agg(F.min(F.when(~F.col(forward_ok), F.col(position))).alias("_at"))
    rows = steps.join(failed, saga)
    ran = F.col("_at").isNull() | (F.col(position) < F.col("_at"))
    undone = F.col("_at").isNotNull() & (F.col(position) < F.col("_at"))
    item = F.struct(F.col(position).alias("p"), F.col(step).alias("s"))
    back = F.struct((-F.col(position)).alias("p"), F.col(step).alias("s"))
    names = lambda c: F.transform(F.array_sort(c), lambda x: x["s"])
    out = rows.groupBy(saga).agg(
        F.max(F.when(F.col(position) == F.col("_at"), F.col(step))).alias("failed_step"),
        names(F.collect_list(F.when(ran, item))).alias("forward_ran"),
        names(F.collect_list(F.when(undone & F.col(compensate_ok), back))).alias("compensated"),
        names(F.collect_list(F.when(undone & ~F.col(compensate_ok), back))).alias("failures"),
    )
    outcome = F.when(F.col("failed_step").isNull(), "COMMITTED").when(F.size("failures") > 0, "COMPENSATION_FAILED").otherwise("COMPENSATED")
    return out.withColumn("outcome", outcome)


def saga_json(reports: DataFrame, saga: str) -> DataFrame:
    """(O184)"""
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return reports.select(saga, F.to_json(F.struct(F.col(saga).alias("saga"), "outcome", "failed_step", some("forward_ran"), some("compensated"), some("failures"))).alias("json"))
