"""Streaming forms: projections, windows, transitions, timers, fan-out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from lagoon.operators.versions import latest


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _folders(spark: SparkSession, target: str) -> dict[str, int]:
    """Finished folders of a projection by name, with their versions."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    done = [n for n in names if n.startswith(("batch-", "merged-")) and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS"))]
    return {n: int(n.partition("-")[2]) for n in done}


def _current(spark: SparkSession, target: str) -> tuple[list[str], list[str], int]:
    """Folders that hold a projection, folders that a later merge has replaced, and the newest version."""
    found = _folders(spark, target)
    base = max((v for n, v in found.items() if n.startswith("merged-")), default=-1)
    own = [n for n, v in found.items() if v > base or n == f"merged-{base}"]
    return own, [n for n in found if n not in own], max(found.values(), default=-1)


def projection(spark: SparkSession, target: str, groups: list[str], schema) -> DataFrame:
    """What a projection holds by now: the newest row of each group, over the last merge and all batches since. (O213)"""
    own, _, _ = _current(spark, target)
    if not own:
        return spark.createDataFrame([], schema)
    versioned = StructType([*schema.fields, StructField("_version", LongType())])
    return latest(spark.read.schema(versioned).parquet(*(f"{target}/{n}" for n in own)), groups, "_version").drop("_version").select(*schema.names)


def catch_up(stream: DataFrame, groups: list[str], aggregates: list[Column], target: str, checkpoint: str | None = None) -> DataFrame:
    """A projection of all that a stream holds by now. Each batch folds only what is new, and writes only the groups that it changed, with its number, to a folder of its own under `target`, which all executors must share; a batch that runs again writes the same folder. The result equals a full replay; with a checkpoint a later call goes on where this one ended. (O212, O213)"""
    folded = stream.groupBy(*groups).agg(*aggregates)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch-{number}")

    writer = folded.writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return projection(stream.sparkSession, target, groups, folded.schema)


def compact(spark: SparkSession, target: str, groups: list[str], schema) -> None:
    """Merges a projection's folders into one; those it replaces go once it is whole. Not beside a running `catch_up`. (O213, O160)"""
    own, _, version = _current(spark, target)
    if len(own) > 1:
        merged = projection(spark, target, groups, schema).withColumn("_version", F.lit(version).cast("long"))
        merged.write.mode("overwrite").parquet(f"{target}/merged-{version}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in _current(spark, target)[1]:
        path(target).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(f"{target}/{name}"), True)


def settle(stream: DataFrame, target: str, checkpoint: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Runs a stream of appended rows over all that its sources hold by now; its rows so far, and what the query says of each batch. Rows go to Parquet under `target`, each once."""
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint or f"{target}/_checkpoint")
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target), list(query.recentProgress)


def interval_join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, within: str, late: str, how: str = "inner") -> DataFrame:
    """Pairs of two streams' rows of one key where the right one follows the left one within an interval.

    Both sides keep the rows that can still find a partner, and drop them as the
    watermark (the lesser of the two sides') passes; with `left_outer` a left row without
    any comes out, with nulls, as its state goes. (O225)
    """
    a = left.withWatermark(left_ts, late).alias("a")
    b = right.withColumnRenamed(on, "_on").withWatermark(right_ts, late).alias("b")
    follows = (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(on) == F.col("_on")) & follows, how).drop("_on")


def sliding_counts(stream: DataFrame, ts: str, key: str, size: str, slide: str, late: str) -> DataFrame:
    """(O214-O216)"""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide), key).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """(O225)"""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], where: list[Column | None] | None = None, checkpoint: str | None = None):
    """Every batch goes to every sink, filtered for it. (O019, O020, O031, O208-O211, O227)"""
    conditions = where or [None] * len(sinks)

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink, condition in zip(sinks, conditions, strict=True):
                sink(batch if condition is None else batch.where(condition), number)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


class Transitions(StatefulProcessor):
    """Emits a row when a key's status differs from its last one; the first is its baseline. (O132)"""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        before = self._last.get()[0] if self._last.exists() else None
        for pdf in rows:
            for r in pdf.sort_values(["ts", *(["seq"] if "seq" in pdf else [])], kind="stable").itertuples(index=False):
                if before is not None and before != r.status:
                    out.append((key[0], r.ts, before, r.status))
                before = r.status
        if before is not None:
            self._last.update((before,))
        yield pd.DataFrame(out, columns=["scope", "ts", "before", "status"])

    def close(self) -> None:
        pass


def transitions(stream: DataFrame) -> DataFrame:
    """Status changes of a stream (scope, ts, status, and seq to order equal times if there)."""
    _states(stream.sparkSession)
    return stream.groupBy("scope").transformWithStateInPandas(Transitions(), "scope long, ts timestamp, before string, status string", "Append", "None")


#: Groups that keys are dealt to by hash. A state processor is called for a group with all that a batch brings for its keys, as a call costs far more than a key's few rows.
GROUPS = 4093


class Keys(StatefulProcessor):
    """The keys of a group: their state as one list, read and written once a batch, and one timer, at the first time that one of them waits for. Without `ends` nothing ends."""

    values = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getListState("keys", f"key long, none boolean, {self.values}")

    def ends(self, *values: int) -> int | None:
        """Milliseconds of event time after which a key has no state."""

    def _held(self) -> dict[tuple, tuple]:
        """Values by (key, whether it's null)."""
        return {(r[0], r[1]): tuple(r[2:]) for r in self._rows.get()} if self._rows.exists() else {}

    def _hold(self, held: dict[tuple, tuple]) -> None:
        if held:
            self._rows.put([(*k, *v) for k, v in held.items()])
        else:
            self._rows.clear()
        end = min((e for v in held.values() if (e := self.ends(*v)) is not None), default=None)
        if end is not None:
            self._handle.registerTimer(end)

    def _stop(self) -> None:
        for at in list(self._handle.listTimers()):
            self._handle.deleteTimer(at)

    def ended(self, gone: dict[tuple, tuple]) -> Iterator[pd.DataFrame]:
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), self._held()
        gone = {k: v for k, v in held.items() if self.ends(*v) <= now}
        self._hold({k: v for k, v in held.items() if k not in gone})
        return self.ended(gone)

    def close(self) -> None:
        pass


def _in_order(rows: Iterator[pd.DataFrame], by: list[str], columns: list[str]) -> Iterator[tuple]:
    pdf = pd.concat(list(rows)).sort_values(by)
    return zip(*(pdf[c].tolist() for c in columns), strict=True)


class Gcra(Keys):
    """Streaming admission by a virtual schedule, one state value a key. (O134)

    With `evict`, a timer drops a key's state once the watermark has passed its due
    time: a call after that finds the schedule behind it, as a new key's does, so
    nothing is lost. (O138)
    """

    values = "due long"

    def __init__(self, interval: int, burst: int, evict: bool) -> None:
        self._interval, self._burst, self._evict = interval, burst, evict

    def ends(self, due: int) -> int | None:
        return -(-due // 1000) if self._evict else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._held(), []
        for user, none, call, now in _in_order(rows, ["now", "call"], ["key", "null_key", "call", "now"]):
            due = held.get((user, none), (0,))[0]
            after = max(due, now) + self._interval
            granted = now >= after - self._burst * self._interval
            held[user, none] = (after if granted else due,)
            out.append((None if none else user, call, granted))
        if self._evict:
            self._stop()
        self._hold(held)
        yield pd.DataFrame(out, columns=["key", "call", "granted"]).astype({"key": "Int64"})


def admissions(stream: DataFrame, interval: int, burst: int, late: str | None = None) -> DataFrame:
    """Calls (key, call, now) with whether they are granted.

    With `late`, `now` counts microseconds since 1970, calls that are later than that
    after the latest one, or not after 1970, are dropped, and idle keys keep no state. Without it, every
    key's state stays.
    """
    _states(stream.sparkSession)
    timed = stream.withColumn("_at", F.timestamp_micros("now")).withWatermark("_at", late) if late else stream
    made = Gcra(interval, burst, late is not None)
    return _keyed(timed, "key").transformWithStateInPandas(made, "key long, call long, granted boolean", "Append", "EventTime" if late else "None")


def _keyed(df: DataFrame, key: str):
    """Groups of keys, whole numbers that may be null; pandas would make numbers beside a null another kind, and so other keys of the state, and has no names with a leading underscore here."""
    dealt = F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")
    return df.withColumn("_group", dealt).withColumn("null_key", F.col(key).isNull()).withColumn(key, F.coalesce(F.col(key), F.lit(0).cast("long"))).groupBy("_group")


def _states(spark: SparkSession) -> None:
    """State of processors, with timers or without, is kept by RocksDB: the default store refuses it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Timers(Keys):
    """A key's pending timer as its state, which fires as the watermark passes."""

    values = "due long"

    def ends(self, due: int) -> int:
        return due

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, fired = self._held(), []
        for timer, none, tick, action, delay in _in_order(rows, ["tick", "seq"], ["timer", "null_key", "tick", "action", "delay"]):
            if none:
                continue
            due = held.pop((timer, none), (None,))[0]
            if due is not None and due <= tick:  # it fired before this command
                fired.append((timer, due))
                due = None
            if action == "schedule" or (action == "reschedule" and due is not None):
                due = tick + max(delay, 1)
            if due is not None and action != "cancel":
                held[timer, none] = (due,)
        self._stop()
        self._hold(held)
        yield pd.DataFrame(fired, columns=["timer", "fire_tick"])

    def ended(self, gone: dict[tuple, tuple]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(timer, due) for (timer, _), (due,) in gone.items()], columns=["timer", "fire_tick"])


def timers(commands: DataFrame, late_ticks: int = 0) -> DataFrame:
    """(timer, fire_tick) of commands (timer long, seq, action, tick, delay), ticks from 1 on: what `calendar.fires` gives, in any split into batches whose ticks are at most `late_ticks` behind. (O141, O217)

    A timer is drained as the watermark reaches it; a row of no timer (null) with a later tick moves that on.
    """
    _states(commands.sparkSession)
    timed = commands.withColumn("_at", F.timestamp_millis("tick")).withWatermark("_at", f"{late_ticks} milliseconds")
    return _keyed(timed, "timer").transformWithStateInPandas(Timers(), "timer long, fire_tick long", "Append", "EventTime")


class Windows(Keys):
    """A key's current window and its calls so far; a timer at the window's end drops both."""

    values = "start long, calls long"

    def __init__(self, seconds: int, limit: int) -> None:
        self._seconds, self._limit = seconds, limit

    def ends(self, start: int, calls: int) -> int:
        return (start + self._seconds) * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._held(), []
        for user, none, call, second in _in_order(rows, ["second", "call"], ["key", "null_key", "call", "second"]):
            start, calls = held.get((user, none), (None, 0))
            of = second - second % self._seconds
            if start is not None and of < start:
                continue  # its window is over
            calls = calls + 1 if of == start else 1
            held[user, none] = (of, calls)
            out.append((call, calls <= self._limit))
        self._stop()
        self._hold(held)
        yield pd.DataFrame(out, columns=["call", "granted"])


def window_limits(calls: DataFrame, seconds: int, limit: int, late: str = "0 seconds") -> DataFrame:
    """(call, granted) of calls (key long, call long, second long): `limits.fixed_window` on a stream. A call of a window that is over gets no answer; a window's state lives until the watermark reaches its end. (O133, O216)"""
    _states(calls.sparkSession)
    timed = calls.withColumn("_at", F.timestamp_seconds("second")).withWatermark("_at", late)
    return _keyed(timed, "key").transformWithStateInPandas(Windows(seconds, limit), "call long, granted boolean", "Append", "EventTime")
