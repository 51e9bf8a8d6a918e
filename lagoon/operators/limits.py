"""Rate-limit admission. Where a refusal leaves the state as it is, admission is an ordered fold over a key's calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.operators.ranks import in_order


def fixed_window(df: DataFrame, key: str, ts: str, tie: str, seconds: int, limit: int) -> DataFrame:
    """Refused calls count too, so a call is granted by its number in the window. (O133, O216)"""
    start = F.unix_timestamp(ts) - F.unix_timestamp(ts) % seconds
    rows = df.withColumn("window_start", start)
    number = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, tie))
    return rows.withColumn("granted", number <= limit)


def window_totals(df: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Granted and refused calls of each window without ordering them. (O121)"""
    start = F.unix_timestamp(ts) - F.unix_timestamp(ts) % seconds
    n = df.groupBy(key, start.alias("window_start")).agg(F.count("*").alias("calls"))
    return n.select(key, "window_start", F.least("calls", F.lit(limit)).cast("long").alias("allowed"), F.greatest(F.col("calls") - limit, F.lit(0)).cast("long").alias("denied"))


Step = Callable[[dict, int, int], tuple[bool, int | None]]


def _fold(df: DataFrame, keys: list[str], now: str, tie: str, cost: str | None, step: Step, start: Callable[[], dict]) -> DataFrame:
    """Calls sorted by key and time go by in batches; only the state of the key at hand is held."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, start()
        for b in batches:
            times = b.column(now).to_pylist()
            costs = b.column(cost).to_pylist() if cost else [1] * len(times)
            done = []
            for key, t, n in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), times, costs, strict=True):
                if key != of:
                    of, state = key, start()
                done.append(step(state, int(t), int(n)))
            granted, retry = pa.array([g for g, _ in done], pa.bool_()), pa.array([r for _, r in done], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, granted, retry], names=[*b.schema.names, "granted", "retry_at"])

    return in_order(df, keys, [now, tie]).mapInArrow(run, f"{fields}, granted boolean, retry_at long")


def gcra_step(interval: int, burst: int) -> Step:
    """Calls arrive on a virtual schedule of one each interval; a call may be ahead of it by burst intervals. A free call is granted, one that costs more than the burst never can be. (O134)"""

    def step(state: dict, now: int, n: int) -> tuple[bool, int | None]:
        if n == 0:
            return True, None
        if n > burst:
            return False, None
        after = max(state["due"], now) + n * interval
        earliest = after - burst * interval
        if now < earliest:
            return False, earliest
        state["due"] = after
        return True, None

    return step


def gcra(df: DataFrame, keys: list[str], now: str, tie: str, interval: int, burst: int, cost: str | None = None) -> DataFrame:
    """Calls with `granted` and, for those refused that can be repeated, `retry_at`. (O134-O136)"""
    return _fold(df, keys, now, tie, cost, gcra_step(interval, burst), lambda: {"due": 0})


def bucket_step(capacity: int, per_second: int) -> Step:
    """A bucket that starts full, in billionths of a token. (O137)"""
    whole = 1_000_000_000

    def step(state: dict, now: int, n: int) -> tuple[bool, int | None]:
        if state["at"] is not None:
            state["tokens"] = min(capacity * whole, state["tokens"] + max(0, now - state["at"]) * per_second)
        state["at"] = now if state["at"] is None else max(state["at"], now)
        if state["tokens"] >= n * whole:
            state["tokens"] -= n * whole
            return True, None
        return False, None

    return step


def token_bucket(df: DataFrame, keys: list[str], now: str, tie: str, capacity: int, per_second: int, cost: str | None = None) -> DataFrame:
    return _fold(df, keys, now, tie, cost, bucket_step(capacity, per_second), lambda: {"tokens": capacity * 1_000_000_000, "at": None})


def hierarchical(df: DataFrame, parent: str, child: str, now: str, tie: str, parent_bucket: tuple[int, int], child_bucket: tuple[int, int]) -> DataFrame:
    """A call is granted if both its child's and its parent's bucket (capacity, per second) grant it; neither is charged otherwise. (O049, O203)"""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    whole = 1_000_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, top, children = object(), [], {}  # buckets of one parent at a time
        for b in batches:
            granted = []
            for p, t, c in zip(*(b.column(n).to_pylist() for n in (parent, now, child)), strict=True):
                if p != of and (p == p or of == of):
                    of, top, children = p, [parent_bucket[0] * whole, None], {}
                own = children.setdefault(c, [child_bucket[0] * whole, None])
                for state, (capacity, rate) in ((top, parent_bucket), (own, child_bucket)):
                    if state[1] is not None:
                        state[0] = min(capacity * whole, state[0] + max(0, int(t) - state[1]) * rate)
                    state[1] = int(t)
                ok = top[0] >= whole and own[0] >= whole
                if ok:
                    top[0] -= whole
                    own[0] -= whole
                granted.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(granted, pa.bool_())], names=[*b.schema.names, "granted"])

    return in_order(df, [parent], [now, tie]).mapInArrow(run, f"{fields}, granted boolean")


def bounded_queue(df: DataFrame, keys: list[str], order: str, capacity: Column | int, policy: str) -> DataFrame:
    """Which of a burst's events a stalled consumer gets: the first one is in its hands; of the rest a queue of some capacity keeps the first (drop_newest) or the last (drop_oldest). (O210)"""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(*keys)) - 1
    room = capacity if isinstance(capacity, Column) else F.lit(capacity)
    kept = at <= room if policy == "drop_newest" else (at == 0) | (at > n - room) if policy == "drop_oldest" else F.lit(True)
    return df.withColumn("delivered", kept)
