"""Streams over the test tables, run to the end of what is there: joins, timers, windows with state, admissions and fan-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagoon.plans.record_queries import _GCRA
from lagoon.sources.scratch import scratch
from lagoon.sources.tables import table
from lagoon.streaming import streams


def _stream(s, d, name):
    return s.readStream.schema(table(s, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _join(s, d):
    """Orders with the lines that were shipped within 30 days, and those without any as soon as that is certain."""
    o = _stream(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ordered"))
    i = _stream(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("shipped"))
    joined = streams.interval_join(o, i.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "ordered", "shipped", "30 days", "1 day", "left_outer")
    days = lambda c: F.date_diff(F.to_date(c), F.lit("1970-01-01").cast("date")).alias(c)
    return streams.settle(joined, scratch(s, "joined"))[0].select("o_orderkey", "l_linenumber", days("ordered"), days("shipped"))


def commands(orders):
    """Orders as commands on a timer of their customer, ticks in days."""
    n = F.col("o_orderkey")
    action = F.when(n % 5 == 0, "cancel").when(n % 5 == 1, "reschedule").otherwise("schedule")
    tick = F.date_diff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long")
    return orders.select(F.col("o_custkey").alias("timer"), n.alias("seq"), action.alias("action"), tick.alias("tick"), (n % 90).alias("delay"))


def _timers(s, d):
    """The stream ends with a tick behind every delay, which drains all timers."""
    last, path = commands(table(s, d, "orders")), scratch(s, "tick")
    last.agg(F.lit(None).cast("long").alias("timer"), F.lit(0).cast("long").alias("seq"), F.lit("tick").alias("action"), (F.max("tick") + 100).alias("tick"), F.lit(0).cast("long").alias("delay")).write.parquet(path)
    ticks = s.readStream.schema(last.schema).parquet(path)
    fired = streams.timers(commands(_stream(s, d, "orders")).unionByName(ticks))
    return streams.settle(fired, scratch(s, "fired"))[0]


def _window_limit(s, d):
    calls = _stream(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("call"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    return streams.settle(streams.window_limits(calls, 86400, 3), scratch(s, "granted"))[0]


def _admissions(s, d):
    calls = _stream(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("call"), F.unix_micros(F.col("ts").cast("timestamp")).alias("now"))
    return streams.settle(streams.admissions(calls, 3_600_000_000, 3, "1 day"), scratch(s, "admitted"))[0]


def _fan_out(s, d):
    """Every batch goes to two sinks, one of which only takes errors."""
    path = scratch(s, "sinks")

    def sink(name):
        return lambda batch, number: batch.select("event_id", F.lit(name).alias("sink")).write.mode("overwrite").parquet(f"{path}/{name}-{number}")

    streams.fan_out(_stream(s, d, "events"), [sink("all"), sink("errors")], [None, F.col("event_type") == "error"]).awaitTermination()
    return s.read.schema("event_id long, sink string").parquet(f"{path}/*")


QUERIES = {
    "stream_join": _join,
    "stream_timers": _timers,
    "stream_window_limit": _window_limit,
    "stream_admissions": _admissions,
    "stream_fan_out": _fan_out,
}

#: The watermark ends a day behind the lesser of both sides' last times; an order that has no line by then comes out once it is 30 days behind that.
_JOIN = """WITH m AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 1 DAY AS mark),
i AS (SELECT o_orderkey, l_linenumber, o_orderdate, l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY),
r AS (
  SELECT * FROM i
  UNION ALL
  SELECT o_orderkey, NULL, o_orderdate, NULL FROM orders, m WHERE o_orderkey NOT IN (SELECT o_orderkey FROM i) AND o_orderdate + INTERVAL 30 DAY < mark)
SELECT o_orderkey, l_linenumber, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS ordered, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INT) AS shipped FROM r"""
#: Command by command of a timer: what is pending behind each, and whether the one before it fired first.
_TIMERS = """WITH RECURSIVE c AS (
  SELECT o_custkey AS timer, o_orderkey % 5 AS a, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS t, greatest(o_orderkey % 90, 1) AS delay,
    row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS n FROM orders),
s AS (
  SELECT timer, n, CASE WHEN a > 1 THEN t + delay END AS due, CAST(NULL AS BIGINT) AS fired FROM c WHERE n = 1
  UNION ALL
  SELECT c.timer, c.n, CASE WHEN a > 1 OR (a = 1 AND s.due > t) THEN t + delay END, CASE WHEN s.due <= t THEN s.due END
  FROM s JOIN c ON c.timer = s.timer AND c.n = s.n + 1)
SELECT timer, fired AS fire_tick FROM s WHERE fired IS NOT NULL
UNION ALL
SELECT timer, arg_max(struct_pack(due := due), n).due FROM s GROUP BY timer HAVING arg_max(struct_pack(due := due), n).due IS NOT NULL"""

SQL = {
    "stream_join": _JOIN,
    "stream_timers": _TIMERS,
    "stream_window_limit": "SELECT event_id AS call, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts)) AS BIGINT) // 86400 ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) <= 3 AS granted FROM events",
    "stream_admissions": f"SELECT user_id AS key, event_id AS call, granted FROM ({_GCRA})",
    "stream_fan_out": "SELECT event_id, 'all' AS sink FROM events UNION ALL SELECT event_id, 'errors' FROM events WHERE event_type = 'error'",
}
