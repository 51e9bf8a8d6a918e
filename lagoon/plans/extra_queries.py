"""Segments, logs, refresh rules, conformance and streaming projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagoon.functions import numeric as nx
from lagoon.operators import eventlog, lookup, metrics, ranks, sketches
from lagoon.plans.value_queries import _md5
from lagoon.sources import runs, segments
from lagoon.sources.scratch import scratch
from lagoon.sources.tables import samples, table
from lagoon.streaming import streams


def _framed(s, d, check):
    """Event ids written as segment files with checksums, and read back."""
    path = scratch(s, "segments")
    segments.write(table(s, d, "events").select("event_id", F.col("event_id").cast("string").alias("p")), "p", ["event_id"], path, check)
    return segments.read(s, path, check)


def _segment_scan(s, d):
    return _framed(s, d, "crc32").select(F.col("payload").cast("string").cast("long").alias("event_id"), "error")


def _segment_seek(s, d):
    """A log for every 16th of the users: frames from the 100th block on that end within the first three quarters of their log's bytes."""
    path = scratch(s, "logs")
    e = table(s, d, "events").select((F.col("user_id") % 16).alias("log"), "event_id", F.col("event_id").cast("string").alias("p"))
    segments.write(e, "p", ["event_id"], path, "xxh3", file_bytes=1 << 50, segment="log")
    frames = segments.read(s, path, "xxh3")
    marks = frames.groupBy("segment").agg(F.floor(F.max("end") * 3 / 4).alias("committed"))
    kept = segments.committed(segments.seek(frames, 100), marks)
    return kept.select("segment", "block", "end", F.col("payload").cast("string").cast("long").alias("event_id"))


def _wal(s, d):
    frames = table(s, d, "orders").select((F.col("o_orderkey") % 4).alias("log"), F.col("o_orderkey").alias("offset"), (F.col("o_orderkey") % 1501 != 1500).alias("intact"))
    return runs.replay(frames, "log", "offset", F.col("intact")).groupBy("log").agg(F.count("*").alias("n"), F.max("offset").alias("last"))


def _partitioned_bloom(s, d):
    """Customers of even number in the filter, all of them asked for."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    made = sketches.partitioned_bloom(c.where("k % 2 = 0"), "k", 1 << 10, 3, "md5")
    return sketches.partitioned_contains(made, c, "k", 1 << 10, 3, "md5")


def _catch_up(s, d):
    stream = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return streams.catch_up(stream, ["event_type"], [F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total")], scratch(s, "catch_up"))


def _stream_windows(s, d):
    stream = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    day = F.window(F.col("ts").cast("timestamp"), "1 day")["start"].cast("date").alias("day")
    return streams.catch_up(stream.withColumn("day", day), ["day", "event_type"], [F.count("*").alias("n")], scratch(s, "windows"))


def _probe_views(s, d):
    """Users of even number answer to liveness probes too."""
    kinds = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("live"), F.lit("ready"))).otherwise(F.array(F.lit("ready")))
    status = F.when(F.col("event_type") == "error", "DEGRADED").otherwise("UP").alias("status")
    return eventlog.worst(eventlog.views(table(s, d, "events").select("user_id", status), kinds), ["kind"], "status")


QUERIES = {
    "segment_scan": _segment_scan,
    "wal_replay": _wal,
    "partitioned_bloom": _partitioned_bloom,
    "bulk_build_check": lambda s, d: lookup.build_report(table(s, d, "lineitem"), "l_orderkey"),
    "fx_parts": lambda s, d: table(s, d, "customer").select("c_custkey", (F.round(F.col("c_acctbal") * 100).cast("long") * -10_000_000).alias("raw")).select("c_custkey", *(p.alias(k) for p, k in zip(nx.parts("raw"), ("whole", "part", "sign"), strict=True))),
    "refresh_due": lambda s, d: metrics.due(table(s, d, "events").groupBy("user_id").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("at")), F.lit(1706659200), "at", F.lit(7200)).select("user_id"),
    "probe_views": _probe_views,
    "conformance_gate": lambda s, d: ranks.picks(samples(s, d), ["g"], "x", {"p99": 0.99}).select("g", "p99", (F.col("p99") < 20_000).alias("passes")),
    "hll_builtin": lambda s, d: table(s, d, "lineitem").agg(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 14)).alias("e"), F.countDistinct("l_partkey").alias("n")).select((F.abs(F.col("e") - F.col("n")) <= 0.05 * F.col("n")).alias("ok")),
    "hll_intersection": lambda s, d: table(s, d, "lineitem").agg(F.hll_sketch_agg(F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")), 14).alias("a"), F.hll_sketch_agg(F.when(F.col("l_partkey") % 3 != 1, F.col("l_partkey")), 14).alias("b"), F.countDistinct(F.when(F.col("l_partkey") % 3 == 2, F.col("l_partkey"))).alias("n")).select(sketches.hll_intersection(F.hll_sketch_estimate("a").cast("double"), F.hll_sketch_estimate("b").cast("double"), F.hll_sketch_estimate(F.hll_union("a", "b")).cast("double")).alias("e"), "n").select((F.abs(F.col("e") - F.col("n")) <= 0.15 * F.col("n")).alias("ok")),
    "segment_seek": _segment_seek,
    "stream_catch_up": _catch_up,
    "stream_windows": _stream_windows,
}

_PARTITIONED = f"""WITH p AS (SELECT c_custkey AS k, i, {_md5("(100 + i)", "c_custkey")} % 1024 AS bit FROM customer, range(3) t(i)),
f AS (SELECT DISTINCT i, bit FROM p WHERE k % 2 = 0)
SELECT p.k, count(f.bit) = 3 AS maybe FROM p LEFT JOIN f ON f.i = p.i AND f.bit = p.bit GROUP BY p.k"""
#: A frame has 4 bytes for its length and 8 for its checksum.
_SEEK = """WITH e AS (
  SELECT CAST(user_id % 16 AS VARCHAR) AS segment, event_id, row_number() OVER w - 1 AS block, CAST(sum(12 + length(CAST(event_id AS VARCHAR))) OVER w AS BIGINT) AS "end"
  FROM events WINDOW w AS (PARTITION BY user_id % 16 ORDER BY event_id))
SELECT segment, block, "end", event_id FROM (SELECT *, max("end") OVER (PARTITION BY segment) * 3 // 4 AS mark FROM e) WHERE block >= 100 AND "end" <= mark"""
SQL = {
    "segment_scan": "SELECT event_id, CAST(NULL AS VARCHAR) AS error FROM events",
    "wal_replay": (
        "WITH b AS (SELECT o_orderkey % 4 AS log, min(o_orderkey) FILTER (WHERE o_orderkey % 1501 = 1500) AS bad FROM orders GROUP BY 1) SELECT log, count(*) "
        "AS n, max(o_orderkey) AS last FROM orders JOIN b ON log = o_orderkey % 4 WHERE bad IS NULL OR o_orderkey < bad GROUP BY log"
    ),
    "segment_seek": _SEEK,
    "partitioned_bloom": _PARTITIONED,
    "bulk_build_check": "SELECT count(*) AS keys, count(*) FILTER (WHERE n > 1) AS repeated FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)",
    "fx_parts": (
        "WITH a AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) * -10000000 AS raw FROM customer) SELECT c_custkey, abs(raw) // 1000000000 AS "
        "whole, abs(raw) % 1000000000 AS part, CAST(sign(raw) AS INT) AS sign FROM a"
    ),
    "refresh_due": "SELECT user_id FROM events GROUP BY user_id HAVING 1706659200 - max(CAST(floor(epoch(ts)) AS BIGINT)) >= 7200",
    "probe_views": (
        "WITH k AS (SELECT 'ready' AS kind, event_type FROM events UNION ALL SELECT 'live', event_type FROM events WHERE user_id % 2 = 0) SELECT kind, CASE "
        "WHEN bool_or(event_type = 'error') THEN 'DEGRADED' ELSE 'UP' END AS status FROM k GROUP BY kind"
    ),
    "conformance_gate": (
        "WITH s AS (SELECT event_type AS g, CAST(round(value * 100) AS BIGINT) AS x FROM events), r AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER "
        "BY x) AS rk, count(*) OVER (PARTITION BY g) AS n FROM s), p AS (SELECT g, max(x) FILTER (WHERE rk = least(n, CAST(floor(0.99::DOUBLE * n) AS BIGINT) "
        "+ 1)) AS p99 FROM r GROUP BY g) SELECT g, p99, p99 < 20000 AS passes FROM p"
    ),
    "hll_builtin": "SELECT true AS ok",
    "hll_intersection": "SELECT true AS ok",
    "stream_catch_up": "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1",
    "stream_windows": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
