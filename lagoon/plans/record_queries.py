"""Keyed records, ordered lookups, event logs, health, limits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagoon.operators import eventlog, limits, lookup, metrics, versions
from lagoon.sources.tables import SAMPLES_SQL, samples, table

LOW, HIGH = 200, 900


def _records(s, d):
    """Orders as records of their customer."""
    o = table(s, d, "orders")
    return o.select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 4).cast("int").alias("source"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        (F.col("o_orderkey") % 3).cast("int").alias("level"), (F.col("o_orderkey") % 12).alias("run"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"), (F.col("o_orderstatus") == "F").alias("gone"),
    )


_R = "r AS (SELECT o_custkey AS k, o_orderkey AS seq, CAST(o_orderkey % 4 AS INT) AS source, CAST(left(o_orderpriority, 1) AS INT) AS priority, CAST(o_orderkey % 3 AS INT) AS level, o_orderkey % 12 AS run, CAST(round(o_totalprice * 100) AS BIGINT) AS v, o_orderstatus = 'F' AS gone FROM orders)"
_NEW = f"WITH {_R}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS i FROM r)"


def _prices(s, d):
    return table(s, d, "part").select(F.round(F.col("p_retailprice") * 100).cast("long").alias("x"), F.col("p_partkey").alias("id"))


def _balances(s, d):
    return table(s, d, "customer").select(F.round(F.col("c_acctbal") * 100).cast("long").alias("x"))


_PX = "p AS (SELECT CAST(round(p_retailprice * 100) AS BIGINT) AS x, p_partkey AS id FROM part), b AS (SELECT DISTINCT CAST(round(c_acctbal * 100) AS BIGINT) AS x FROM customer)"


def _nearest(mode):
    return lambda s, d: lookup.nearest(_prices(s, d), _balances(s, d), "x", mode)


def _nearest_sql(op, agg):
    return f"WITH {_PX} SELECT x, id, (SELECT {agg}(b.x) FROM b WHERE b.x {op} p.x) AS found FROM p"


def _status():
    return F.when(F.col("event_type") == "error", "DOWN").when(F.col("event_type") == "signup", "UNKNOWN").when(F.col("event_type") == "purchase", "WARN").otherwise("UP")


_ST = "CASE event_type WHEN 'error' THEN 'DOWN' WHEN 'signup' THEN 'UNKNOWN' WHEN 'purchase' THEN 'WARN' ELSE 'UP' END"
_E = f"e AS (SELECT event_id, user_id, ts, event_type, user_id % 3 = 0 AS critical, {_ST} AS status FROM events)"
_RANK = "CASE {} WHEN 'UP' THEN 0 WHEN 'UNKNOWN' THEN 1 WHEN 'WARN' THEN 2 WHEN 'DEGRADED' THEN 3 ELSE 4 END"
_NAME = "CASE {} WHEN 0 THEN 'UP' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'WARN' WHEN 3 THEN 'DEGRADED' ELSE 'DOWN' END"


def _statuses(s, d):
    return table(s, d, "events").select("event_id", "user_id", "ts", "event_type", (F.col("user_id") % 3 == 0).alias("critical"), _status().alias("status"))


def _log(s, d):
    return eventlog.append_offsets(table(s, d, "events").select("event_id", "ts", "event_type", "user_id"), "ts", "event_id")


_LOG = "l AS (SELECT event_id, ts, event_type, user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS \"offset\" FROM events)"
BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def _values(s, d):
    return table(s, d, "events").select("event_type", "event_id", "value")


def _steps(s, d):
    """Orders of a customer as the steps of a saga."""
    o = table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("saga"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("s"), F.col("o_orderkey")).alias("step"), (~((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0))).alias("forward_ok"), (F.col("o_orderkey") % 5 != 0).alias("compensate_ok"))


def _csv(c):
    return F.concat_ws(",", c).alias(c)


def _sagas(s, d):
    return eventlog.saga_reports(_steps(s, d), "saga", "pos", "step", "forward_ok", "compensate_ok").select("saga", "outcome", "failed_step", _csv("forward_ran"), _csv("compensated"), _csv("failures"))


def _gcra_calls(s, d):
    return table(s, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("now"))


QUERIES = {
    "dedup_latest": lambda s, d: versions.by_source(_records(s, d).select("k", "source", "seq", "v"), ["k"], "source", "seq"),
    "priority_latest": lambda s, d: versions.by_priority(_records(s, d).select("k", "priority", "source", "seq", "v"), ["k"], "priority", "source", "seq"),
    "tombstone_latest": lambda s, d: versions.live(_records(s, d).select("k", "seq", "v", "gone"), ["k"], "seq", "gone"),
    "latest_value": lambda s, d: versions.latest(_records(s, d).select("k", "seq", "v", "gone"), ["k"], "seq"),
    "lsm_range": lambda s, d: versions.read_range(_records(s, d).select("k", "seq", "v", "gone"), "k", "seq", "gone", LOW, HIGH),
    "lsm_compact": lambda s, d: versions.live(_records(s, d).select("k", "seq", "v", "gone"), ["k"], "seq", "gone").select("k", "v"),
    "tiered_merge": lambda s, d: versions.merge_level(_records(s, d).select("k", "seq", "v", "gone", "level", "run"), ["k"], "level", "seq", 3),
    "level_overlap": lambda s, d: versions.overlaps(versions.manifest(_records(s, d), "level", "run", "k"), "level", "run"),
    "level_budgets": lambda s, d: versions.manifest(_records(s, d), "level", "run", "k").groupBy("level").agg(F.sum("n").alias("n")).withColumn("budget", versions.level_budget(1000, 10, F.col("level"))),
    "snapshot_read": lambda s, d: versions.as_of(_records(s, d).select("k", "seq", "v", "gone"), ["k"], "seq", "gone", 5000),
    "difference": lambda s, d: versions.without(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]),
    "floor_lookup": _nearest("floor"),
    "ceiling_lookup": _nearest("ceiling"),
    "pred_lookup": _nearest("predecessor"),
    "succ_lookup": _nearest("successor"),
    "point_lookup": lambda s, d: lookup.lookup(table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), s.range(0, 4000, 250).select(F.col("id").alias("k")), ["k"]),
    "semi_anti": lambda s, d: table(s, d, "customer").select("c_custkey", F.lit("has").alias("side")).join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").unionByName(table(s, d, "customer").select("c_custkey", F.lit("none").alias("side")).join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")),
    "range_incl_excl": lambda s, d: lookup.between(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 100, 2000, low_open=True),
    "byte_range": lambda s, d: lookup.between(table(s, d, "part").select("p_partkey", "p_name"), "p_name", "blue", "red", high_open=True),
    "kway_merge": lambda s, d: lookup.merge_sorted(*(table(s, d, "orders").where(F.col("o_orderkey") % 3 == i).select("o_orderkey", F.lit(i).alias("source")) for i in range(3)), by=["o_orderkey"]),
    "reverse_merge": lambda s, d: lookup.merge_sorted(table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "part").select(F.col("p_partkey").alias("k")), by=["k"], descending=True),
    "first_last": lambda s, d: lookup.ends(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"),
    "topk_counts": lambda s, d: lookup.top_counts(table(s, d, "lineitem"), "l_partkey", 20),
    "split_pivot": lambda s, d: (lambda a, b: a.withColumn("side", F.lit("low")).unionByName(b.withColumn("side", F.lit("high"))))(*lookup.split_at(table(s, d, "part").select("p_partkey"), "p_partkey", 700)),
    "prefix_fanout": lambda s, d: lookup.prefix_fanout(table(s, d, "part").select("p_name"), "p_name", 1),
    "event_offsets": _log,
    "read_from": lambda s, d: eventlog.read_from(_log(s, d), 9000),
    "by_topic": lambda s, d: eventlog.by_topic(_log(s, d), "event_type", "error"),
    "replay_fold": lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total")),
    "event_json": lambda s, d: table(s, d, "events").select("event_id", eventlog.event_json(F.col("event_type"), F.lit("INFO"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(None).cast("string"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))).alias("json")),
    "status_worst": lambda s, d: eventlog.worst(_statuses(s, d), ["user_id"], "status"),
    "status_views": lambda s, d: eventlog.health_view(_statuses(s, d), ["event_type"], "status", "critical").withColumnRenamed("event_type", "view").unionByName(eventlog.health_view(_statuses(s, d).withColumn("view", F.lit("all")), ["view"], "status", "critical")).withColumn("code", eventlog.http_code(F.col("status"))),
    "status_transitions": lambda s, d: eventlog.transitions(_statuses(s, d), "user_id", "ts", "status", "event_id").select("user_id", "event_id", "before", "status"),
    "transition_counter": lambda s, d: eventlog.transition_counts(eventlog.transitions(_statuses(s, d), "user_id", "ts", "status", "event_id"), "user_id", "status"),
    "staleness": lambda s, d: _statuses(s, d).groupBy("user_id").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("refreshed")).select("user_id", eventlog.stale(F.lit(1706659200), F.col("refreshed"), F.lit(3600), 3.0).alias("stale")),
    "saga_outcome": _sagas,
    "saga_json": lambda s, d: eventlog.saga_json(eventlog.saga_reports(_steps(s, d), "saga", "pos", "step", "forward_ok", "compensate_ok"), "saga"),
    "fixed_window_limit": lambda s, d: limits.fixed_window(table(s, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 86400, 3).select("event_id", "granted"),
    "window_limit_totals": lambda s, d: limits.window_totals(table(s, d, "events"), "user_id", "ts", 86400, 3),
    "gcra": lambda s, d: limits.gcra(_gcra_calls(s, d), ["user_id"], "now", "event_id", 3_600_000_000, 3),
    "token_bucket": lambda s, d: limits.token_bucket(table(s, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("now")), ["user_id"], "now", "event_id", 2, 1),
    "hier_bucket": lambda s, d: limits.hierarchical(table(s, d, "events").select("event_id", "event_type", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("now")), "event_type", "user_id", "now", "event_id", (50, 1), (2, 1)),
    "bounded_queue": lambda s, d: limits.bounded_queue(table(s, d, "events").select("event_id", "user_id"), ["user_id"], "event_id", 2, "drop_oldest"),
    "otel_buckets": lambda s, d: metrics.bounded_histogram(_values(s, d), ["event_type"], "value", BOUNDS).withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le"))),
    "hist_quantile": lambda s, d: metrics.histogram_quantile(metrics.bounded_histogram(_values(s, d), ["event_type"], "value", BOUNDS), ["event_type"], 0.9),
    "exemplars_topk": lambda s, d: metrics.exemplars(_values(s, d), ["event_type"], "value", "event_id", 5),
    "slow_topk": lambda s, d: metrics.slowest(samples(s, d).withColumn("day", F.to_date("ts")), ["g", "day"], "x", 20),
    "divergence": lambda s, d: metrics.divergence(table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n")), table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")), ["k"], "n"),
    "prom_lines": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select(metrics.exposition(F.lit("app.events-total"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("site"), F.lit('a"b')), F.col("n")).alias("line")),
    "summary_rows": lambda s, d: metrics.summary_rows(samples(s, d).groupBy("g").agg(F.min("x").alias("low"), F.max("x").alias("high")), "g", ["low", "high"]),
    "timer_spans": lambda s, d: metrics.spans(table(s, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("mark")), "user_id", "mark", "event_id").select("event_id", "start", "end"),
}
_CALLS = "c AS (SELECT user_id, event_id, {0} AS now, row_number() OVER (PARTITION BY user_id ORDER BY {0}, event_id) AS n FROM events)"
#: Call by call, on a virtual schedule of one an hour with a burst of 3.
_GCRA = f"""WITH RECURSIVE {_CALLS.format('CAST(epoch_us(ts) AS BIGINT)')},
s AS (
  SELECT user_id, event_id, now, n, now + 3600000000 AS due, true AS granted, CAST(NULL AS BIGINT) AS retry_at FROM c WHERE n = 1
  UNION ALL
  SELECT c.user_id, c.event_id, c.now, c.n,
    CASE WHEN c.now >= greatest(s.due, c.now) - 2 * 3600000000 THEN greatest(s.due, c.now) + 3600000000 ELSE s.due END,
    c.now >= greatest(s.due, c.now) - 2 * 3600000000,
    CASE WHEN c.now < greatest(s.due, c.now) - 2 * 3600000000 THEN greatest(s.due, c.now) - 2 * 3600000000 END
  FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1)
SELECT user_id, event_id, now, granted, retry_at FROM s"""
#: Call by call, from a bucket of 2 tokens that gets one a second; tokens in billionths.
_BUCKET = f"""WITH RECURSIVE {_CALLS.format('CAST(epoch_us(ts) AS BIGINT) * 1000')},
s AS (
  SELECT user_id, event_id, now, n, CAST(1000000000 AS BIGINT) AS tokens, true AS granted FROM c WHERE n = 1
  UNION ALL
  SELECT c.user_id, c.event_id, c.now, c.n,
    least(2000000000, s.tokens + c.now - s.now) - CASE WHEN least(2000000000, s.tokens + c.now - s.now) >= 1000000000 THEN 1000000000 ELSE 0 END,
    least(2000000000, s.tokens + c.now - s.now) >= 1000000000
  FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1)
SELECT user_id, event_id, now, granted, CAST(NULL AS BIGINT) AS retry_at FROM s"""

#: Call by call of an event type: its bucket of 50 tokens, and a list with the bucket of 2 of each user, both getting one a second; tokens in billionths.
_HIER = """WITH RECURSIVE c AS (
  SELECT event_id, event_type, user_id, CAST(epoch_us(ts) AS BIGINT) * 1000 AS now,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS i
  FROM events),
s AS (
  SELECT event_type, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS BIGINT) AS now,
    50000000000 AS top, CAST(NULL AS BIGINT) AS top_at, list_transform(range(max(i)), lambda x: 2000000000) AS own, list_transform(range(max(i)), lambda x: CAST(NULL AS BIGINT)) AS own_at, false AS granted
  FROM c GROUP BY event_type
  UNION ALL
  SELECT event_type, n, event_id, user_id, now, t - paid, now, own[:i - 1] || [o - paid] || own[i + 1:], own_at[:i - 1] || [now] || own_at[i + 1:], paid > 0
  FROM (
    SELECT *, CASE WHEN t >= 1000000000 AND o >= 1000000000 THEN 1000000000 ELSE 0 END AS paid
    FROM (
      SELECT c.*, s.own, s.own_at, least(50000000000, s.top + coalesce(c.now - s.top_at, 0)) AS t, least(2000000000, s.own[c.i] + coalesce(c.now - s.own_at[c.i], 0)) AS o
      FROM s JOIN c ON c.event_type = s.event_type AND c.n = s.n + 1)))
SELECT event_id, event_type, user_id, now, granted FROM s WHERE n > 0"""

_SAGA = """WITH t AS (SELECT o_custkey AS saga, o_orderkey AS pos, 's' || o_orderkey AS step, NOT (o_orderstatus = 'F' AND o_orderkey % 7 = 0) AS fw, o_orderkey % 5 <> 0 AS cm FROM orders),
f AS (SELECT saga, min(pos) FILTER (WHERE NOT fw) AS cut FROM t GROUP BY saga),
j AS (SELECT t.saga, max(step) FILTER (WHERE pos = cut) AS failed_step,
  coalesce(string_agg(step, ',' ORDER BY pos) FILTER (WHERE cut IS NULL OR pos < cut), '') AS forward_ran,
  coalesce(string_agg(step, ',' ORDER BY pos DESC) FILTER (WHERE pos < cut AND cm), '') AS compensated,
  coalesce(string_agg(step, ',' ORDER BY pos DESC) FILTER (WHERE pos < cut AND NOT cm), '') AS failures
  FROM t JOIN f ON t.saga = f.saga GROUP BY t.saga)
SELECT saga, CASE WHEN failed_step IS NULL THEN 'COMMITTED' WHEN failures <> '' THEN 'COMPENSATION_FAILED' ELSE 'COMPENSATED' END AS outcome, failed_step, forward_ran, compensated, failures FROM j"""
_LIST = "'[' || list_aggregate(list_transform(string_split({0}, ','), lambda x: '\"' || x || '\"'), 'string_agg', ',') || ']'"
_H = "h AS (SELECT event_type, b.le, count(*) FILTER (WHERE value <= b.le) AS n FROM events, (SELECT unnest([" + ", ".join(map(str, BOUNDS)) + ", 'Infinity'::DOUBLE]) AS le) b GROUP BY ALL)"

SQL = {
    "gcra": _GCRA,
    "token_bucket": _BUCKET,
    "hier_bucket": _HIER,
    "dedup_latest": f"WITH {_R}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source DESC, seq) AS i FROM r) SELECT k, source, seq, v FROM n WHERE i = 1",
    "priority_latest": f"WITH {_R}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority DESC, source DESC, seq) AS i FROM r) SELECT k, priority, source, seq, v FROM n WHERE i = 1",
    "tombstone_latest": f"{_NEW} SELECT k, seq, v FROM n WHERE i = 1 AND NOT gone",
    "latest_value": f"{_NEW} SELECT k, seq, v, gone FROM n WHERE i = 1",
    "lsm_range": f"{_NEW} SELECT k, seq, v FROM n WHERE i = 1 AND NOT gone AND k >= {LOW} AND k < {HIGH}",
    "lsm_compact": f"{_NEW} SELECT k, v FROM n WHERE i = 1 AND NOT gone",
    "tiered_merge": (
        f"WITH {_R}, f AS (SELECT level FROM r GROUP BY level HAVING count(DISTINCT run) >= 3), n AS (SELECT *, row_number() OVER (PARTITION BY level, k ORDER "
        "BY seq DESC) AS i FROM r WHERE level IN (SELECT level FROM f)) SELECT CAST(level + 1 AS INT) AS level, k, seq, v, gone FROM n WHERE i = 1"
    ),
    "level_overlap": (
        f"WITH {_R}, m AS (SELECT level, run, min(k) AS lo, max(k) AS hi FROM r GROUP BY ALL) SELECT a.level, a.run, b.run AS below FROM m a JOIN m b ON b.level "
        "= a.level + 1 AND a.lo <= b.hi AND b.lo <= a.hi"
    ),
    "level_budgets": f"WITH {_R} SELECT level, count(*) AS n, CAST(1000 * pow(10, level - 1) AS BIGINT) AS budget FROM r GROUP BY level",
    "snapshot_read": f"WITH {_R}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS i FROM r WHERE seq <= 5000) SELECT k, seq, v FROM n WHERE i = 1 AND NOT gone",
    "difference": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "floor_lookup": _nearest_sql("<=", "max"),
    "ceiling_lookup": _nearest_sql(">=", "min"),
    "pred_lookup": _nearest_sql("<", "max"),
    "succ_lookup": _nearest_sql(">", "min"),
    "point_lookup": "SELECT p.k, c_name FROM range(0, 4000, 250) p(k) LEFT JOIN customer ON c_custkey = p.k",
    "semi_anti": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'has' ELSE 'none' END AS side FROM customer",
    "range_incl_excl": "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 2000",
    "byte_range": "SELECT p_partkey, p_name FROM part WHERE p_name >= 'blue' AND p_name < 'red'",
    "kway_merge": "SELECT o_orderkey, CAST(o_orderkey % 3 AS INT) AS source FROM orders ORDER BY o_orderkey",
    "reverse_merge": "SELECT c_custkey AS k FROM customer UNION ALL SELECT p_partkey FROM part ORDER BY k DESC",
    "first_last": "(SELECT 'first' AS side, o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1) UNION ALL (SELECT 'last', o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1)",
    "topk_counts": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20",
    "split_pivot": "SELECT p_partkey, CASE WHEN p_partkey < 700 THEN 'low' ELSE 'high' END AS side FROM part",
    "prefix_fanout": (
        "SELECT substr(p_name, 1, 1) AS prefix, count(DISTINCT substr(p_name, 2, 1)) AS children, CASE WHEN count(DISTINCT substr(p_name, 2, 1)) <= 4 THEN "
        "4 WHEN count(DISTINCT substr(p_name, 2, 1)) <= 16 THEN 16 WHEN count(DISTINCT substr(p_name, 2, 1)) <= 48 THEN 48 ELSE 256 END AS node FROM part "
        "GROUP BY 1"
    ),
    "event_offsets": f"WITH {_LOG} SELECT * FROM l",
    "read_from": f'WITH {_LOG} SELECT * FROM l WHERE "offset" >= 9000',
    "by_topic": f"WITH {_LOG} SELECT * FROM l WHERE event_type = 'error'",
    "replay_fold": "SELECT user_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY user_id",
    "event_json": """SELECT event_id, '{"topic":"' || event_type || '","level":"INFO","at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","attributes":{"k":"' || json_extract_string(props, '$.k') || '","user":"' || user_id || '"}}' AS json FROM events""",
    "status_worst": f"WITH {_E} SELECT user_id, {_NAME.format('max(' + _RANK.format('status') + ')')} AS status FROM e GROUP BY user_id",
    "status_views": (
        f"WITH {_E}, q AS (SELECT event_type AS view, CASE WHEN NOT critical AND {_RANK.format('status')} >= 3 THEN 2 ELSE {_RANK.format('status')} END AS "
        f"k FROM e), v AS (SELECT view, max(k) AS k FROM q GROUP BY view UNION ALL SELECT 'all', max(k) FROM q) SELECT view, {_NAME.format('k')} AS status, "
        "CASE WHEN k = 4 THEN 503 ELSE 200 END AS code FROM v"
    ),
    "status_transitions": f"WITH {_E}, t AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e) SELECT user_id, event_id, before, status FROM t WHERE before <> status",
    "transition_counter": f'WITH {_E}, t AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e) SELECT user_id, before AS "from", status AS "to", count(*) AS n FROM t WHERE before <> status GROUP BY ALL',
    "staleness": "SELECT user_id, 1706659200 - max(CAST(floor(epoch(ts)) AS BIGINT)) > 3600 * 3.0 AS stale FROM events GROUP BY user_id",
    "saga_outcome": _SAGA,
    "saga_json": (
        f"WITH q AS ({_SAGA}) SELECT saga, '{{\"saga\":' || saga || ',\"outcome\":\"' || outcome || '\"' || coalesce(',\"failed_step\":\"' || failed_step || "
        f"'\"', '') || CASE WHEN forward_ran <> '' THEN ',\"forward_ran\":' || {_LIST.format('forward_ran')} ELSE '' END || CASE WHEN compensated <> '' THEN "
        f"',\"compensated\":' || {_LIST.format('compensated')} ELSE '' END || CASE WHEN failures <> '' THEN ',\"failures\":' || {_LIST.format('failures')} "
        f"ELSE '' END || '}}' AS json FROM q"
    ),
    "fixed_window_limit": "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts)) AS BIGINT) // 86400 ORDER BY ts, event_id) <= 3 AS granted FROM events",
    "window_limit_totals": "SELECT user_id, (CAST(floor(epoch(ts)) AS BIGINT) // 86400) * 86400 AS window_start, least(count(*), 3) AS allowed, greatest(count(*) - 3, 0) AS denied FROM events GROUP BY 1, 2",
    "bounded_queue": (
        "SELECT event_id, user_id, (row_number() OVER w - 1 = 0) OR (row_number() OVER w - 1 > count(*) OVER (PARTITION BY user_id) - 1 - 2) AS delivered "
        "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"
    ),
    "otel_buckets": f"WITH {_H} SELECT event_type, CASE WHEN isinf(le) THEN -1.0 ELSE le END AS le, n FROM h",
    "hist_quantile": (
        f"WITH {_H}, k AS (SELECT *, coalesce(lag(n) OVER w, 0) AS n0, coalesce(lag(le) OVER w, 0.0) AS lo, max(n) OVER (PARTITION BY event_type) AS t FROM "
        "h WINDOW w AS (PARTITION BY event_type ORDER BY le)) SELECT event_type, round(min(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (0.9::DOUBLE "
        "* t - n0) / (n - n0) END), 6) AS value FROM k WHERE n >= 0.9::DOUBLE * t AND n0 < 0.9::DOUBLE * t GROUP BY event_type"
    ),
    "exemplars_topk": "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS i FROM events) WHERE i <= 5",
    "slow_topk": f"WITH {SAMPLES_SQL} SELECT g, CAST(ts AS DATE) AS day, max(x) AS max FROM s GROUP BY 1, 2 ORDER BY max DESC, g, day LIMIT 20",
    "divergence": (
        "SELECT coalesce(c_custkey, s_suppkey) AS k, c_nationkey AS expected, s_nationkey AS observed FROM customer FULL OUTER JOIN supplier ON c_custkey "
        "= s_suppkey WHERE c_nationkey IS DISTINCT FROM s_nationkey"
    ),
    "prom_lines": "SELECT 'app_events_total{site=\"a\\\"b\",type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type",
    "summary_rows": f"WITH {SAMPLES_SQL}, a AS (SELECT g, min(x) AS lo, max(x) AS hi FROM s GROUP BY g) SELECT g, 'low' AS percentile, lo AS value FROM a UNION ALL SELECT g, 'high', hi FROM a",
    "timer_spans": 'WITH m AS (SELECT user_id, event_id, CAST(epoch_us(ts) AS BIGINT) AS mark FROM events) SELECT event_id, coalesce(lag(mark) OVER (PARTITION BY user_id ORDER BY mark, event_id), 0) AS start, mark AS "end" FROM m',
}
