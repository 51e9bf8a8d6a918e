"""Sketches cell by cell, checked ranges, money, nested health, schedules and runs on disk.

Sketches hash with MD5 here, so that SQL can make the same cells.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from lagoon.functions import numeric as nx
from lagoon.operators import calendar, eventlog, lookup, metrics, sketches
from lagoon.plans.value_queries import _A, _accounts, _md5, _round_sql
from lagoon.sources import runs
from lagoon.sources.scratch import scratch
from lagoon.sources.tables import table

_DEPTH, _WIDTH = 3, 32
_SHAPE = (_DEPTH, _WIDTH, "md5")


def _cms(df, key):
    return sketches.cms(df, [], key, _DEPTH, _WIDTH, form="md5")


def _merge(how):
    """Sketches of the suppliers of odd and of even numbers as one."""

    def query(s, d):
        e = table(s, d, "lineitem")
        parts = [_cms(e.where(F.col("l_suppkey") % 2 == i), "l_suppkey") for i in (0, 1)]
        return sketches.cms_merge(*parts, _SHAPE, _SHAPE, how)

    return query


def _windows(s, d):
    """Days as slices, three of them in a window."""
    return sketches.cms_windows(table(s, d, "events"), "ts", "user_id", "1 day", 3, 2, 16, "md5")


_BITS, _K = 4096, 4


def _keys(s, d, of):
    return table(s, d, "customer").select(F.col("c_custkey").alias("k")).where(of)


def _bloom_union(s, d):
    shape = (_BITS, _K, "md5")
    made = [sketches.bloom(_keys(s, d, f"k % 3 = {i}"), [], "k", _BITS, _K, "md5") for i in (0, 1)]
    return sketches.bloom_union(*made, shape, shape)


def _bloom_probe(s, d):
    return sketches.bloom_contains(_bloom_union(s, d), _keys(s, d, "true"), "k", _BITS, _K, "md5")


def _bloom_sizes(s, d):
    est = sketches.bloom_estimates(_bloom_union(s, d), [], _BITS, _K)
    return est.select("set_bits", F.round("keys", 4).alias("keys"), F.round("fpp", 6).alias("fpp"))


def _occupancy(s, d):
    return sketches.cms_occupancy(_cms(table(s, d, "lineitem"), "l_suppkey"), _DEPTH, _WIDTH).select(F.round("occupancy", 6).alias("occupancy"), "total")


def _scalable(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("seq"))
    return sketches.scalable_contains(sketches.scalable_bloom(c.where("k % 2 = 0"), "k", 64, 512, 4, "md5"), c, "k", 512, 4, "md5")


def _cuckoo_members(s, d):
    """Of customers of even number in the filter, then without those of multiples of 4: all that stay are found, few others."""
    c = table(s, d, "customer").select(F.lit("all").alias("g"), F.col("c_custkey").alias("k"))
    made = sketches.cuckoo(c.where("k % 2 = 0"), ["g"], "k", 256, 16)
    left = sketches.cuckoo_delete(made, c.where("k % 4 = 0"), ["g"], "k", 256, 16)
    found = sketches.cuckoo_contains(left, c, ["g"], "k", 256, 16)
    kept = F.col("k") % 4 == 2
    size = left.agg(F.sum("n").alias("size"))
    return found.agg(F.min(F.when(kept, F.col("maybe"))).alias("all_found"), (F.count_if(~kept & F.col("maybe")) <= F.count("*") / 100).alias("few_wrong")).crossJoin(size)


def _money(s, d):
    a = _accounts(s, d)
    b = a.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("raw").alias("other"), F.col("currency").alias("other_currency"))
    both = a.join(b, "c_custkey")
    return both.select("c_custkey", nx.money_add("raw", "currency", "other", "other_currency").alias("total"), nx.money_add("raw", "currency", "other", "other_currency", -1).alias("rest"))


def _scaled(s, d):
    return _accounts(s, d).select("c_custkey", nx.to_scaled("raw", 3, "HALF_UP").alias("three"), nx.to_scaled("raw", 11, "DOWN").alias("eleven"), nx.to_scaled("raw", 18, "DOWN").alias("eighteen"))


def _tree(s, d):
    """Orders below customers below nations."""
    o = table(s, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.concat(F.lit("c"), "o_custkey").alias("parent"), F.when(F.col("o_orderkey") % 50 == 0, "DOWN").when(F.col("o_orderkey") % 7 == 0, "WARN").otherwise("UP").alias("status"))
    c = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.when(F.col("c_custkey") % 90 == 0, "DEGRADED").otherwise("UP").alias("status"))
    n = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("UP").alias("status"))
    return eventlog.effective(o.unionByName(c).unionByName(n), "node", "parent", "status")


def _health(s, d):
    c = table(s, d, "customer").select("c_nationkey", F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("name"), F.when(F.col("c_custkey") % 40 == 0, "DOWN").otherwise("UP").alias("status"), (F.col("c_custkey") * 10).alias("age"))
    return eventlog.health_json(c.withColumn("old", F.col("age") > 700), ["c_nationkey"], "name", "status", "age", "old", F.lit("2024-01-31T00:00:00Z"))


def _fires(s, d):
    o = table(s, d, "orders").select("o_orderkey", (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 2000 * 37).alias("asked"))
    made = calendar.next_fires(o, "asked", calendar.Cron.parse("*/20 6,18 1-20 * 1-5"), date(1994, 12, 31), date(2002, 1, 31), 3)
    return made.select("o_orderkey", F.element_at("fires", 3).alias("third"))


def _runs(s, d):
    """Two runs on disk with filters on their keys, read as one."""
    paths = [scratch(s, "run") for _ in range(2)]
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    for i, (path, codec) in enumerate(zip(paths, ("lz4", "zstd"), strict=True)):
        runs.write_run(o.where(F.col("o_orderkey") % 2 == i), "o_custkey", path, codec=codec)
    return runs.read_runs(s, *paths).where("o_custkey IN (7, 77, 777)")


def _timers(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("mark"))
    return metrics.timer_totals(metrics.spans(e, "user_id", "mark", "event_id"), "user_id")


def _two_ends(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return lookup.disjoint_union(o.where("o_orderkey <= 700"), o.where("o_orderkey > 700"), "o_orderkey")


QUERIES = {
    "cms_cells": lambda s, d: _cms(table(s, d, "lineitem"), "l_suppkey"),
    "cms_merge_sum": _merge("sum"),
    "cms_merge_max": _merge("max"),
    "cms_window_cells": _windows,
    "cms_occupancy": _occupancy,
    "bloom_union": _bloom_union,
    "bloom_probe": _bloom_probe,
    "bloom_estimates": _bloom_sizes,
    "scalable_bloom": _scalable,
    "cuckoo_members": _cuckoo_members,
    "money_add": _money,
    "fx_rescale": _scaled,
    "nested_status": _tree,
    "health_json": _health,
    "cron_rearm": _fires,
    "run_lookup": _runs,
    "timer_totals": _timers,
    "stage_counters": lambda s, d: metrics.stage_counters(table(s, d, "events").select("event_type", (F.col("event_id") % 9 == 0).alias("gone")), "event_type", "gone"),
    "event_counter": lambda s, d: eventlog.event_counts(table(s, d, "events").select("event_type", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level")), "event_type", "level"),
    "disjoint_union": _two_ends,
    "sorted_build": lambda s, d: lookup.sorted_build(table(s, d, "orders").select("o_orderkey"), "o_orderkey"),
    "delay_ticks": lambda s, d: table(s, d, "orders").select("o_orderkey", calendar.ticks_of("o_orderkey", 64).alias("ticks")),
}


def _cells_sql(where: str = "true") -> str:
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS row, CAST({_md5(repr(str(i)), 'l_suppkey')} % {_WIDTH} AS INT) AS idx FROM lineitem WHERE {where}" for i in range(_DEPTH))
    return f"SELECT row, idx, count(*) AS c FROM ({rows}) GROUP BY row, idx"


def _bits_sql(keys: str, bits: str = str(_BITS)) -> str:
    """(k, bit) of each key, by the same double hashing."""
    a, b = (f"({_md5(salt, 'k')} % {bits})" for salt in ("'11'", "'13'"))
    return f"SELECT k, ({a} + {b} * i + i * i) % {bits} AS bit FROM ({keys}), range({_K}) t(i)"


_UNION = f"u AS (SELECT DISTINCT bit FROM ({_bits_sql('SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 2')}))"
_WORST = "CASE max({0}) WHEN 0 THEN 'UP' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'WARN' WHEN 3 THEN 'DEGRADED' ELSE 'DOWN' END"

SQL = {
    "cms_cells": _cells_sql(),
    "cms_merge_sum": _cells_sql(),
    "cms_merge_max": f"SELECT row, idx, max(c) AS c FROM ({_cells_sql('l_suppkey % 2 = 0')} UNION ALL {_cells_sql('l_suppkey % 2 = 1')}) GROUP BY row, idx",
    "cms_window_cells": "SELECT date_trunc('day', ts) + INTERVAL (k) DAY AS at, CAST(r AS INT) AS row, CAST("
    + _md5("r", "user_id")
    + " % 16 AS INT) AS idx, count(*) AS c FROM events, range(1, 4) t(k), range(2) q(r) GROUP BY ALL",
    "cms_occupancy": f"WITH c AS ({_cells_sql()}) SELECT round(count(*) / {float(_DEPTH * _WIDTH)}, 6) AS occupancy, (SELECT count(*) FROM lineitem) AS total FROM c",
    "bloom_union": f"WITH {_UNION} SELECT bit FROM u",
    "bloom_probe": f"WITH {_UNION}, p AS ({_bits_sql('SELECT c_custkey AS k FROM customer')}) SELECT p.k, count(u.bit) = count(*) AS maybe FROM p LEFT JOIN u ON u.bit = p.bit GROUP BY p.k",
    "bloom_estimates": f"WITH {_UNION}, n AS (SELECT count(*) AS s FROM u) SELECT s AS set_bits, round(-{_BITS / _K} * ln(1 - s / {float(_BITS)}), 4) AS keys, round(pow(s / {float(_BITS)}, {_K}), 6) AS fpp FROM n",
    "scalable_bloom": f"""WITH l AS (SELECT c_custkey AS k, CAST(floor(log2((row_number() OVER (ORDER BY c_custkey) - 1) / 64.0 + 1)) AS INT) AS layer FROM customer WHERE c_custkey % 2 = 0),
f AS (SELECT DISTINCT layer, bit FROM (SELECT layer, ({_md5("'11'", "k")} % (512 << layer) + {_md5("'13'", "k")} % (512 << layer) * i + i * i) % (512 << layer) AS bit FROM l, range(4) t(i))),
p AS (SELECT c_custkey AS k, layer, ({_md5("'11'", "c_custkey")} % (512 << layer) + {_md5("'13'", "c_custkey")} % (512 << layer) * i + i * i) % (512 << layer) AS bit FROM customer, (SELECT DISTINCT layer FROM l), range(4) t(i)),
m AS (SELECT p.k, p.layer, count(f.bit) = count(*) AS m FROM p LEFT JOIN f ON f.layer = p.layer AND f.bit = p.bit GROUP BY p.k, p.layer)
SELECT k, bool_or(m) AS maybe FROM m GROUP BY k""",
    "cuckoo_members": "SELECT true AS all_found, true AS few_wrong, count(*) FILTER (WHERE c_custkey % 4 = 2) AS size FROM customer",
    "money_add": (
        f"WITH {_A} SELECT x.c_custkey, CASE WHEN x.currency = y.currency THEN x.raw + y.raw END AS total, CASE WHEN x.currency = y.currency THEN x.raw - y.raw "
        "END AS rest FROM a x JOIN a y ON y.c_custkey = x.c_custkey + 1"
    ),
    "fx_rescale": (
        f"WITH {_A} SELECT c_custkey, {_round_sql('raw', '1000000', 'HALF_UP')} AS three, TRY_CAST(CAST(raw AS HUGEINT) * 100 AS BIGINT) AS eleven, TRY_CAST(CAST(raw "
        "AS HUGEINT) * 1000000000 AS BIGINT) AS eighteen FROM a"
    ),
    "nested_status": f"""WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN 4 WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END AS r FROM orders),
w AS (SELECT o_custkey, max(r) AS r FROM o GROUP BY o_custkey),
c AS (SELECT c_custkey, c_nationkey, greatest(CASE WHEN c_custkey % 90 = 0 THEN 3 ELSE 0 END, coalesce(w.r, 0)) AS r FROM customer LEFT JOIN w ON o_custkey = c_custkey),
t AS (SELECT 'o' || o_orderkey AS node, r FROM o UNION ALL SELECT 'c' || c_custkey, r FROM c UNION ALL SELECT 'n' || n_nationkey, coalesce(max(r), 0) FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY n_nationkey)
SELECT node, {_WORST.format('r')} AS status FROM t GROUP BY node""",
    "health_json": """SELECT c_nationkey, '{"status":"' || CASE WHEN bool_or(c_custkey % 40 = 0) THEN 'DOWN' ELSE 'UP' END || '","refreshed_at":"2024-01-31T00:00:00Z","components":{' ||
  string_agg('"c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '":{"status":"' || CASE WHEN c_custkey % 40 = 0 THEN 'DOWN' ELSE 'UP' END || '","age_ms":' || c_custkey * 10 || ',"stale":' || (c_custkey * 10 > 700) || '}', ',' ORDER BY c_custkey) || '}}' AS json
FROM customer GROUP BY c_nationkey""",
    "cron_rearm": """WITH o AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 2000 * 37 AS asked FROM orders),
days AS (SELECT CAST(x AS TIMESTAMP) AS day FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY) t(x) WHERE dayofweek(x) BETWEEN 1 AND 5 AND day(x) BETWEEN 1 AND 20),
fires AS (SELECT CAST(epoch(day) AS BIGINT) + h * 3600 + m * 60 AS f FROM days, (VALUES (6), (18)) a(h), (VALUES (0), (20), (40)) b(m)),
n AS (SELECT f, lead(f, 2) OVER (ORDER BY f) AS third FROM fires)
SELECT o_orderkey, third FROM o ASOF JOIN n ON o.asked <= n.f""",
    "run_lookup": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 77, 777)",
    "timer_totals": (
        "WITH m AS (SELECT user_id, event_id, CAST(epoch_us(ts) AS BIGINT) AS mark FROM events), l AS (SELECT user_id, mark - coalesce(lag(mark) OVER (PARTITION "
        "BY user_id ORDER BY mark, event_id), 0) AS n FROM m) SELECT user_id, count(*) AS spans, CAST(sum(n) AS BIGINT) AS total, max(n) AS longest FROM l "
        "GROUP BY user_id"
    ),
    "stage_counters": "SELECT event_type, count(*) AS ops_total, count(*) FILTER (WHERE event_id % 9 = 0) AS dropped_total FROM events GROUP BY event_type",
    "event_counter": "SELECT event_type, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS n FROM events GROUP BY ALL",
    "disjoint_union": "SELECT o_orderkey, o_custkey FROM orders",
    "sorted_build": "SELECT o_orderkey FROM orders ORDER BY o_orderkey",
    "delay_ticks": "SELECT o_orderkey, greatest(CAST(ceil(o_orderkey / 64.0) AS BIGINT), 1) AS ticks FROM orders",
}
