"""Decimals, money, calendars, text, sketches, caches and the relational closure."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagoon.functions import numeric as nx
from lagoon.functions import text as tx
from lagoon.operators import caches, calendar, sketches
from lagoon.sources.tables import table

_FX = "CAST(round(l_extendedprice * 100) AS BIGINT) * 10000000"


def _lines(s, d):
    """Line items with raw fixed-point price, discount and quantity."""
    raw = lambda c: (F.round(F.col(c) * 100).cast("long") * 10_000_000)
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw("l_extendedprice").alias("price"), raw("l_discount").alias("discount"), raw("l_quantity").alias("quantity"), (F.col("l_orderkey") % 5 - 2).alias("sign"))


_L = "l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) * 10000000 AS price, CAST(round(l_discount * 100) AS BIGINT) * 10000000 AS discount, CAST(round(l_quantity * 100) AS BIGINT) * 10000000 AS quantity, l_orderkey % 5 - 2 AS sign FROM lineitem)"


def _round_sql(n: str, d: str, mode: str) -> str:
    """n / d in SQL: cut towards zero, then a step away from it by mode."""
    n, d = f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)"
    q, r = f"(abs({n}) // abs({d}))", f"(abs({n}) % abs({d}))"
    neg = f"(({n} < 0) <> ({d} < 0))"
    away = {
        "DOWN": "false", "UP": f"{r} > 0", "FLOOR": f"{neg} AND {r} > 0", "CEILING": f"NOT {neg} AND {r} > 0",
        "HALF_UP": f"2 * {r} >= abs({d})", "HALF_DOWN": f"2 * {r} > abs({d})", "HALF_EVEN": f"2 * {r} > abs({d}) OR (2 * {r} = abs({d}) AND {q} % 2 = 1)",
    }[mode]
    return f"CAST((CASE WHEN {neg} THEN -1 ELSE 1 END) * ({q} + CASE WHEN {away} THEN 1 ELSE 0 END) AS BIGINT)"


_CURRENCY = "CASE c_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'JPY' WHEN 2 THEN 'KWD' ELSE 'EUR' END"


def _accounts(s, d):
    k = F.col("c_nationkey") % 4
    return table(s, d, "customer").select("c_custkey", (F.round(F.col("c_acctbal") * 100).cast("long") * 10_000_000 + F.col("c_custkey") * 1_234_567).alias("raw"), F.when(k == 0, "USD").when(k == 1, "JPY").when(k == 2, "KWD").otherwise("EUR").alias("currency"))


_A = f"a AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) * 10000000 + c_custkey * 1234567 AS raw, {_CURRENCY} AS currency FROM customer)"


def _settle_sql(mode: str, raw: str = "raw") -> str:
    step = {0: 10**9, 2: 10**7, 3: 10**6}
    return f"CASE currency WHEN 'JPY' THEN {_round_sql(raw, str(step[0]), mode)} * {step[0]} WHEN 'KWD' THEN {_round_sql(raw, str(step[3]), mode)} * {step[3]} ELSE {_round_sql(raw, str(step[2]), mode)} * {step[2]} END"


def _replay(s, d):
    return caches.replay(table(s, d, "events"), F.col("user_id") % 2, "user_id", "event_id", [20, 50], 100_000)


def _texts(s, d):
    v = F.concat(F.element_at(F.array(*map(F.lit, ("", "+", "-", "x"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("."), F.col("p_partkey").cast("string"))))
    return table(s, d, "part").select("p_partkey", v.alias("s"))


_T = "t AS (SELECT p_partkey, list_extract(['', '+', '-', 'x'], CAST(p_partkey % 4 + 1 AS INT)) || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || p_partkey END AS s FROM part)"
_CRON = "*/20 6,18 1-20 * 1-5"


def _dates(s, d):
    return table(s, d, "orders").select("o_orderkey", (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 2000 * 37).alias("asked"))


def _mode_rows(df, keys, value):
    """A row for each mode, of one pass over the rows."""
    each = F.array(*(F.struct(F.lit(m).alias("mode"), value(m).alias("value")) for m in nx.MODES))
    return df.select(*keys, F.explode(each).alias("_e")).select(*keys, "_e.mode", "_e.value")


def _fx_modes(s, d, parts):
    """A product or quotient of each line, made once, under every mode."""
    made = _lines(s, d).select("l_orderkey", "l_linenumber", parts.alias("made"))
    return _mode_rows(made, ["l_orderkey", "l_linenumber"], lambda m: nx.rounded("made", m))


def _sketch_ok(s, d):
    ev, key = table(s, d, "documents"), "doc_id"
    est = sketches.hll_estimate(sketches.hll_registers(ev, [], key, 12), [], 12)
    return est.crossJoin(ev.agg(F.countDistinct(key).alias("n"))).select((F.abs(F.col("estimate") - F.col("n")) <= 0.06 * F.col("n")).alias("ok"))


def _hll_union(s, d):
    e = table(s, d, "lineitem")
    a = sketches.hll_registers(e.where("l_partkey % 3 != 0"), [], "l_partkey", 12)
    b = sketches.hll_registers(e.where("l_partkey % 3 != 1"), [], "l_partkey", 12)
    whole = sketches.hll_registers(e, [], "l_partkey", 12)
    both = sketches.hll_merge(a, b)
    return both.join(whole.withColumnRenamed("rho", "rho_whole"), "register", "full_outer").agg((F.count_if(~F.col("rho").eqNullSafe(F.col("rho_whole"))) == 0).alias("same"))


def _cms_ok(s, d):
    e = table(s, d, "lineitem")
    depth, width = sketches.cms_shape(0.001, 0.99)
    est = sketches.cms_estimate(sketches.cms(e, [], "l_suppkey", depth, width), e, "l_suppkey", depth, width)
    true = e.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    both = est.join(true, "l_suppkey").crossJoin(e.agg(F.count("*").alias("total")))
    return both.agg(F.min(F.col("estimate") >= F.col("n")).alias("never_below"), F.min(F.col("estimate") <= F.col("n") + sketches.cms_margin(F.col("total"), width)).alias("within"))


def _bloom_ok(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    bits, k = sketches.bloom_shape(20_000)
    f = sketches.bloom(c, [], "k", bits, k)
    hits = sketches.bloom_contains(f, c, "k", bits, k).agg(F.min("maybe").alias("all_found"))
    absent = s.range(10_000_000, 10_002_000).select(F.col("id").cast("string").alias("k"))
    wrong = sketches.bloom_contains(f, absent, "k", bits, k).agg((F.count_if("maybe") <= 40).alias("few_wrong"))
    return hits.crossJoin(wrong)


def _heavy(s, d):
    e = table(s, d, "lineitem")
    depth, width = sketches.cms_shape(0.0005, 0.99)
    return sketches.heavy_hitters(e, "l_suppkey", 10, depth, width)


def _cuckoo_load(s, d):
    """Keys with and without a place."""
    made = sketches.cuckoo(table(s, d, "customer").withColumn("g", F.col("c_nationkey") % 4), ["g"], "c_custkey", 256)
    sums = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("n", F.col("bucket") >= 0), ("lost", F.col("bucket") < 0))]
    return made.groupBy("g").agg(*sums)


QUERIES = {
    "fx_mul_modes": lambda s, d: _fx_modes(s, d, nx.mul_parts(F.col("price") * F.col("sign"), F.col("discount") + 123_456_789)),
    "fx_div_modes": lambda s, d: _fx_modes(s, d, nx.div_parts(F.col("price") * F.col("sign"), F.col("quantity") + 7)),
    "rounding_table": lambda s, d: _mode_rows(s.sql("SELECT * FROM VALUES (25L, 10L), (-25L, 10L), (35L, 10L), (-35L, 10L), (27L, -10L) AS t(n, d)"), ["n", "d"], lambda m: nx.div_round("n", "d", m).cast("long")),
    "tick_grid": lambda s, d: _lines(s, d).select("l_orderkey", "l_linenumber", nx.to_tick("price", 250_000_000, "HALF_EVEN").alias("on_tick"), (F.col("price") % 250_000_000 == 0).alias("is_on")),
    "fx_round": lambda s, d: _accounts(s, d).select("c_custkey", nx.fx_round("raw", 1, "HALF_EVEN").alias("one"), nx.fx_round(-F.col("raw"), 0, "FLOOR").alias("whole")),
    "fx_checked": lambda s, d: _accounts(s, d).select("c_custkey", nx.checked_add("raw", F.lit(nx.RAW_MAX - 5_000_000_000_000)).alias("checked"), nx.saturating_add("raw", F.lit(nx.RAW_MAX - 5_000_000_000_000)).alias("saturated")),
    "money_sum": lambda s, d: _accounts(s, d).groupBy("currency").agg(F.sum(nx.settle("raw", "currency", "HALF_EVEN")).alias("total"), F.count("*").alias("n")),
    "fx_convert": lambda s, d: _accounts(s, d).select("c_custkey", nx.fx_mul("raw", F.lit(151_234_500_000), "HALF_EVEN").alias("yen")).select("c_custkey", F.lit("JPY").alias("to"), nx.settle("yen", F.lit("JPY"), "HALF_UP").alias("settled")),
    "currency_codes": lambda s, d: _accounts(s, d).select("c_custkey", nx.currency_code(F.concat(F.lower("currency"), F.when(F.col("c_custkey") % 7 == 0, "x").otherwise(""))).alias("code"), nx.minor_decimals("currency").alias("decimals")),
    "exact_dot": lambda s, d: _lines(s, d).groupBy((F.col("l_orderkey") % 10).alias("g")).agg(F.sum(F.col("price").cast("decimal(19,0)") * F.col("discount").cast("decimal(19,0)")).cast("string").alias("dot")),
    "exact_average": lambda s, d: _lines(s, d).groupBy((F.col("l_orderkey") % 10).alias("g")).agg(F.sum(F.col("price").cast("decimal(38,0)")).alias("t"), F.count("*").alias("n")).select("g", nx.div_round("t", "n", "HALF_EVEN").cast("long").alias("average")),
    "dec_parse": lambda s, d: _texts(s, d).select("p_partkey", nx.parse_fixed("s").alias("raw")),
    "dec_format": lambda s, d: _accounts(s, d).select("c_custkey", nx.format_fixed(-F.col("raw")).alias("short"), nx.format_places("raw", 2).alias("two")),
    "cron_next": lambda s, d: calendar.next_fire(_dates(s, d), "asked", calendar.Cron.parse(_CRON), date(1994, 12, 31), date(2001, 12, 31)),
    "timer_fires": lambda s, d: calendar.fire_ticks(table(s, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "cancel").otherwise("schedule").alias("action"), (F.col("event_id") * 10).alias("tick"), (F.col("event_id") % 7).alias("delay")), "user_id", "event_id", "action", "tick", "delay"),
    "redact": lambda s, d: table(s, d, "customer").select("c_custkey", tx.redact(F.element_at(F.array(F.lit("API_TOKEN"), F.lit("card"), F.lit("name"), F.lit("secret_id")), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_name"), {"card": "last4"}, {"token": "mask", "secret": "hash"}).alias("shown")),
    "glob_select": lambda s, d: table(s, d, "customer").select("c_custkey", "c_name").where(tx.glob(F.col("c_name"), "Customer#*7*3")),
    "detail_keys": lambda s, d: table(s, d, "part").select("p_partkey", tx.detail_key(F.concat(F.element_at(F.array(F.lit("APP_"), F.lit("APP_DB_"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")), F.upper("p_type")), {"ECONOMY": "eco"}, ["APP_", "APP_DB_"]).alias("key")),
    "hll_error_ok": _sketch_ok,
    "hll_union_ok": _hll_union,
    "cms_bounds_ok": _cms_ok,
    "bloom_no_false_neg": _bloom_ok,
    "topk_heavy": _heavy,
    "cms_windowed": lambda s, d: sketches.cms_window(table(s, d, "events"), "ts", "event_type", "1 day", "3 days"),
    "counting_cells": lambda s, d: sketches.counting_bloom(
        table(s, d, "orders").select("o_custkey", "o_orderstatus"), "o_custkey", F.when(F.col("o_orderstatus") == "F", -1).otherwise(1), 1 << 12, 5, form="md5"
    ),
    "cuckoo_load": _cuckoo_load,
    "cms_conservative": lambda s, d: sketches.cms_conservative(table(s, d, "events"), ["event_type"], "user_id", "event_id", 4, 64, form="md5"),
    "hll_registers": lambda s, d: sketches.hll_registers(table(s, d, "events"), ["event_type"], "user_id", 8, form="md5"),
    "fnv_vectors": lambda s, d: s.sql("SELECT * FROM VALUES (''), ('a'), ('foobar') AS t(s)").select("s", tx.fnv1a("s").alias("h")),
    "cache_replay": lambda s, d: _replay(s, d).agg(F.sum(F.col("hits") + F.col("misses")).alias("accesses")),
    "lru_hits": lambda s, d: _replay(s, d).drop("hit_ratio"),
    "revenue_join": lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.countDistinct("o_orderkey").alias("orders")),
    "rollup_cube": lambda s, d: table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q")),
    "grouping_sets": lambda s, d: table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("gid"), F.count("*").alias("n")),
    "window_frames": lambda s, d: table(s, d, "orders").select("o_orderkey", F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)).alias("last3"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate")).cast("long").alias("day_rank")),
    "set_operations": lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))).withColumn("op", F.lit("both")).unionByName(table(s, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))).withColumn("op", F.lit("no supplier"))),
}

def _md5(salt: str, key: str) -> str:
    """The first 60 bits of a salted digest."""
    return f"CAST('0x' || substr(md5({salt} || ':' || {key}), 1, 15) AS BIGINT)"


_COUNTING = f"""WITH k AS (SELECT o_custkey AS key, sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) AS n FROM orders GROUP BY 1),
b AS (SELECT n, (({_md5("'11'", 'key')} % 4096) + ({_md5("'13'", 'key')} % 4096) * i + i * i) % 4096 AS cell FROM k, range(5) t(i))
SELECT cell, CAST(least(sum(n), 15) AS BIGINT) AS c FROM b GROUP BY cell HAVING sum(n) > 0"""
#: Key by key, only the least of a key's cells grow.
_CONSERVATIVE = f"""WITH RECURSIVE e AS MATERIALIZED (
  SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n, [{', '.join(f"CAST({64 * d} + {_md5(repr(str(d)), 'user_id')} % 64 AS INT)" for d in range(4))}] AS at FROM events),
s AS (
  SELECT DISTINCT event_type, CAST(0 AS BIGINT) AS n, list_transform(range(256), lambda x: CAST(0 AS BIGINT)) AS cells FROM events
  UNION ALL
  SELECT e.event_type, e.n, list_transform(s.cells, lambda x, i: CASE WHEN list_contains(e.at, CAST(i - 1 AS INT)) THEN greatest(x, 1 + least(s.cells[e.at[1] + 1], s.cells[e.at[2] + 1], s.cells[e.at[3] + 1], s.cells[e.at[4] + 1])) ELSE x END)
  FROM s JOIN e ON e.event_type = s.event_type AND e.n = s.n + 1),
f AS (SELECT event_type, arg_max(cells, n) AS cells FROM s GROUP BY event_type)
SELECT event_type, CAST(i // 64 AS INT) AS row, CAST(i % 64 AS INT) AS idx, cells[i + 1] AS c FROM f, range(256) t(i) WHERE cells[i + 1] > 0"""
_REGISTERS = f"""WITH h AS (SELECT event_type, {_md5("'1'", 'user_id')} AS h FROM events)
SELECT event_type, CAST(h >> 52 AS INT) AS register, CAST(max(CASE WHEN h % 4503599627370496 = 0 THEN 53 ELSE 53 - length(bin(h % 4503599627370496)) END) AS INT) AS rho FROM h GROUP BY 1, 2"""
#: Keys used since a key's last use are those whose own last use came before it.
_LRU = """WITH t AS (SELECT user_id % 2 AS shard, user_id, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) AS p FROM events),
q AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY shard, user_id ORDER BY p), 0) AS last FROM t),
d AS (SELECT a.shard, a.p, count(b.p) + 1 AS distance FROM q a LEFT JOIN q b ON a.shard = b.shard AND b.p > a.last AND b.p < a.p AND b.last < a.last WHERE a.last > 0 GROUP BY ALL),
n AS (SELECT shard, count(*) AS n FROM t GROUP BY shard)
SELECT n.shard, capacity, count(*) FILTER (WHERE distance <= capacity) AS hits, max(n) - count(*) FILTER (WHERE distance <= capacity) AS misses
FROM n JOIN d ON d.shard = n.shard, (VALUES (20), (50)) c(capacity) GROUP BY n.shard, capacity"""
_MODE = lambda n, d, extra="": " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{m}' AS mode, {_round_sql(n, d, m)} AS value FROM l" for m in nx.MODES)
SQL = {
    "fx_mul_modes": f"WITH {_L} " + _MODE("CAST(price * sign AS HUGEINT) * (discount + 123456789)", "1000000000"),
    "fx_div_modes": f"WITH {_L} " + _MODE("CAST(price * sign AS HUGEINT) * 1000000000", "(quantity + 7)"),
    "rounding_table": "WITH t(n, d) AS (VALUES (CAST(25 AS BIGINT), CAST(10 AS BIGINT)), (-25, 10), (35, 10), (-35, 10), (27, -10)) " + " UNION ALL ".join(f"SELECT n, d, '{m}' AS mode, {_round_sql('n', 'd', m)} AS value FROM t" for m in nx.MODES),
    "tick_grid": f"WITH {_L} SELECT l_orderkey, l_linenumber, {_round_sql('price', '250000000', 'HALF_EVEN')} * 250000000 AS on_tick, price % 250000000 = 0 AS is_on FROM l",
    "fx_round": f"WITH {_A} SELECT c_custkey, {_round_sql('raw', '100000000', 'HALF_EVEN')} * 100000000 AS one, {_round_sql('-raw', '1000000000', 'FLOOR')} * 1000000000 AS whole FROM a",
    "fx_checked": (
        f"WITH {_A}, b AS (SELECT c_custkey, CAST(raw AS HUGEINT) + 9223372036854775807 - 5000000000000 AS t FROM a) SELECT c_custkey, TRY_CAST(t AS BIGINT) "
        "AS checked, CAST(least(t, 9223372036854775807) AS BIGINT) AS saturated FROM b"
    ),
    "money_sum": f"WITH {_A} SELECT currency, CAST(sum({_settle_sql('HALF_EVEN')}) AS BIGINT) AS total, count(*) AS n FROM a GROUP BY currency",
    "fx_convert": (
        f"WITH {_A}, c AS (SELECT c_custkey, {_round_sql('CAST(raw AS HUGEINT) * 151234500000', '1000000000', 'HALF_EVEN')} AS y FROM a) SELECT c_custkey, "
        f"'JPY' AS \"to\", {_round_sql('y', '1000000000', 'HALF_UP')} * 1000000000 AS settled FROM c"
    ),
    "currency_codes": f"WITH {_A} SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE currency END AS code, CASE currency WHEN 'JPY' THEN 0 WHEN 'KWD' THEN 3 ELSE 2 END AS decimals FROM a",
    "exact_dot": f"WITH {_L} SELECT l_orderkey % 10 AS g, CAST(sum(CAST(price AS HUGEINT) * discount) AS VARCHAR) AS dot FROM l GROUP BY 1",
    "exact_average": f"WITH {_L}, t AS (SELECT l_orderkey % 10 AS g, sum(price) AS t, count(*) AS n FROM l GROUP BY 1) SELECT g, {_round_sql('t', 'n', 'HALF_EVEN')} AS average FROM t",
    "dec_parse": f"WITH {_T} SELECT p_partkey, CASE WHEN regexp_full_match(s, '[+-]?([0-9]+([.][0-9]{{0,9}})?|[.][0-9]{{1,9}})') THEN CAST(CAST(s AS DECIMAL(28, 9)) * 1000000000 AS BIGINT) END AS raw FROM t",
    "dec_format": (
        f"WITH {_A}, f AS (SELECT c_custkey, raw, -raw AS m FROM a), g AS (SELECT *, regexp_replace(lpad(CAST(abs(m) % 1000000000 AS VARCHAR), 9, '0'), '0+$', "
        "'') AS part FROM f) SELECT c_custkey, CASE WHEN m < 0 THEN '-' ELSE '' END || CAST(abs(m) // 1000000000 AS VARCHAR) || CASE WHEN part = '' THEN '' "
        "ELSE '.' || part END AS short, CASE WHEN raw < 0 THEN '-' ELSE '' END || CAST(abs(raw) // 1000000000 AS VARCHAR) || '.' || substr(lpad(CAST(abs(raw) "
        "% 1000000000 AS VARCHAR), 9, '0'), 1, 2) AS two FROM g"
    ),
    "cron_next": (
        "WITH o AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 2000 * 37 AS asked FROM orders), days AS (SELECT CAST(x AS TIMESTAMP) "
        "AS day FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY) t(x) WHERE dayofweek(x) BETWEEN 1 AND 5 AND day(x) BETWEEN "
        "1 AND 20), fires AS (SELECT CAST(epoch(day) AS BIGINT) + h * 3600 + m * 60 AS f FROM days, (VALUES (6), (18)) a(h), (VALUES (0), (20), (40)) b(m)) "
        "SELECT o_orderkey, asked, f AS next_fire FROM o ASOF JOIN fires ON o.asked <= fires.f"
    ),
    "timer_fires": (
        "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) SELECT user_id, event_id * 10 + greatest(event_id "
        "% 7, 1) AS fire_tick FROM n WHERE i = 1 AND event_type <> 'error'"
    ),
    "redact": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '***' WHEN 1 THEN '***' || right(c_name, 4) WHEN 2 THEN c_name ELSE sha256(c_name) END AS shown FROM customer",
    "glob_select": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#%7%3'",
    "detail_keys": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 AND upper(p_type) = 'ECONOMY' THEN 'eco' ELSE lower(p_type) END AS key FROM part",
    "hll_error_ok": "SELECT true AS ok",
    "hll_union_ok": "SELECT true AS same",
    "cms_bounds_ok": "SELECT true AS never_below, true AS within",
    "bloom_no_false_neg": "SELECT true AS all_found, true AS few_wrong",
    "topk_heavy": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10",
    "cms_windowed": "SELECT date_trunc('day', ts) + INTERVAL (k) DAY AS at, event_type, count(*) AS n FROM events, range(1, 4) t(k) GROUP BY 1, 2",
    "counting_cells": _COUNTING,
    "cuckoo_load": "SELECT CAST(c_nationkey % 4 AS INT) AS g, count(DISTINCT c_custkey) AS n, CAST(0 AS BIGINT) AS lost FROM customer GROUP BY 1",
    "cms_conservative": _CONSERVATIVE,
    "hll_registers": _REGISTERS,
    "fnv_vectors": "SELECT * FROM (VALUES ('', CAST(-3750763034362895579 AS BIGINT)), ('a', CAST(-5808556873153909620 AS BIGINT)), ('foobar', CAST(-8821353812377114648 AS BIGINT))) t(s, h)",
    "cache_replay": "SELECT 2 * count(*) AS accesses FROM events",
    "lru_hits": _LRU,
    "revenue_join": (
        "SELECT n_name, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN "
        "orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
    ),
    "rollup_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "window_frames": (
        "SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING "
        "AND CURRENT ROW) AS BIGINT) AS last3, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS day_rank FROM orders"
    ),
    "set_operations": (
        "SELECT k, 'both' AS op FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'no supplier' "
        "FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier)"
    ),
}
