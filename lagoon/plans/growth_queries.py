"""Sketches that grow or hold on, exact sums beyond 38 digits, and gauges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagoon.functions import wide
from lagoon.operators import metrics, sketches
from lagoon.plans.value_queries import _L, _lines, _md5, _round_sql
from lagoon.sources.tables import table

_CELLS, _FIRST, _P, _FINE = 64, 64, 8, 14


def _sticky(s, d):
    """Users come with every event and go with every error, in a filter small enough that cells fill up."""
    e = table(s, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("gone"))
    return sketches.counting_calls(e, "user_id", "event_id", F.col("gone"), _CELLS, 2, form="md5")


def _chain(s, d):
    """Layers of a filter of customers by first order with their sizes, and as layer -1 what is left of it without every third customer."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey")
    made = sketches.cuckoo_chain(o, "o_custkey", "o_orderkey", _FIRST, 256)
    left = sketches.chain_delete(made, o.where("o_custkey % 3 = 0"), "o_custkey", 256)
    sizes = made.groupBy("layer").agg(F.sum("n").alias("n"))
    return sizes.unionByName(left.agg(F.lit(-1).alias("layer"), F.sum("n").alias("n")))


def _chain_members(s, d):
    """Each customer that ordered, and whether the filter finds it in its own layer or a newer one."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey")
    made = sketches.cuckoo_chain(o, "o_custkey", "o_orderkey", _FIRST, 256)
    found = sketches.chain_contains(made, o, "o_custkey", 256).join(sketches.chain_layers(o, "o_custkey", "o_orderkey", _FIRST).withColumnRenamed("layer", "own"), "o_custkey")
    return found.select("o_custkey", "maybe", F.col("own").alias("layer"), (F.col("layer") >= F.col("own")).alias("placed"))


def _union_rates(s, d):
    """Two filters as one: keys that both hold have two entries, slots in use are counted over all parts."""
    o = table(s, d, "orders").select("o_custkey", (F.col("o_orderkey") % 2).alias("half"))
    a, b = (sketches.cuckoo(o.where(F.col("half") == h), [], "o_custkey", 256, parts=64) for h in (0, 1))
    return sketches.cuckoo_rates(sketches.cuckoo_union(a, b, [], 256), [], 256)


def _fold(s, d):
    return sketches.hll_fold(sketches.hll_registers(table(s, d, "events"), ["event_type"], "user_id", _FINE, "md5"), _FINE, _P)


def _sparse(s, d):
    """Customers by nation: few enough in some for fine entries."""
    return sketches.hll_sparse(table(s, d, "customer"), ["c_nationkey"], "c_custkey", _P, _FINE, "md5")


def _sparse_merge(s, d):
    c = table(s, d, "customer").withColumn("g", F.col("c_nationkey") % 5)
    a, b = (sketches.hll_sparse(c.where(cond), ["g"], "c_custkey", _P, _FINE, "md5") for cond in ("c_custkey % 2 = 0", "c_custkey % 3 = 0"))
    return sketches.hll_merge_sparse(a, b, _P, _FINE)


def _wide_sums(s, d):
    """Prices in thousandths of cents times quantities in parts of a hundred millionth: sums of some orders have 39 digits, and those of others don't fit."""
    sign = F.col("l_orderkey") % 2 * 2 - 1
    rows = _lines(s, d).select("l_orderkey", wide.product(F.col("price") * 80_000 * sign, F.col("quantity") * 100_000_000).alias("p"))
    total = rows.groupBy("l_orderkey").agg(wide.total("p").alias("t"))
    return total.select("l_orderkey", wide.raw_text("t").alias("raw"))


def _wide_averages(s, d):
    """Exact averages of signed products, their difference from an amount, and the sums narrowed once."""
    rows = _lines(s, d).select((F.col("l_partkey") % 50).alias("g"), wide.product(F.col("price") * F.col("sign"), F.col("discount") + 123_456_789).alias("p"))
    total = rows.groupBy("g").agg(wide.total("p").alias("t"), F.count("*").alias("n"))
    one = wide.from_fixed(F.lit(1_500_000_001).cast("long"))
    return total.select(
        "g", wide.raw_text(wide.div_int("t", "n", "HALF_EVEN")).alias("average"), wide.raw_text(wide.add(F.col("t"), one, -1)).alias("less"),
        wide.to_fixed("t", "HALF_UP").alias("narrowed"),
    )


def _gauge(s, d):
    """Orders under way from their date to their last line's, by mode of 28 days."""
    days = lambda c: F.date_diff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    ends = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(days(F.max("l_shipdate")).alias("shipped"))
    rows = table(s, d, "orders").select("o_orderkey", "o_orderstatus", days("o_orderdate").alias("ordered")).join(ends, "o_orderkey", "left")
    return metrics.in_flight(rows, ["o_orderstatus"], "ordered", "shipped", 28)


def _precisions(s, d):
    """Bits for an error of one key in each event type's number of users, and the error that they give."""
    n = table(s, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))
    bits = sketches.precision_of(F.lit(1.0) / F.col("n"))
    return n.select("event_type", bits.alias("bits"), F.round(sketches.standard_error(bits), 9).alias("error"))


def _kept(s, d):
    e = table(s, d, "events").select("event_type", "event_id", "value")
    return metrics.retained_exemplars(e, ["event_type"], "value", "event_id", 5, 1 << 10).groupBy("event_type").agg(F.count("*").alias("exemplars_kept_total"))


QUERIES = {
    "counting_sticky": _sticky,
    "cuckoo_chain": _chain,
    "cuckoo_chain_members": _chain_members,
    "cuckoo_union_rates": _union_rates,
    "hll_fold": _fold,
    "hll_sparse": _sparse,
    "hll_sparse_merge": _sparse_merge,
    "wide_sums": _wide_sums,
    "wide_averages": _wide_averages,
    "in_flight": _gauge,
    "precisions": _precisions,
    "exemplars_kept": _kept,
}

#: Call by call of a cell: a full one stays.
_STICKY = f"""WITH RECURSIVE h AS (SELECT event_id, event_type = 'error' AS gone, {_md5("'11'", 'user_id')} % {_CELLS} AS a, {_md5("'13'", 'user_id')} % {_CELLS} AS b FROM events),
c AS MATERIALIZED (SELECT (a + b * i + i * i) % {_CELLS} AS cell, gone, row_number() OVER (PARTITION BY (a + b * i + i * i) % {_CELLS} ORDER BY event_id, i) AS n FROM h, range(2) t(i)),
s AS (
  SELECT cell, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS c FROM (SELECT DISTINCT cell FROM c)
  UNION ALL
  SELECT c.cell, c.n, CASE WHEN s.c = 15 THEN 15 WHEN gone THEN greatest(s.c - 1, 0) ELSE s.c + 1 END FROM s JOIN c ON c.cell = s.cell AND c.n = s.n + 1)
SELECT cell, arg_max(c, n) AS c FROM s GROUP BY cell HAVING arg_max(c, n) > 0"""
_ENDS = [sum(sketches.chain_capacities(_FIRST)[: i + 1]) for i in range(30)]
_ARRIVED = f"""f AS (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey), o_custkey) - 1 AS n FROM orders GROUP BY o_custkey),
l AS (SELECT o_custkey, CAST(len(list_filter({_ENDS}, lambda e: e <= n)) AS INT) AS layer FROM f)"""


def _registers(groups: str, rows: str, key: str, p: int) -> str:
    """Registers of so many bits: the place of the first set bit behind them."""
    rest = f"(h % {1 << 60 - p})"
    return f"SELECT {groups}, register, max(rho) AS rho FROM (SELECT {groups}, CAST(h // {1 << 60 - p} AS INT) AS register, CAST(CASE WHEN {rest} = 0 THEN {61 - p} ELSE {61 - p} - length(ltrim(bin({rest}), '0')) END AS INT) AS rho FROM (SELECT {groups}, {_md5(repr('1'), key)} AS h FROM {rows})) GROUP BY ALL"


def _sparse_sql(rows: str, dense: str, g: str) -> str:
    """Entries of groups that aren't dense, and registers of those that are; `dense` tells (g, dense) from c and fine."""
    return f"""WITH c AS ({rows}), fine AS ({_registers("g", "c", "k", _FINE)}), coarse AS ({_registers("g", "c", "k", _P)}), w AS ({dense})
SELECT g AS {g}, false AS dense, register, rho FROM fine JOIN w USING (g) WHERE NOT dense UNION ALL SELECT g, true, register, rho FROM coarse JOIN w USING (g) WHERE dense"""


_FEW = (1 << _P) // 4
#: A side that is dense by itself makes the merged group dense.
_MERGED = f"""SELECT g, max(n) > {_FEW} OR max(part) > {_FEW} AS dense FROM (SELECT g, count(*) AS n FROM fine GROUP BY g) JOIN (
  SELECT g, count(DISTINCT h // {1 << 60 - _FINE}) AS part FROM (SELECT g, side, {_md5(repr('1'), 'k')} AS h FROM sides) GROUP BY g, side) USING (g) GROUP BY g"""
_BASE = "1000000000000000000::HUGEINT"
_GAUGE = """WITH e AS (SELECT l_orderkey, max(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS shipped FROM lineitem GROUP BY 1),
o AS (SELECT o_orderstatus, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS ordered, shipped FROM orders LEFT JOIN e ON l_orderkey = o_orderkey),
m AS (SELECT o_orderstatus, ordered AS t, 1 AS n FROM o UNION ALL SELECT o_orderstatus, shipped, -1 FROM o WHERE shipped IS NOT NULL),
x AS (SELECT o_orderstatus, t, sum(n) AS n FROM m GROUP BY ALL),
r AS (SELECT o_orderstatus, t, n, sum(n) OVER (PARTITION BY o_orderstatus ORDER BY t) AS now FROM x)
SELECT o_orderstatus, (t // 28) * 28 AS at, CAST(max(greatest(now, now - n)) FILTER (WHERE true) AS BIGINT) AS most, CAST(arg_max(now, t) AS BIGINT) AS "left" FROM r GROUP BY ALL"""

SQL = {
    "counting_sticky": _STICKY,
    "cuckoo_chain": f"WITH {_ARRIVED} SELECT layer, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY layer UNION ALL SELECT -1, count(*) FILTER (WHERE o_custkey % 3 <> 0) FROM l",
    "cuckoo_chain_members": f"WITH {_ARRIVED} SELECT o_custkey, true AS maybe, layer, true AS placed FROM l",
    "cuckoo_union_rates": (
        "WITH k AS (SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey % 2 FROM orders)) SELECT n AS keys, round(n / 65536.0::DOUBLE, 6) AS "
        "load, round(8 * (n / 65536.0::DOUBLE) / 4095.0::DOUBLE, 9) AS fpp FROM k"
    ),
    "hll_fold": _registers("event_type", "events", "user_id", _P),
    "hll_sparse": _sparse_sql("SELECT c_nationkey AS g, c_custkey AS k FROM customer", f"SELECT g, count(*) > {(1 << _P) // 4} AS dense FROM fine GROUP BY g", "c_nationkey"),
    "hll_sparse_merge": "WITH sides AS (SELECT c_nationkey % 5 AS g, c_custkey AS k, 2 AS side FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_nationkey % 5, c_custkey, 3 FROM customer WHERE c_custkey % 3 = 0), "
    + _sparse_sql("SELECT DISTINCT g, k FROM sides", _MERGED, "g").removeprefix("WITH "),
    "wide_sums": f"""WITH {_L}, p AS (SELECT l_orderkey, CAST(price * 80000 AS HUGEINT) * (quantity * 100000000) AS p FROM l),
t AS (SELECT l_orderkey, sum(p // {_BASE}) AS hi, sum(p % {_BASE}) AS lo FROM p GROUP BY 1),
c AS (SELECT l_orderkey, CAST(hi + lo // {_BASE} AS HUGEINT) AS hi, CAST(lo % {_BASE} AS HUGEINT) AS lo FROM t)
SELECT l_orderkey, CASE WHEN hi < 170141183460469231731::HUGEINT OR (hi = 170141183460469231731::HUGEINT AND lo <= 687303715884105727 + (1 - l_orderkey % 2))
  THEN CASE WHEN l_orderkey % 2 = 0 THEN '-' ELSE '' END || CASE WHEN hi > 0 THEN hi || lpad(CAST(lo AS VARCHAR), 18, '0') ELSE CAST(lo AS VARCHAR) END END AS raw FROM c""",
    "wide_averages": f"""WITH {_L}, t AS (SELECT l_partkey % 50 AS g, CAST(sum(CAST(price * sign AS HUGEINT) * (discount + 123456789)) AS HUGEINT) AS t, count(*) AS n FROM l GROUP BY 1)
SELECT g, {_round_sql('t', 'n', 'HALF_EVEN').removesuffix(' AS BIGINT)')} AS VARCHAR) AS average, CAST(t - 1500000001000000000::HUGEINT AS VARCHAR) AS less, {_round_sql('t', '1000000000', 'HALF_UP')} AS narrowed FROM t""",
    "in_flight": _GAUGE,
    "precisions": (
        "WITH n AS (SELECT event_type, least(18, greatest(4, CAST(ceil(log2(pow(1.04::DOUBLE / (1.0::DOUBLE / count(DISTINCT user_id)), 2))) AS INT))) AS "
        "bits FROM events GROUP BY 1) SELECT event_type, bits, round(1.04::DOUBLE / sqrt(pow(2.0::DOUBLE, bits)), 9) AS error FROM n"
    ),
    "exemplars_kept": (
        "SELECT event_type, count(*) AS exemplars_kept_total FROM events a WHERE (SELECT count(*) FROM events b WHERE b.event_type = a.event_type AND b.event_id "
        "< a.event_id AND b.value >= a.value) < 5 GROUP BY 1"
    ),
}
