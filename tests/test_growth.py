"""Sketches that grow or hold on, wide numbers, gauges."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lagoon.functions import wide
from lagoon.operators import metrics, sketches
from tests.compare import rows


@pytest.mark.parametrize("stretch", [3, 1 << 12])
def test_full_cells_stay_full(spark, stretch, monkeypatch):
    monkeypatch.setattr(sketches, "STRETCH", stretch)
    r = random.Random(4)
    calls = [(i, r.randrange(40), r.random() < 0.45) for i in range(900)]
    df = spark.createDataFrame(calls, "at long, k long, gone boolean")
    cells = {x["k"]: x["b"] for x in df.select("k", sketches._bits("k", 16, 3).alias("b")).distinct().collect()}
    want = defaultdict(int)
    for _, k, gone in calls:
        for c in cells[k]:
            want[c] = want[c] if want[c] == 15 else max(want[c] - 1, 0) if gone else want[c] + 1
    got = {x["cell"]: x["c"] for x in sketches.counting_calls(df, "k", "at", F.col("gone"), 16, 3).collect()}
    assert got == {c: n for c, n in want.items() if n} and 15 in got.values()


def test_a_full_cell_is_not_taken_from(spark):
    """Twenty keys come and go; what was full can't be told empty again."""
    df = spark.createDataFrame([(i, 1, i >= 20) for i in range(40)], "at long, k long, gone boolean")
    assert {x["c"] for x in sketches.counting_calls(df, "k", "at", F.col("gone"), 64, 3).collect()} == {15}
    assert sketches.counting_calls(df.where("at < 10 OR at >= 30"), "k", "at", F.col("gone"), 64, 3).count() == 0


EDGES = [0, 1, -1, 10**18, -(10**18), 10**38, -(10**38), wide.MOST, wide.LEAST, 999_999_999_999_999_999, -1_500_000_000, 2_500_000_000, 5 * 10**26]


def _wide(spark, values):
    rows_ = [(i, str(v // wide.BASE), v % wide.BASE) for i, v in enumerate(values)]
    return spark.createDataFrame(rows_, "i long, hi string, lo long").select("i", F.struct(F.col("hi").cast("decimal(21,0)").alias("hi"), "lo").alias("x"))


def _fits(v):
    return v if wide.LEAST <= v <= wide.MOST else None


def test_wide_sums_at_the_edges(spark):
    df = _wide(spark, EDGES)
    pairs = df.alias("a").crossJoin(df.alias("b"))
    got = pairs.select("a.i", "b.i", wide.raw_text(wide.add("a.x", "b.x")), wide.raw_text(wide.add(F.col("a.x"), F.col("b.x"), -1))).collect()
    for i, j, plus, minus in got:
        as_text = lambda v: None if _fits(v) is None else str(v)
        assert (plus, minus) == (as_text(EDGES[i] + EDGES[j]), as_text(EDGES[i] - EDGES[j]))


def _rounded(n, d, mode):
    q, r = divmod(abs(n), abs(d))
    negative = (n < 0) != (d < 0)
    away = {"DOWN": False, "UP": r > 0, "FLOOR": negative and r > 0, "CEILING": not negative and r > 0, "HALF_UP": 2 * r >= abs(d), "HALF_DOWN": 2 * r > abs(d), "HALF_EVEN": 2 * r > abs(d) or (2 * r == abs(d) and q % 2 == 1)}[mode]
    return (-1 if negative else 1) * (q + away)


@pytest.mark.parametrize("mode", ["DOWN", "UP", "FLOOR", "CEILING", "HALF_UP", "HALF_DOWN", "HALF_EVEN"])
def test_wide_rounding(spark, mode):
    r = random.Random(6)
    values = [*EDGES, *(r.randint(-(10 ** r.randint(1, 38)), 10 ** r.randint(1, 38)) for _ in range(60))]
    divisors = (3, -7, 2, 2**63 - 1, 0)
    parts = [wide.raw_text(wide.div_int("x", F.lit(n).cast("long"), mode)).alias(f"by{k}") for k, n in enumerate(divisors)]
    for i, narrow, *shares in _wide(spark, values).select("i", wide.to_fixed("x", mode).alias("narrow"), *parts).collect():
        want = _rounded(values[i], 10**9, mode)
        assert narrow == (want if -(2**63) <= want < 2**63 else None)
        assert shares == [None if n == 0 else str(_rounded(values[i], n, mode)) for n in divisors]


def test_wide_text_and_products(spark):
    df = spark.createDataFrame([(2**63 - 1, 2**63 - 1), (-(2**63), 2**63 - 1), (1_500_000_000, -2), (0, 5), (None, 1)], "a long, b long")
    got = [tuple(r) for r in df.select(wide.raw_text(wide.product("a", "b")), wide.text(wide.product("a", "b")), wide.text(wide.from_fixed("a"))).collect()]
    assert [g[0] for g in got] == [str((2**63 - 1) ** 2), str(-(2**63) * (2**63 - 1)), "-3000000000", "0", None]
    assert [g[1] for g in got][2:4] == ["-0.000000003", "0"] and [g[2] for g in got][:4] == ["9223372036.854775807", "-9223372036.854775808", "1.5", "0"]


def test_wide_total_overflows_to_null(spark):
    df = _wide(spark, [wide.MOST, 1, -1])
    assert df.agg(wide.raw_text(wide.total("x"))).first()[0] == str(wide.MOST)
    assert df.where("i < 2").agg(wide.raw_text(wide.total("x"))).first()[0] is None


@pytest.mark.parametrize(("finer", "p"), [(14, 14), (14, 4), (20, 10)])
def test_folded_registers_equal_coarse_ones(spark, finer, p):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id")
    assert rows(sketches.hll_fold(sketches.hll_registers(df, ["g"], "id", finer), finer, p)) == rows(sketches.hll_registers(df, ["g"], "id", p))


def test_sparse_sketches_promote_and_merge(spark):
    df = spark.range(200).select(F.when(F.col("id") < 190, 1).otherwise(2).alias("g"), "id")
    made = sketches.hll_sparse(df, ["g"], "id", 8)
    assert {(r["g"], r["dense"]) for r in made.select("g", "dense").distinct().collect()} == {(1, True), (2, False)}
    parts = [sketches.hll_sparse(df.where(c), ["g"], "id", 8) for c in ("id % 2 = 0", "id % 2 = 1")]
    assert rows(sketches.hll_merge_sparse(*parts, 8)) == rows(made)


def test_chain_grows_by_doubling(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 500).alias("k"), "id")
    made = sketches.cuckoo_chain(df, "k", "id", 100, 64)
    assert {r["layer"]: r["n"] for r in made.groupBy("layer").agg(F.sum("n").alias("n")).collect()} == {0: 95, 1: 190, 2: 215}
    assert sketches.chain_contains(made, df, "k", 64).where("NOT maybe").count() == 0
    gone = df.where("k < 100").select("k")
    left = sketches.chain_delete(made, gone, "k", 64)
    assert left.agg(F.sum("n")).first()[0] == 400 and sketches.chain_contains(left, df.where("k >= 100"), "k", 64).where("NOT maybe").count() == 0


def test_in_flight(spark):
    r = random.Random(8)
    spans = [(s, s + r.randrange(0, 30) if r.random() < 0.9 else None) for s in (r.randrange(0, 200) for _ in range(150))]
    got = metrics.in_flight(spark.createDataFrame(spans, "s long, e long").withColumn("g", F.lit(1)), ["g"], "s", "e", 20).collect()
    under = lambda t: sum(s <= t and (e is None or t < e) for s, e in spans)
    moved = Counter((t // 20) * 20 for s, e in spans for t in ([s] if e is None else [s, e] if s != e else []))
    for x in got:
        if x["at"] in moved:
            assert x["most"] == max(under(x["at"] - 1), *(under(t) for t in range(x["at"], x["at"] + 20))) and x["left"] == under(x["at"] + 19)


@pytest.mark.parametrize("every", [1, 37, 10_000])
def test_retained_exemplars(spark, every):
    r = random.Random(3)
    rows_ = [(r.choice(["a", None]), i, r.choice([None, *range(30)])) for i in range(600)]
    want = {i for g, i, x in rows_ if x is not None and sum(y is not None and y >= x for h, j, y in rows_ if h == g and j < i) < 4}
    df = spark.createDataFrame(rows_, "g string, i long, x long")
    assert {x["i"] for x in metrics.retained_exemplars(df, ["g"], "x", "i", 4, every).collect()} == want
