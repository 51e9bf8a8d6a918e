"""Fixed-point products at the ends of 64 bits, and their modes in one pass."""

from __future__ import annotations

import random

import pytest

from lagoon.functions import numeric as nx
from lagoon.plans import value_queries


@pytest.mark.parametrize("op", ["mul", "div"])
def test_products_and_quotients_of_all_sizes(spark, op):
    r = random.Random(6)
    odd = [0, 1, -1, 5, -5, 499_999_999, 500_000_000, -500_000_000, nx.ONE, -nx.ONE, 3 * nx.ONE // 2, nx.RAW_MIN, nx.RAW_MAX, nx.RAW_MIN + 1, 2**62, -(2**62)]
    pairs = [(a, b) for a in odd for b in odd] + [(r.randrange(-(2**r.randint(1, 63)), 2**r.randint(1, 63)), r.randrange(-(2**r.randint(1, 63)), 2**r.randint(1, 63))) for _ in range(500)] + [(None, 5), (5, None)]
    # quotients next to the ends of the range
    pairs += [(nx.RAW_MIN, nx.ONE), (nx.RAW_MAX, nx.ONE), (nx.RAW_MAX, nx.ONE + 1), (nx.RAW_MIN // 2, 2 * nx.ONE), (3, 3_074_457_345_618_258_602)]

    def plain(a, b, mode):
        if a is None or b is None or (op == "div" and b == 0):
            return None
        n, d = (a * b, nx.ONE) if op == "mul" else (a * nx.ONE, b)
        q, rest, sign = abs(n) // abs(d), abs(n) % abs(d), -1 if (n < 0) != (d < 0) else 1
        up = {"DOWN": False, "UP": rest > 0, "FLOOR": sign < 0 < rest, "CEILING": sign > 0 and rest > 0, "HALF_UP": 2 * rest >= abs(d), "HALF_DOWN": 2 * rest > abs(d)}
        v = sign * (q + up.get(mode, 2 * rest > abs(d) or (2 * rest == abs(d) and q % 2 == 1)))
        return v if nx.RAW_MIN <= v <= nx.RAW_MAX else None

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a long, b long").repartition(2)
    got = df.select("i", *((nx.fx_mul if op == "mul" else nx.fx_div)("a", "b", m).alias(m) for m in nx.MODES)).collect()
    assert len(got) == len(pairs)
    for x in got:
        assert [x[m] for m in nx.MODES] == [plain(*pairs[x["i"]], m) for m in nx.MODES], pairs[x["i"]]


def test_modes_read_their_rows_once(spark):
    plan = lambda name: value_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    for name in ("fx_mul_modes", "fx_div_modes"):
        assert plan(name).count("parquet") == 1, name
