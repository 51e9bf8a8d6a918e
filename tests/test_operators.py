"""Literal cases of the operators."""

import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from lagoon.functions import numeric as nx
from lagoon.functions import text as tx
from lagoon.operators import caches, calendar, eventlog, hdr, limits, lookup, metrics, ranks, sketches, stats, versions
from lagoon.sources import segments
from lagoon.streaming import streams
from tests.compare import rows


def ints(spark, values):
    return spark.createDataFrame([("a", i, int(v)) for i, v in enumerate(values)], "g string, seq long, x long")


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize("q", [0.0, 0.29, 0.5, 0.99, 0.999, 1.0])
def test_picks_follow_the_floor_rule(spark, q):
    r = random.Random(3)
    values = [r.randint(-500, 5000) for _ in range(997)]
    got = one(ranks.picks(ints(spark, values), ["g"], "x", {"v": q}))
    assert got["v"] == sorted(values)[min(len(values) - 1, int(q * len(values)))] and got["n"] == 997


def test_picks_of_0_to_99(spark):
    assert one(stats.facade(ints(spark, range(100)), ["g"], "x")) == {"g": "a", "p50": 50, "p90": 90, "p99": 99, "p999": 99, "max": 99, "n": 100}


def test_offsets_are_dense(spark):
    r = random.Random(1)
    values = [r.randint(0, 1000) for _ in range(500)]
    got = ranks.offsets(ints(spark, values), ["x", "seq"], F.floor(F.col("x") / 100)).orderBy("offset").collect()
    assert [x["offset"] for x in got] == list(range(500)) and [x["x"] for x in got] == sorted(values)


def test_small_sample_moments(spark):
    got = one(stats.moments(ints(spark, [100, 200, 300, 400]), ["g"], "x"))
    assert got["mean"] == 250 and 125 <= got["stddev"] <= 135
    assert one(stats.moments(ints(spark, [5]), ["g"], "x"))["stddev"] == 0


def test_ks(spark):
    side = lambda a, b: spark.createDataFrame([(True, x) for x in a] + [(False, x) for x in b], "side boolean, x long")
    assert one(stats.ks_distance(side(range(1000), range(500, 1500)), "side", "x"))["ks"] == 0.5
    assert one(stats.ks_distance(side([1, 1, 1], [1, 1, 1]), "side", "x"))["ks"] == 0
    assert one(stats.cohens_d(side(range(100, 200), range(200, 300)), "side", "x"))["d"] > 0.5
    assert one(stats.cohens_d(side([1], [2]), "side", "x"))["d"] is None


def test_hill_and_tail(spark):
    values = [100] * 990 + [10_000] * 10
    assert one(stats.tail_fatness(ints(spark, values), ["g"], "x"))["fatness"] > 1
    got = one(stats.hill(ints(spark, [1, 2, 4, 8]), ["g"], "x", 2))["hill"]
    assert math.isclose(got, (math.log(8 / 2) + math.log(4 / 2)) / 2, abs_tol=1e-6)
    assert one(stats.tail_expectation(ints(spark, [7] * 10), ["g"], "x", 0.5))["cte"] == 7


def test_jitter_needs_two_windows(spark):
    at = F.floor(F.col("seq") / 16)
    assert one(stats.jitter(ints(spark, range(63)), ["g"], "x", "seq", at))["jitter"] == 0
    assert one(stats.jitter(ints(spark, [10] * 64), ["g"], "x", "seq", at))["jitter"] == 0


@pytest.mark.parametrize("bits", [3, 5, 11])
def test_hdr_buckets_hold_their_values(spark, bits):
    values = [0, 1, 2, 7, 8, 31, 32, 33, 1000, 2047, 2048, 2049, 10**6, 2**40 + 12345]
    got = ints(spark, values).select("x", nx.hdr_lower(nx.hdr_bucket("x", bits), bits).alias("low")).collect()
    assert all(r["low"] <= r["x"] < r["low"] + max(1, r["x"] >> (bits - 1)) for r in got)
    order = [r["b"] for r in ints(spark, range(-300, 300)).select("x", nx.ordered_bucket("x", 3).alias("b")).orderBy("x").collect()]
    assert order == sorted(order)


def test_hdr_small_values_are_exact(spark):
    h = hdr.record(ints(spark, [10, 20, 30, 40, 50]), ["g"], "x", 11)
    assert one(hdr.quantiles(h, ["g"], 11, {"p50": 0.5, "max": 1.0})) == {"g": "a", "n": 5, "p50": 20, "max": 50}
    steps = hdr.percentile_steps(hdr.record(ints(spark, range(1, 101)), ["g"], "x", 11), ["g"], 11, 10)
    assert [r["value"] for r in steps.orderBy("pct").collect()] == list(range(10, 101, 10))


def test_backfill(spark):
    got = hdr.backfill(ints(spark, [350, 90]).select("x"), "x", 100)
    assert sorted(r["x"] for r in got.collect()) == [90, 150, 250, 350]


def test_dedup_keeps_the_latest_source_and_its_first(spark):
    df = spark.createDataFrame([(0, 0, "a", "a0"), (0, 1, "b", "b0"), (0, 2, "c", "c0"), (1, 0, "b", "b1"), (1, 1, "b", "b1x"), (1, 2, "d", "d1")], "source int, pos long, key string, v string")
    assert {r["key"]: r["v"] for r in versions.by_source(df, ["key"], "source", "pos").collect()} == {"a": "a0", "b": "b1", "c": "c0", "d": "d1"}
    ranked = df.withColumn("priority", F.lit(100) - F.col("source") * 50)
    assert {r["key"]: r["v"] for r in versions.by_priority(ranked, ["key"], "priority", "source", "pos").collect()}["b"] == "b0"


def test_tombstones_shadow(spark):
    df = spark.createDataFrame([("k", 1, "old", False), ("k", 2, None, True), ("m", 1, "x", False)], "key string, seq long, v string, gone boolean")
    assert [r["key"] for r in versions.live(df, ["key"], "seq", "gone").collect()] == ["m"]
    assert {r["key"] for r in versions.as_of(df, ["key"], "seq", "gone", 1).collect()} == {"k", "m"}


@pytest.mark.parametrize("mode", lookup.MODES)
def test_nearest(spark, mode):
    r = random.Random(5)
    keys, probes = [r.randint(0, 400) for _ in range(30)], [r.randint(-20, 420) for _ in range(200)]
    k = spark.createDataFrame([(x,) for x in keys], "x long")
    p = spark.createDataFrame(list(enumerate(probes)), "id long, x long")
    fit = {"floor": lambda k, p: k <= p, "ceiling": lambda k, p: k >= p, "predecessor": lambda k, p: k < p, "successor": lambda k, p: k > p}[mode]
    pick = max if mode in ("floor", "predecessor") else min
    got = {x["id"]: x["found"] for x in lookup.nearest(p, k, "x", mode).collect()}
    assert got == {i: pick([k for k in keys if fit(k, x)], default=None) for i, x in enumerate(probes)}


def test_rounding_modes(spark):
    df = spark.createDataFrame([(25, 10), (-25, 10), (35, 10), (-35, 10)], "n long, d long")
    want = {"HALF_EVEN": [2, -2, 4, -4], "HALF_UP": [3, -3, 4, -4], "HALF_DOWN": [2, -2, 3, -3], "DOWN": [2, -2, 3, -3], "UP": [3, -3, 4, -4], "FLOOR": [2, -3, 3, -4], "CEILING": [3, -2, 4, -3]}
    for mode, values in want.items():
        assert [int(r["v"]) for r in df.select(nx.div_round("n", "d", mode).alias("v")).collect()] == values
    assert one(df.select(nx.div_round("n", F.lit(0), "UP").alias("v")))["v"] is None


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(2**63 - 1, 2**63 - 1), (3 * 10**18, 10**9)], "a long, b long")
    assert [r["v"] for r in df.select(nx.fx_mul("a", "b", "DOWN").alias("v")).collect()] == [None, 3 * 10**18]


def test_decimal_text(spark):
    good = {".5": 500_000_000, "5.": 5 * 10**9, "+7": 7 * 10**9, "-0": 0, "0.000000001": 1, "-1.25": -1_250_000_000}
    bad = ["1e3", " 1", "1,000", "1.2.3", ".", "", "1.0000000001", "99999999999999"]
    df = spark.createDataFrame([(s,) for s in [*good, *bad]], "s string")
    assert {r["s"]: r["v"] for r in df.select("s", nx.parse_fixed("s").alias("v")).collect()} == {**good, **dict.fromkeys(bad)}
    shown = spark.createDataFrame([(-1_250_000_000,), (7 * 10**9,), (1,), (-(2**63),)], "r long").select(nx.format_fixed("r").alias("s"), nx.format_places("r", 2).alias("t")).collect()
    assert [(r["s"], r["t"]) for r in shown] == [("-1.25", "-1.25"), ("7", "7.00"), ("0.000000001", "0.00"), ("-9223372036.854775808", "-9223372036.85")]


def test_money_settles_by_currency(spark):
    df = spark.createDataFrame([(10_125_000_000, "USD"), (1_234_500_000_000, "JPY"), (1_000_500_000, "KWD")], "raw long, c string")
    assert [r["v"] for r in df.select(nx.settle("raw", "c", "HALF_EVEN").alias("v")).collect()] == [10_120_000_000, 1_234_000_000_000, 1_000_000_000]
    assert [r["v"] for r in df.select(nx.settle("raw", "c", "HALF_UP").alias("v")).collect()] == [10_130_000_000, 1_235_000_000_000, 1_001_000_000]


def test_gcra(spark):
    calls = [(i, 0, "acct-a", 1) for i in range(4)] + [(4, 0, "acct-b", 1), (5, 1_000_000, "acct-a", 1), (6, 1_000_000, "acct-a", 5), (7, 1_000_000, "acct-a", 0)]
    df = spark.createDataFrame(calls, "pos long, now long, key string, n long")
    got = {r["pos"]: (r["granted"], r["retry_at"]) for r in limits.gcra(df, ["key"], "now", "pos", 1_000_000, 3, "n").collect()}
    assert [got[i][0] for i in range(8)] == [True, True, True, False, True, True, False, True]
    assert got[3][1] == 1_000_000 and got[6][1] is None


def test_token_bucket_and_parents(spark):
    df = spark.createDataFrame([(i, t, "p", "c") for i, t in enumerate([0, 0, 0, 10**9, 10**9])], "pos long, now long, parent string, child string")
    assert [r["granted"] for r in limits.token_bucket(df, ["child"], "now", "pos", 2, 1).orderBy("pos").collect()] == [True, True, False, True, False]
    got = limits.hierarchical(df, "parent", "child", "now", "pos", (1, 1), (5, 5)).orderBy("pos").collect()
    assert [r["granted"] for r in got] == [True, False, False, True, False]


@pytest.mark.parametrize(("policy", "kept"), [("drop_newest", [1, 2, 3]), ("drop_oldest", [1, 3, 4])])
def test_bounded_queue(spark, policy, kept):
    df = spark.createDataFrame([("t", i) for i in range(1, 5)], "t string, pos long")
    assert sorted(r["pos"] for r in limits.bounded_queue(df, ["t"], "pos", 2, policy).where("delivered").collect()) == kept


def test_sagas(spark):
    df = spark.createDataFrame([("x", 1, "a", True, True), ("x", 2, "b", True, True), ("y", 1, "a", True, True), ("y", 2, "b", True, False), ("y", 3, "c", False, True), ("y", 4, "d", True, True)], "saga string, pos long, step string, f boolean, c boolean")
    got = {r["saga"]: r for r in eventlog.saga_reports(df, "saga", "pos", "step", "f", "c").collect()}
    assert got["x"]["outcome"] == "COMMITTED" and got["x"]["forward_ran"] == ["a", "b"]
    assert (got["y"]["outcome"], got["y"]["failed_step"], got["y"]["forward_ran"], got["y"]["compensated"], got["y"]["failures"]) == ("COMPENSATION_FAILED", "c", ["a", "b"], ["a"], ["b"])


def test_health(spark):
    df = spark.createDataFrame([("db", "UP", True), ("cache", "DOWN", False)], "name string, status string, critical boolean")
    got = one(eventlog.health_view(df, [], "status", "critical").withColumn("code", eventlog.http_code(F.col("status"))))
    assert got == {"status": "WARN", "code": 200}
    assert one(eventlog.worst(df, [], "status"))["status"] == "DOWN"


def test_event_json_omits_what_is_absent(spark):
    df = spark.sql("SELECT map('to', 'DOWN', 'from', 'U\"P') AS m, map() AS none")
    json = eventlog.event_json(F.lit("svc.status"), F.lit("ERROR"), F.lit("t"), F.lit(None).cast("string"), F.col("m"))
    assert one(df.select(json.alias("j")))["j"] == '{"topic":"svc.status","level":"ERROR","at":"t","attributes":{"from":"U\\"P","to":"DOWN"}}'


def test_cron(spark):
    assert calendar.Cron.parse("*/15 * * * *").minute == (0, 15, 30, 45)
    assert calendar.Cron.parse("0,30 1-3 * * *").hour == (1, 2, 3)
    for bad in ("* * * *", "60 * * * *", "5-1 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            calendar.Cron.parse(bad)
    day = 86_400
    df = spark.createDataFrame([(0,), (59,), (7 * 3600,), (31 * day,)], "t long")
    got = [r["n"] for r in calendar.next_fire(df, "t", calendar.Cron.parse("30 6 * * *"), date(1970, 1, 1), date(1970, 3, 1), "n").orderBy("t").collect()]
    assert got == [23_400, 23_400, day + 23_400, 31 * day + 23_400]
    never = calendar.next_fire(df, "t", calendar.Cron.parse("0 0 31 2 *"), date(1970, 1, 1), date(1970, 3, 1), "n")
    assert {r["n"] for r in never.collect()} == {None}


def test_hll_error_and_union(spark):
    a, b = (spark.range(lo, hi).select(F.concat(F.lit("k"), "id").alias("k")) for lo, hi in ((0, 10_000), (5_000, 15_000)))
    ra, rb = (sketches.hll_registers(x, [], "k", 14) for x in (a, b))
    assert abs(one(sketches.hll_estimate(ra, [], 14))["estimate"] - 10_000) < 200
    assert abs(one(sketches.hll_estimate(sketches.hll_merge(ra, rb), [], 14))["estimate"] - 15_000) < 450
    assert sketches.precision_for(0.01) == 14


def test_cms_never_below(spark):
    df = spark.range(5000).select((F.col("id") % 97).alias("k"))
    est = {r["k"]: r["estimate"] for r in sketches.cms_estimate(sketches.cms(df, [], "k", 4, 256), df, "k", 4, 256).collect()}
    true = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    assert all(est[k] >= n for k, n in true.items())
    conservative = sketches.cms_conservative(df.withColumn("g", F.lit(1)).withColumn("o", F.col("k")), ["g"], "k", "o", 4, 256)
    cells = {(r["row"], r["idx"]): r["c"] for r in conservative.collect()}
    plain_cells = {(r["row"], r["idx"]): r["c"] for r in sketches.cms(df, [], "k", 4, 256).collect()}
    assert all(c <= plain_cells[k] for k, c in cells.items())


def test_bloom_and_cuckoo_have_no_false_negatives(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    bits, k = sketches.bloom_shape(2000)
    assert one(sketches.bloom_contains(sketches.bloom(df, [], "k", bits, k), df, "k", bits, k).agg(F.min("maybe").alias("m")))["m"]
    kept = sketches.cuckoo(df.withColumn("g", F.lit(0)), ["g"], "k", 1024).where("bucket >= 0").agg(F.sum("n").alias("n"))
    assert one(kept)["n"] == 2000


@pytest.mark.parametrize("block", [7, 1000])
def test_reuse_distances(spark, block):
    """As a plain list of the latest keys gives them, over many small blocks and in one."""
    r = random.Random(2)
    trace = [(r.randint(0, 1), r.choice([None, 3, *map(int, (r.expovariate(0.2) for _ in range(4)))]), 3 * i) for i in range(3000)]
    df = spark.createDataFrame(trace, "s int, k int, o long").repartition(3)
    want, latest = [], {0: [], 1: []}
    for s, k, _ in trace:
        keys = latest[s]
        found = keys.index(k) + 1 if k in keys[:10] else None
        if k in keys:
            keys.remove(k)
        keys.insert(0, k)
        want.append((s, k, found))
    got = caches.reuse_distances(df, F.col("s"), "k", "o", 10, 500, block).orderBy("shard", "position").collect()
    assert [tuple(x)[:2] + (x["distance"],) for x in got] == sorted(want, key=lambda x: x[0])
    hits = {(x["shard"], x["capacity"]): x["hits"] for x in caches.replay(df, F.col("s"), "k", "o", [1, 10], 500, block).collect()}
    assert hits == {(s, c): sum(x == s and (d or 99) <= c for x, _, d in want) for s in (0, 1) for c in (1, 10)}
    assert not caches.replay(df.where("false"), F.col("s"), "k", "o", [1], 500, block).collect()


def test_exposition(spark):
    line = metrics.exposition(F.lit("9p.x"), F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit('q"\n')), F.lit(3))
    assert one(spark.range(1).select(line.alias("l")))["l"] == '_9p_x{a="q\\"\\n",b="1"} 3'


def test_text(spark):
    assert tx.fnv1a64(b"foobar") == 0x85944171F73967E8
    df = spark.createDataFrame([("APP_TOKEN", "abc"), ("card", "12345678"), ("x", None)], "k string, v string")
    got = [r["v"] for r in df.select(tx.redact(F.col("k"), F.col("v"), {"card": "last4"}, {"token": "mask"}).alias("v")).collect()]
    assert got == ["***", "***5678", None]


@pytest.mark.parametrize("check", segments.CHECKS)
def test_segments_round_trip_and_damage(spark, tmp_path, check):
    payloads = [b"", b"one", bytes(range(256)), b"x" * 5000]
    raw = segments.encode(iter(payloads), check)
    (tmp_path / "a.seg").write_bytes(raw)
    (tmp_path / "b.seg").write_bytes(raw[:-1])
    (tmp_path / "c.seg").write_bytes(raw + b"\0\0")
    frames = segments.read(spark, str(tmp_path), check)
    got = {}
    for r in frames.orderBy("segment", "block").collect():
        got.setdefault(r["segment"], []).append(r["error"] or bytes(r["payload"]))
    assert got["a.seg"] == payloads and got["b.seg"] == [*payloads[:3], "truncated"] and got["c.seg"] == [*payloads, "truncated"]
    if check != "none":
        assert [e for *_, e in segments.decode(raw[:-1] + b"y", check)][-1] == "checksum"
    ends = [e for _, e, p, _ in segments.decode(raw, check)]
    marks = spark.createDataFrame([("a.seg", ends[1]), ("a.seg", ends[0])], "segment string, committed long")
    assert segments.committed(frames, marks).count() == 2 and segments.seek(frames.where("segment = 'a.seg'"), 3).count() == 1


def test_segment_sink(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").cast("binary").alias("p"), "id").repartition(3)
    segments.write(df, "p", ["id"], str(tmp_path / "out"), "crc32")
    back = segments.read(spark, str(tmp_path / "out"), "crc32")
    assert sorted(int(bytes(r["payload"])) for r in back.collect()) == list(range(100)) and back.where("error IS NOT NULL").count() == 0


def _files(spark, tmp_path, df, n=3):
    df.repartition(n).write.parquet(str(tmp_path / "in"))
    return streams.source(spark, str(tmp_path / "in"), df.schema)


def test_catch_up_equals_replay(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    stream = _files(spark, tmp_path, df)
    aggs = [F.count("*").alias("n"), F.sum("v").alias("total")]
    assert rows(streams.catch_up(stream, ["k"], aggs, str(tmp_path / "caught_up"))) == rows(df.groupBy("k").agg(*aggs))


def test_fan_out(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("v"))
    seen = {"all": 0, "even": 0}

    def sink(name):
        return lambda batch, _: seen.__setitem__(name, seen[name] + batch.count())

    streams.fan_out(_files(spark, tmp_path, df), [sink("all"), sink("even")], [None, F.col("v") % 2 == 0]).awaitTermination()
    assert seen == {"all": 40, "even": 20}


def test_streaming_transitions_and_admissions(spark, tmp_path):
    events = spark.sql("SELECT CAST(id % 2 AS BIGINT) AS scope, timestamp_seconds(id) AS ts, CASE WHEN id % 6 < 3 THEN 'UP' ELSE 'DOWN' END AS status FROM range(30)")
    q = streams.transitions(_files(spark, tmp_path, events, 1)).writeStream.format("memory").queryName("changes").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = eventlog.transitions(events, "scope", "ts", "status").select("scope", "ts", "before", "status")
    assert rows(spark.table("changes")) == rows(batch)
    calls = spark.sql("SELECT CAST(id % 2 AS BIGINT) AS key, id AS call, id * 300 AS now FROM range(40)")
    q = streams.admissions(_files(spark, tmp_path / "calls", calls, 1), 1000, 2).writeStream.format("memory").queryName("granted").trigger(availableNow=True).start()
    q.awaitTermination()
    want = limits.gcra(calls, ["key"], "now", "call", 1000, 2).select("key", "call", "granted")
    assert rows(spark.table("granted")) == rows(want)


def test_idle_keys_keep_no_state(spark, tmp_path):
    calls = [(k, 100 * b + k, (b + 1) * 60_000_000 + k * 1000) for b in range(6) for k in (range(40) if b in (0, 3) else range(2))]
    calls += [(k, 1000 + n, 240_000_000 + k * 1000 + n) for k in range(40) for n in range(4)]
    df = spark.createDataFrame(calls, "key long, call long, now long")
    for b in range(1, 7):
        part = df.where(F.col("now").between(b * 60_000_000, (b + 1) * 60_000_000 - 1)).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.source(spark, str(tmp_path / "in"), df.schema)
    q = streams.admissions(stream, 1_000_000, 2, "1 second").writeStream.format("memory").queryName("evicting").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("evicting")) == rows(limits.gcra(df, ["key"], "now", "call", 1_000_000, 2).select("key", "call", "granted"))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) >= 40 and held[-1] < 10


def test_sliding_windows_and_sessions(spark, tmp_path):
    df = spark.sql("SELECT timestamp_seconds(id * 60) AS ts, 'k' AS k FROM range(20)")
    stream = _files(spark, tmp_path, df, 1)
    q = streams.sliding_counts(stream, "ts", "k", "10 minutes", "5 minutes", "0 seconds").writeStream.outputMode("append").format("memory").queryName("slid").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("slid").count() >= 3
    q = streams.sessions(stream, "ts", "k", "5 minutes", "0 seconds").writeStream.outputMode("append").format("memory").queryName("sess").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sess").count() <= 1


def test_empty_tables(spark):
    none = ints(spark, []).where("x > 0")
    assert not rows(stats.facade(none, ["g"], "x")) and not rows(stats.moments(none, ["g"], "x")) and not rows(hdr.record(none, ["g"], "x", 5))
    assert not rows(ranks.offsets(none, ["x"], F.col("x")))


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_bootstrap_draws_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(stats, "_BLOCK", 100)
    monkeypatch.setattr(stats, "_CELLS", 16)
    r, groups = random.Random(8), {"a": 700, None: 33, "b": 1}
    values = {g: sorted(r.randint(-300, 9000) for _ in range(n)) for g, n in groups.items()}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, x long").repartition(3)
    want = {}
    for g, vs in values.items():
        state, found, n = 42, [], len(vs)
        for _ in range(20):
            at = []
            for _ in range(n):
                state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
                at.append(state % n)
            found.append(vs[sorted(at)[min(n - 1, int(0.9 * n))]])
        found.sort()
        side = (1 - 0.9) / 2
        want[g] = tuple(found[min(19, int(p * 20))] for p in (side, 1 - side))
    got = stats.bootstrap_ci(df, ["g"], "x", 0.9, 20, 0.9, 42)
    assert {r["g"]: (r["low"], r["high"]) for r in got.collect()} == want and "FlatMapGroups" not in _plan(got)


def test_hill_sorts_only_the_top(spark):
    r = random.Random(9)
    values = [r.randint(1, 10**6) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in values], "x long").selectExpr("'a' AS g", "x")
    top = sorted(values)[-51:]
    got = stats.hill(df, ["g"], "x", 50)
    assert math.isclose(one(got)["hill"], sum(math.log(x / top[0]) for x in top) / 50, abs_tol=1e-6) and "LeftSemi" in _plan(got)


def test_ordered_folds_hold_only_state(spark):
    r, key = random.Random(10), lambda i: ("a", None, "b")[i % 3]
    calls = [(key(i), f"u{r.randrange(9)}", r.randrange(4) * 10**9 + i * 10**7, i) for i in range(900)]
    df = spark.createDataFrame(calls, "g string, k string, now long, o long").repartition(5)
    tops, own, want = {}, {}, {}
    for g, k, now, o in sorted(calls, key=lambda c: (c[2], c[3])):
        both = [(tops.setdefault(g, [2.0e9, now]), 2, 1), (own.setdefault((g, k), [1.0e9, now]), 1, 1)]
        for s, size, rate in both:
            s[0], s[1] = min(size * 1.0e9, s[0] + (now - s[1]) * rate), now
        want[o] = all(s[0] >= 1.0e9 for s, _, _ in both)
        for s, _, _ in both:
            s[0] -= 1.0e9 * want[o]
    got = limits.hierarchical(df, "g", "k", "now", "o", (2, 1), (1, 1))
    assert {x["o"]: x["granted"] for x in got.collect()} == want and "FlatMapGroups" not in _plan(got)

    cell = {(x["k"], d): x[f"c{d}"] for x in df.select("k", *(F.pmod(F.xxhash64(F.lit(d), "k"), F.lit(4)).alias(f"c{d}") for d in range(2))).distinct().collect() for d in range(2)}
    cells = {}
    for g, k, _, _ in calls:
        mine = [(g, d, cell[k, d]) for d in range(2)]
        least = min(cells.get(c, 0) for c in mine) + 1
        cells |= {c: max(cells.get(c, 0), least) for c in mine}
    sketch = sketches.cms_conservative(df, ["g"], "k", "o", 2, 4)
    assert {(x["g"], x["row"], x["idx"]): x["c"] for x in sketch.collect()} == cells and "FlatMapGroups" not in _plan(sketch)


def test_sketches_of_other_shapes_do_not_merge(spark):
    a = sketches.cms(spark.range(9), [], "id", 2, 8)
    with pytest.raises(ValueError):
        sketches.cms_merge(a, a, (2, 8), (2, 16))
    with pytest.raises(ValueError):
        sketches.bloom_union(a, a, (64, 3), (128, 3))
    assert rows(sketches.cms_merge(a, a, (2, 8), (2, 8), "max")) == rows(a)


def test_cuckoo_filters_of_bounded_parts(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") != 7, F.col("id")).alias("k"))
    made = sketches.cuckoo(df, ["g"], "k", 64, 16)
    assert made.select("g", "part").distinct().count() == 2 * 14  # 3000 keys in parts of 230
    assert one(made.where("bucket >= 0").agg(F.sum("n").alias("n")))["n"] == 5999
    assert one(made.groupBy("g", "part", "bucket").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")))["n"] <= 4
    left = sketches.cuckoo_delete(made, df.where("k < 2000"), ["g"], "k", 64, 16)
    assert one(left.agg(F.sum("n").alias("n")))["n"] == 4000
    found = sketches.cuckoo_contains(left, df.where("k IS NOT NULL"), ["g"], "k", 64, 16)
    assert not found.where("k >= 2000 AND NOT maybe").count() and found.where("k < 2000 AND maybe").count() < 40
    assert all(0.5 < r["load"] <= 0.9 and r["fpp"] < 0.001 for r in sketches.cuckoo_rates(made, ["g"], 64, 16).collect())
    nothing = sketches.cuckoo(df.where("false"), ["g"], "k", 64)
    assert not nothing.count() and not sketches.cuckoo_contains(nothing, df, ["g"], "k", 64).count()


def test_cuckoo_union(spark):
    from pyspark.errors import PySparkException

    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"))
    odd, even = (sketches.cuckoo(df.where(f"k % 4 IN ({i}, {i + 1})"), ["g"], "k", 64, 16, parts=7) for i in (0, 2))
    both = sketches.cuckoo_union(odd, even, ["g"], 64).cache()
    assert one(both.agg(F.sum("n").alias("n")))["n"] == 3000
    assert one(both.where("bucket >= 0").groupBy("g", "part", "bucket").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")))["n"] <= 4
    assert not sketches.cuckoo_contains(both, df, ["g"], "k", 64, 16).where("NOT maybe").count()
    assert sketches.cuckoo_contains(both, df.withColumn("k", F.col("k") + 3000), ["g"], "k", 64, 16).where("maybe").count() < 30
    left = sketches.cuckoo_delete(both, df.where("k < 1000"), ["g"], "k", 64, 16)
    assert one(left.agg(F.sum("n").alias("n")))["n"] == 2000 and not sketches.cuckoo_contains(left, df.where("k >= 1000"), ["g"], "k", 64, 16).where("NOT maybe").count()
    with pytest.raises(PySparkException, match="don't unite"):
        sketches.cuckoo_union(odd, sketches.cuckoo(df, ["g"], "k", 64, 16, parts=8), ["g"], 64).collect()
    full = sketches.cuckoo_union(odd, odd, ["g"], 4).where("false")
    assert not sketches.cuckoo_union(full, full, [], 64).count()


def test_checked_ranges_fail(spark):
    from pyspark.errors import PySparkException

    low, high = spark.range(5), spark.range(4, 9)
    with pytest.raises(PySparkException, match="overlap"):
        lookup.disjoint_union(low, high, "id").collect()
    with pytest.raises(PySparkException, match="repeated key 4"):
        lookup.sorted_build(low.unionByName(high), "id").collect()
    assert lookup.disjoint_union(low, high.where("id > 4"), "id").count() == 9


def test_money_of_two_currencies_is_refused(spark):
    rows_ = spark.createDataFrame([(1, "USD", 2, "USD"), (1, "USD", 2, "JPY"), (2**63 - 1, "USD", 1, "USD")], "a long, x string, b long, y string")
    assert [r["t"] for r in rows_.select(nx.money_add("a", "x", "b", "y").alias("t")).collect()] == [3, None, None]


def test_segments_roll_over(spark, tmp_path):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("p")).coalesce(1)
    path = str(tmp_path / "out")
    assert segments.write(df, "p", ["id"], path, "crc32", file_bytes=200) == 100
    got = segments.read(spark, path, "crc32")
    assert rows(got.select(F.col("payload").cast("string").alias("p"))) == rows(df.select("p")) and got.select("segment").distinct().count() > 3
    assert segments.write(df.where("false"), "p", ["id"], str(tmp_path / "none")) == 0


def test_equal_times_of_a_status(spark):
    df = spark.createDataFrame([("s", 1, 1, "UP"), ("s", 1, 2, "DOWN"), ("s", 1, 3, "UP")], "scope string, ts long, tie long, status string")
    assert [(r["before"], r["status"]) for r in eventlog.transitions(df.orderBy(F.desc("tie")), "scope", "ts", "status", "tie").orderBy("tie").collect()] == [("UP", "DOWN"), ("DOWN", "UP")]


def _shares(df):
    return [r["n"] for r in df.groupBy("_part").agg(F.count("*").alias("n")).collect()]


def test_a_burst_is_spread(spark):
    """All events in one minute, most of them at one moment: gapless offsets, and no task with more than its share."""
    df = spark.range(20_000).select(F.when(F.col("id") % 4 == 0, F.col("id") % 60).otherwise(7).cast("timestamp").alias("ts"), F.hash("id").alias("tie"), "id")
    got = [(r["ts"], r["tie"], r["id"]) for r in eventlog.append_offsets(df, "ts", "tie").orderBy("offset").collect()]
    assert got == sorted(got) and len(set(got)) == 20_000
    assert [r["offset"] for r in eventlog.append_offsets(df, "ts", "tie").select("offset").orderBy("offset").collect()] == list(range(20_000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small enough for one task
    try:
        shares = _shares(ranks.ordered(df, ["ts", "tie"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) == 4 and max(shares) < 2 * 20_000 / 4


def test_positions_of_groups_one_of_which_is_hot(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 50 == 1, "b").otherwise("a").alias("g"), F.hash("id").alias("o"), "id")
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r["g"] or "", r["o"], r["id"])):
        want.setdefault(r["g"], []).append(r["id"])
    got = {}
    for r in ranks.positions(df, ["o", "id"], ["g"]).orderBy("offset").collect():
        assert r["offset"] == len(got.setdefault(r["g"], []))
        got[r["g"]].append(r["id"])
    assert got == want


@pytest.mark.parametrize("mode", lookup.MODES)
def test_lookups_in_one_dense_range(spark, mode):
    keys, probes = spark.range(0, 4000, 3).select(F.col("id").alias("x")), spark.range(5000).select((F.col("id") * 7 % 4100 - 50).alias("x"), F.col("id").alias("n"))
    known = list(range(0, 4000, 3))
    pick = {"floor": lambda v: [k for k in known if k <= v][-1:], "ceiling": lambda v: [k for k in known if k >= v][:1], "predecessor": lambda v: [k for k in known if k < v][-1:], "successor": lambda v: [k for k in known if k > v][:1]}[mode]
    answers = {v: (pick(v) or [None])[0] for v in range(-50, 4050)}
    got = lookup.nearest(probes, keys, "x", mode).collect()
    assert len(got) == 5000 and all(r["found"] == answers[r["x"]] for r in got)


def test_status_of_deep_and_of_mutual_nesting(spark):
    chain = [(k, k - 1 if k else None, "DOWN" if k == 39 else "UP") for k in range(40)]
    loop = [(100, 101, "UP"), (101, 100, "WARN"), (102, 101, "UP")]
    got = {r["node"]: r["status"] for r in eventlog.effective(spark.createDataFrame([*chain, *loop], "node long, parent long, status string"), "node", "parent", "status").collect()}
    assert got == {k: "DOWN" for k in range(40)} | {100: "WARN", 101: "WARN", 102: "UP"}


@pytest.mark.parametrize("batch", [7, 10_000])
def test_limits_over_batches(spark, batch):
    """Keys with null parts, calls of one key in several batches."""
    r = random.Random(5)
    calls = [(r.choice([1, None, 3]), r.choice(["a", None]), i, 1 + r.randrange(3000), r.randrange(3)) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(calls, "k long, j string, i long, now long, n long")
        got = {x["i"]: x["granted"] for x in limits.gcra(df, ["k", "j"], "now", "i", 50, 4, "n").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    step, states, want = limits.gcra_step(50, 4), {}, {}
    for k, j, i, now, n in sorted(calls, key=lambda c: (c[3], c[2])):
        want[i] = step(states.setdefault((k, j), {"due": 0}), now, n)[0]
    assert got == want
