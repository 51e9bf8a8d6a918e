"""Projections, joins, timers and windows with state over streams in several batches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lagoon.operators import calendar, limits
from lagoon.streaming import streams
from tests.compare import rows

COMMANDS = "timer long, seq long, action string, tick long, delay long"


def _arrive(spark, path, batches, schema):
    """A stream of files that come one after another, a batch each."""
    import os
    import time

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    for k, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
        now = time.time() - 1000 + 10 * k
        for f in path.glob("*.parquet"):
            if f.stat().st_mtime > time.time() - 500:
                os.utime(f, (now, now))
    return stream


def test_projection_writes_what_changed_and_goes_on(spark, tmp_path):
    schema, aggs = "k long, v long", [F.count("*").alias("n"), F.sum("v").alias("total")]
    first = [[(k, 1) for k in range(50)], [(3, 10), (4, 10), (3, 5)]]
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    got = streams.catch_up(_arrive(spark, source, first, schema), ["k"], aggs, target, checkpoint)
    assert got.count() == 50 and [spark.read.parquet(f"{target}/batch-{n}").count() for n in (0, 1)] == [50, 2]
    assert got.where("k = 3").first() == (3, 3, 16)
    later = _arrive(spark, source, [[(99, 7), (4, 1)]], schema)  # after a restart
    got = streams.catch_up(later, ["k"], aggs, target, checkpoint)
    replay = spark.read.schema(schema).parquet(str(source)).groupBy("k").agg(*aggs)
    assert rows(got) == rows(replay) and spark.read.parquet(f"{target}/batch-2").count() == 2
    streams.compact(spark, target, ["k"], replay.schema)
    assert sorted(streams._folders(spark, target)) == ["merged-2"]
    assert rows(streams.projection(spark, target, ["k"], replay.schema)) == rows(replay)
    got = streams.catch_up(_arrive(spark, source, [[(3, 1)]], schema), ["k"], aggs, target, checkpoint)
    assert got.where("k = 3").first() == (3, 4, 17) and got.count() == 51


def test_join_emits_the_lonely_and_forgets(spark, tmp_path):
    """Left rows without a partner come out as their interval is over, and neither side's state stays."""
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    left = [[(k, at(1 + k)) for k in range(10)], [(100, at(25))], [(101, at(28))]]
    right = [[(k, at(2 + k)) for k in range(0, 10, 2)], [(200, at(25))], [(201, at(28))]]
    (tmp_path / "l").mkdir(), (tmp_path / "r").mkdir()
    a = _arrive(spark, tmp_path / "l", left, "k long, a string").select("k", F.to_timestamp("a").alias("a"))
    b = _arrive(spark, tmp_path / "r", right, "k long, b string").select("k", F.to_timestamp("b").alias("b"))
    got, progress = streams.settle(streams.interval_join(a, b, "k", "a", "b", "3 days", "0 seconds", "left_outer"), str(tmp_path / "out"))
    assert Counter((r["k"], r["b"] is not None) for r in got.collect()) == Counter([(k, k % 2 == 0) for k in range(10)])
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held) >= 15 and held[-1] <= 4


def _plain_fires(commands):
    out = []
    for timer in {c[0] for c in commands}:
        due = None
        for _, _, action, tick, delay in sorted((c for c in commands if c[0] == timer), key=lambda c: (c[3], c[1])):
            if due is not None and due <= tick:
                out.append((timer, due))
                due = None
            if action == "cancel":
                due = None
            elif action == "schedule" or due is not None:
                due = tick + max(delay, 1)
        if due is not None:
            out.append((timer, due))
    return Counter(out)


def _commands(n, seed):
    r = random.Random(seed)
    return [(r.randrange(6), i, r.choice(["schedule", "reschedule", "reschedule", "cancel"]), 1 + i * 3 + r.randrange(3), r.randrange(25)) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_fires(spark, seed):
    commands = _commands(400, seed)
    df = spark.createDataFrame(commands, COMMANDS)
    assert Counter(map(tuple, calendar.fires(df, "timer", "seq", "action", "tick", "delay").collect())) == _plain_fires(commands)


@pytest.mark.parametrize("cuts", [[], [60, 61, 130]])
def test_timers_fire_alike_in_any_split(spark, tmp_path, cuts):
    commands = _commands(200, 9)
    ends = [0, *cuts, len(commands)]
    batches = [commands[a:b] for a, b in zip(ends, ends[1:], strict=False)] + [[(None, 0, "tick", 5000, 0)]]
    (tmp_path / "in").mkdir()
    fired, progress = streams.settle(streams.timers(_arrive(spark, tmp_path / "in", batches, COMMANDS), 10), str(tmp_path / "out"))
    assert Counter(map(tuple, fired.collect())) == _plain_fires(commands)
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_windows_forget(spark, tmp_path):
    r = random.Random(2)
    calls = sorted(((r.choice([1, 2, None]), i, 1000 + i * 7) for i in range(300)), key=lambda c: c[2])
    batches = [calls[:100], calls[100:220], calls[220:], [(7, 1000, 90_000)], [(8, 1001, 180_000)]]
    (tmp_path / "in").mkdir()
    got, progress = streams.settle(streams.window_limits(_arrive(spark, tmp_path / "in", batches, "key long, call long, second long"), 60, 2), str(tmp_path / "out"))
    df = spark.createDataFrame([c for b in batches for c in b], "key long, call long, second long").withColumn("ts", F.timestamp_seconds("second"))
    want = limits.fixed_window(df, "key", "ts", "call", 60, 2).select("call", "granted")
    assert rows(got) == rows(want)
    assert [p["stateOperators"][0]["numRowsTotal"] for p in progress][-1] <= 2
