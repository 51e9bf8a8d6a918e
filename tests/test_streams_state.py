"""Streams with state set up their own store, and hold many keys in one group."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lagoon.plans import stream_queries
from lagoon.streaming import streams
from tests.compare import duck_rows, rows
from tests.test_streams import COMMANDS, _arrive, _commands, _plain_fires

SF = "/root/testdata/sf0.001"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def default_store(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)


def test_admissions_in_a_session_of_the_default_store(spark, default_store):
    got = stream_queries.QUERIES["stream_admissions"](spark, SF)
    assert rows(got) == duck_rows(SF, stream_queries.SQL["stream_admissions"], got.columns)


def test_transitions_in_a_session_of_the_default_store(spark, default_store, tmp_path):
    made = spark.range(6).select((F.col("id") % 2).alias("scope"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") < 4, "UP").otherwise("DOWN").alias("status"))
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    got, _ = streams.settle(streams.transitions(stream), str(tmp_path / "out"))
    assert sorted((r["scope"], r["before"], r["status"]) for r in got.collect()) == [(0, "UP", "DOWN"), (1, "UP", "DOWN")]


def test_keys_of_one_group_share_a_call(spark, tmp_path, monkeypatch):
    """Timers of all keys in two groups, over batches that each bring some of them; state ends with the last."""
    monkeypatch.setattr(streams, "GROUPS", 2)
    r = random.Random(4)
    commands = [(r.randrange(40), *c[1:]) for c in _commands(300, 5)]
    batches = [commands[:90], commands[90:200], commands[200:], [(None, 0, "tick", 5000, 0)]]
    (tmp_path / "in").mkdir()
    stream = _arrive(spark, tmp_path / "in", batches, COMMANDS)
    fired, progress = streams.settle(streams.timers(stream, 10), str(tmp_path / "out"))
    assert Counter(map(tuple, fired.collect())) == _plain_fires(commands)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert held[-1] == 0


def test_processors_are_called_by_group(spark, tmp_path, monkeypatch):
    """As often as there are groups, not keys."""
    calls = spark.sparkContext.accumulator(0)
    handle = streams.Timers.handleInputRows

    class Counted(streams.Timers):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            return handle(self, key, rows, timerValues)

    monkeypatch.setattr(streams, "Timers", Counted)
    monkeypatch.setattr(streams, "GROUPS", 3)
    (tmp_path / "in").mkdir()
    stream = _arrive(spark, tmp_path / "in", [[(k, k, "schedule", 1, 5) for k in range(200)]], COMMANDS)
    streams.settle(streams.timers(stream), str(tmp_path / "out"))
    assert 0 < calls.value <= 3
