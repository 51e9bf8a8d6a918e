"""The segment source: commits, seeks, shares of a file, damage."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lagoon.plans import catalogue
from lagoon.sources import runs, segments
from tests.compare import duck_rows, rows


def _payloads(n, seed=1):
    r = random.Random(seed)
    return [r.randbytes(r.choice([0, 1, 20, 300])) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three logs of 700 frames or fewer, one file each."""
    path = str(tmp_path_factory.mktemp("segments") / "logs")
    df = spark.createDataFrame([(i % 3, i, bytes(p)) for i, p in enumerate(_payloads(2000))], "log int, i long, p binary")
    assert segments.write(df, "p", ["i"], path, "crc32", segment="log") == 2000
    return path


def _rows(df):
    return sorted((r["segment"], r["block"], r["end"], bytes(r["payload"] or b""), r["error"]) for r in df.collect())


def test_blocks_and_ends_of_a_log(spark, folder):
    got = _rows(segments.read(spark, folder, "crc32"))
    want = []
    for log in range(3):
        mine = _payloads(2000)[log::3]
        ends = itertools.accumulate(8 + len(p) for p in mine)
        want += [(str(log), k, e, p, None) for k, (p, e) in enumerate(zip(mine, ends, strict=True))]
    assert got == sorted(want)


@pytest.mark.parametrize("split", [3000, 20_000, 1 << 20])
def test_shares_of_a_file_give_each_frame_once(spark, folder, split):
    assert _rows(segments.read(spark, folder, "crc32", split)) == _rows(segments.read(spark, folder, "crc32"))


def test_a_seek_reads_the_stretch_of_its_block_and_those_behind(folder):
    """Bytes of a log of 667 frames that are read from block 600 on: the stretch from the indexed block 576, no others."""
    raw = segments.encode(_payloads(2000)[::3], "crc32")
    ends = [e for _, e, *_ in segments.decode(raw, "crc32")]
    index = [0, *(ends[k - 1] for k in range(segments.EVERY, len(ends), segments.EVERY))]
    seen = []

    def read_at(at, n):
        seen.append((at, min(n, len(raw) - at)))
        return raw[at : at + n]

    reader = segments.Reader("none", "crc32", 1 << 20)
    list(reader.pushFilters([segments.ds.GreaterThanOrEqual(("block",), 600)]))
    got = list(reader.rows(read_at, index, segments.Share(segments.File("x", "x", len(raw), True), 0, len(raw)), len(raw)))
    assert [r[0] for r in got] == list(range(600, 667))
    assert min(at for at, _ in seen) == index[9] and sum(n for _, n in seen) <= len(raw) - index[9] + 64


@pytest.mark.parametrize("where", ["block >= 600", "block = 64", "block < 65 AND segment = '1'", "end <= 900", "segment IN ('0', '2') AND block > 660", "end < 0", "block >= 10000"])
def test_bounds_reach_the_source_and_keep_the_rows(spark, folder, where):
    every = spark.createDataFrame(segments.read(spark, folder, "crc32").collect(), segments.SCHEMA)
    assert _rows(segments.read(spark, folder, "crc32", 20_000).where(where)) == _rows(every.where(where))


def test_left_over_files_are_not_read(spark, tmp_path):
    path = tmp_path / "out"
    df = spark.range(10).select("id", F.col("id").cast("string").alias("p"))
    segments.write(df, "p", ["id"], str(path))
    for folder in (path, path / "_data"):
        (folder / "0123-00000-7-0000.seg").write_bytes(segments.encode([b"left over"] * 10))
    (path / "_pending-0123").write_text("[]")
    assert segments.read(spark, str(path)).count() == 10
    first = tmp_path / "first"  # a first write that never came to its commit
    (first / "_data").mkdir(parents=True)
    (first / "_data" / "0123-00000-7-0000.seg").write_bytes(segments.encode([b"left over"] * 10))
    assert segments.read(spark, str(first)).count() == 0


def test_a_failed_write_leaves_nothing_to_see(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("p")).repartition(4)
    segments.write(df.where("id < 100"), "p", ["id"], path)
    broken = df.withColumn("p", F.when(F.col("id") == 999, F.raise_error(F.lit("broken"))).otherwise(F.col("p")))
    with pytest.raises(Exception, match="broken"):
        segments.write(broken, "p", ["id"], path, mode="append")
    assert segments.read(spark, path).count() == 100


def test_modes(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(10).select("id", F.col("id").cast("string").alias("p"))
    assert segments.write(df, "p", ["id"], path) == 10
    with pytest.raises(ValueError, match="already"):
        segments.write(df, "p", ["id"], path)
    assert segments.write(df, "p", ["id"], path, mode="append") == 10 and segments.read(spark, path).count() == 20
    assert segments.write(df.where("id < 3"), "p", ["id"], path, mode="overwrite") == 3 and segments.read(spark, path).count() == 3
    assert len(list((tmp_path / "out").glob("_commit*"))) == 1
    assert sum(len(segments.read(spark, str(f)).collect()) for f in (tmp_path / "out" / "_data").glob("*.seg")) == 3


def test_damage_costs_the_rest_of_its_stretch(spark, tmp_path):
    """With an index reading goes on at the next indexed block, without one it ends."""
    raw = bytearray(segments.encode([b"%03d" % i for i in range(200)], "crc32"))
    raw[11 * 70 + 9] ^= 1  # in the payload of block 70
    raw += b"\0\0"
    (tmp_path / "a.seg").write_bytes(raw)
    got = _rows(segments.read(spark, str(tmp_path), "crc32"))
    assert [r[1] for r in got] == list(range(71)) and got[-1][4] == "checksum"
    (tmp_path / "a.seg.idx").write_bytes(segments.struct.pack(">4Q", *(11 * 64 * k for k in range(4))))
    got = _rows(segments.read(spark, str(tmp_path), "crc32", 100))
    assert [r[1] for r in got] == [*range(71), *range(128, 201)] and (got[70][4], got[-1][4]) == ("checksum", "truncated")
    assert segments.read(spark, str(tmp_path / "a.seg"), "crc32").where("error IS NULL").count() == 142


def test_replay_of_torn_logs(spark, tmp_path):
    """Logs whose files end inside a frame, or hold a wrong byte, replay up to there."""
    path = tmp_path / "logs"
    segments.write(spark.range(300).select((F.col("id") % 3).alias("log"), "id", F.col("id").cast("string").alias("p")), "p", ["id"], str(path), "crc32", segment="log")
    files = {e["segment"]: path / e["name"] for c in path.glob("_commit*") for e in segments.json.loads(c.read_text())}
    files["0"].write_bytes(files["0"].read_bytes()[:-3])
    raw = bytearray(files["1"].read_bytes())
    raw[-15] ^= 1
    files["1"].write_bytes(raw)
    frames = segments.read(spark, str(path), "crc32")
    kept = runs.replay(frames, "segment", "block", F.col("error").isNull()).groupBy("segment").agg(F.count("*").alias("n"), F.max(F.col("payload").cast("string").cast("long")).alias("last"))
    assert {r["segment"]: (r["n"], r["last"]) for r in kept.collect()} == {"0": (99, 294), "1": (98, 292), "2": (100, 299)}


def test_scheme_less_paths_are_the_default_file_system_s(spark, tmp_path):
    assert segments._qualified(spark, str(tmp_path)).startswith("file:/")
    hadoop = spark._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "viewfs://c/")
    hadoop.set("fs.viewfs.mounttable.c.link./in", f"file://{tmp_path}")
    try:
        assert segments._qualified(spark, "/in/x") == "viewfs://c/in/x"
    finally:
        hadoop.set("fs.defaultFS", before)


def test_seek_query_at_a_larger_size(spark):
    df = catalogue.queries()["segment_seek"](spark, "/root/testdata/sf0.01")
    got = rows(df)
    assert got and got == duck_rows("/root/testdata/sf0.01", catalogue.oracle_sql()["segment_seek"], df.columns)
