"""Segment files as a data source: frames of a 4-byte big-endian length, an optional checksum, and a payload.

A written folder holds data files in `_data`, an index beside each (the place of every
64th block), and commit lists. A reader takes the files that a commit list names, so
what a failed or repeated task left behind is never seen; of a folder without lists, such
as one that another system wrote, it takes all `*.seg` files, and a single file by itself.

Files are cut for reading: a task takes the stretches between indexed blocks that
start in its share of the bytes, and holds a few frames at a time, so files of any
size are read side by side. Bounds on `block` and `end` and names of segments reach the
source (with ``spark.sql.python.filterPushdown.enabled``, which `read` sets): a task
opens a file at the indexed block before the bound and stops behind it.

A frame that a file ends in, or whose checksum is wrong, gives a row with an `error`;
reading goes on at the next indexed block, or ends if the file has no index.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

CHECKS = {"none": 0, "crc32": 4, "xxh3": 8}
#: Blocks from one indexed place to the next.
EVERY = 64
_DATA = "_data"
FILE_BYTES, SPLIT_BYTES = 64 << 20, 64 << 20
SCHEMA = "segment string, block long, end long, payload binary, error string"


def _check(kind: str, payload: bytes) -> bytes:
    if kind == "crc32":
        return struct.pack(">I", zlib.crc32(payload))
    if kind == "xxh3":
        import xxhash

        return xxhash.xxh3_64_digest(payload)
    return b""


def frame(payload: bytes, check: str = "none") -> bytes:
    return struct.pack(">I", len(payload)) + _check(check, payload) + payload


def encode(payloads: Iterable[bytes], check: str = "none") -> bytes:
    return b"".join(frame(p, check) for p in payloads)


Frame = tuple[int, int, "bytes | None", "str | None"]


def frames(read_at: Callable[[int, int], bytes], start: int, stop: int, size: int, block: int, check: str = "none", ahead: int = 1 << 20) -> Iterator[Frame]:
    """(block, end, payload, error) of the frames that start in [start, stop) of a file of so many bytes; ends with the first error. `read_at(place, n)` gives a file's bytes. (O001, O003, O004, O012)"""
    at, extra, held, held_at = start, CHECKS[check], b"", start

    def take(n: int) -> bytes:
        nonlocal held, held_at
        if held_at + len(held) < at + n:
            held, held_at = read_at(at, max(n, min(ahead, stop - at + 4 + extra))), at
        return held[at - held_at : at - held_at + n]

    while at < min(stop, size):
        head = take(4 + extra) if at + 4 + extra <= size else b""
        n = struct.unpack_from(">I", head)[0] if head else size
        if at + 4 + extra + n > size:
            yield block, at, None, "truncated"
            return
        payload = take(4 + extra + n)[4 + extra :]
        if head[4:] != _check(check, payload):
            yield block, at, None, "checksum"
            return
        at += 4 + extra + n
        yield block, at, payload, None
        block += 1


def decode(raw: bytes, check: str = "none") -> Iterator[Frame]:
    return frames(lambda at, n: raw[at : at + n], 0, len(raw), len(raw), 0, check)


# --- files -----------------------------------------------------------------


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark itself would give it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


@dataclass(frozen=True)
class File:
    name: str
    segment: str
    size: int
    indexed: bool


@dataclass
class Commit(ds.WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


def _commits(store, root: str) -> list[str]:
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("_commit-"))


def _listed(path: str) -> tuple[str, list[File]]:
    """The folder, and the files in it that count."""
    from pyarrow import fs

    store, root = _store(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        folder, _, name = root.rpartition("/")
        return folder, [File(name, name, info.size, store.get_file_info(f"{root}.idx").type == fs.FileType.File)]
    lists = _commits(store, root)
    if lists:
        entries = [e for c in lists for e in json.loads(store.open_input_file(c).read())]
        return root, [File(e["name"], e["segment"], e["size"], True) for e in entries]
    found = [f for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File]
    names = {f.base_name for f in found}
    data = [f for f in found if f.base_name[0] not in "_." and f.base_name.endswith(".seg")]
    return root, [File(f.base_name, f.base_name, f.size, f"{f.base_name}.idx" in names) for f in data]


class Writer(ds.DataSourceArrowWriter):
    """Tasks write files under names of their own; the commit names those of the tasks that succeeded. (O002)"""

    def __init__(self, path: str, check: str, file_bytes: int, overwrite: bool) -> None:
        self.path, self.check, self.file_bytes, self.overwrite, self.job = path, check, file_bytes, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Commit:
        from pyspark import TaskContext

        store, root = _store(self.path)
        store.create_dir(f"{root}/{_DATA}", recursive=True)
        part, done = TaskContext.get().partitionId(), Commit()
        mine = f"{self.job}-{part:05d}-{TaskContext.get().taskAttemptId()}"
        out, segment, at, blocks, index = None, None, 0, 0, []

        def close() -> None:
            out.close()
            with store.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(struct.pack(f">{len(index)}Q", *index))
            done.files.append({"name": name, "segment": name.removeprefix(f"{_DATA}/") if segment is None else segment, "size": at, "blocks": blocks})

        for b in iterator:
            for s, p in zip(b.column("segment").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if p is None:
                    continue
                if out is not None and (s != segment or at >= self.file_bytes):
                    close()
                    out = None
                if out is None:
                    name, segment, at, blocks, index = f"{_DATA}/{mine}-{len(done.files):04d}.seg", s, 0, 0, []
                    out = store.open_output_stream(f"{root}/{name}")
                if blocks % EVERY == 0:
                    index.append(at)
                at += out.write(frame(p, self.check))
                blocks += 1
        if out is not None:
            close()
        return done

    def commit(self, messages: list[Commit | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        before = _commits(store, root)
        files = [f for m in messages if m is not None for f in m.files]
        pending = f"{root}/_pending-{self.job}"
        with store.open_output_stream(pending) as f:
            f.write(json.dumps(files).encode())
        store.move(pending, f"{root}/_commit-{len(before):08d}-{self.job}")
        if self.overwrite:
            for old in before:
                gone = json.loads(store.open_input_file(old).read())
                store.delete_file(old)
                for f in gone:
                    for suffix in ("", ".idx"):
                        store.delete_file(f"{root}/{f['name']}{suffix}")

    def abort(self, messages: list[Commit | None]) -> None:
        """Takes away what finished tasks wrote; what others left is in no list."""
        store, root = _store(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            for suffix in ("", ".idx"):
                store.delete_file(f"{root}/{f['name']}{suffix}")


@dataclass
class Share(ds.InputPartition):
    """The stretches of a file that start in [start, stop)."""

    file: File
    start: int
    stop: int


class Reader(ds.DataSourceReader):
    """(O001, O006-O008)"""

    def __init__(self, path: str, check: str, split_bytes: int) -> None:
        self.path, self.check, self.split_bytes = path, check, split_bytes
        self.least, self.most, self.ends, self.segments = 0, None, None, None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        low = lambda x: max(self.least, x)
        tops = lambda old, x: x if old is None else min(old, x)
        for f in filters:
            at, v = getattr(f, "attribute", None), getattr(f, "value", None)
            if at == ("block",) and isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo)):
                self.least = low(v + isinstance(f, ds.GreaterThan))
            if at == ("block",) and isinstance(f, (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo)):
                self.most = tops(self.most, v - isinstance(f, ds.LessThan))
            if at == ("end",) and isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
                self.ends = tops(self.ends, v - isinstance(f, ds.LessThan))
            if at == ("segment",) and isinstance(f, (ds.EqualTo, ds.In)):
                own = {v} if isinstance(f, ds.EqualTo) else set(v)
                self.segments = own if self.segments is None else self.segments & own
            yield f  # bounds only narrow what is read; Spark still filters the rows

    def partitions(self) -> list[Share]:
        _, files = _listed(self.path)
        out = []
        for f in files:
            if self.segments is not None and f.segment not in self.segments:
                continue
            step = self.split_bytes if f.indexed else max(f.size, 1)
            stop = f.size if self.ends is None else min(f.size, self.ends)
            out += [Share(f, a, min(a + step, f.size)) for a in range(0, max(stop, 1 if f.size else 0), step)]
        return out

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        store, root = _store(self.path)
        info = store.get_file_info(root)
        place = root if info.is_file else f"{root}/{partition.file.name}"
        source = store.open_input_file(place)
        index = [0]
        if partition.file.indexed:
            raw = store.open_input_file(f"{place}.idx").read()
            index = list(struct.unpack(f">{len(raw) // 8}Q", raw)) or [0]

        def read_at(at: int, n: int) -> bytes:
            source.seek(at)
            return source.read(n)

        rows = self.rows(read_at, index, partition, source.size())
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += len(r[2] or b"")
            if len(held) >= 4096 or size >= 8 << 20:
                yield _batch(partition.file.segment, held)
                held, size = [], 0
        if held:
            yield _batch(partition.file.segment, held)

    def rows(self, read_at: Callable[[int, int], bytes], index: list[int], share: Share, size: int) -> Iterator[Frame]:
        """Stretch by stretch: those before the least block and behind the last bound aren't opened. `size` is what the file really has, which shows where it was torn off."""
        for k, start in enumerate(index):
            stop = index[k + 1] if k + 1 < len(index) else share.file.size
            if not share.start <= start < share.stop or (k + 1 < len(index) and (k + 1) * EVERY <= self.least):
                continue
            if (self.most is not None and k * EVERY > self.most) or (self.ends is not None and start > self.ends):
                return
            last = (k * EVERY - 1, start, None, None)
            for r in frames(read_at, start, min(stop, size), size, k * EVERY, self.check):
                last = r
                if (self.ends is not None and r[1] > self.ends) or (self.most is not None and r[0] > self.most):
                    return
                if r[0] >= self.least or r[3]:
                    yield r
            if size < stop and last[3] is None:
                yield last[0] + 1, max(start, size), None, "truncated"


def _batch(segment: str, rows: list[Frame]) -> pa.RecordBatch:
    blocks, ends, payloads, errors = zip(*rows, strict=True)
    cols = [pa.array([segment] * len(rows), pa.string()), pa.array(blocks, pa.int64()), pa.array(ends, pa.int64()), pa.array(payloads, pa.binary()), pa.array(errors, pa.string())]
    return pa.RecordBatch.from_arrays(cols, names=["segment", "block", "end", "payload", "error"])


class SegmentSource(ds.DataSource):
    """Format ``segments``: options path, check, fileBytes and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return SCHEMA

    def _check(self) -> str:
        kind = self.options.get("check", "none")
        if kind not in CHECKS:
            raise ValueError(f"no checksum {kind!r}")
        return kind

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._check(), int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self._check(), int(self.options.get("fileBytes", FILE_BYTES)), overwrite)


def _kind(check: str) -> str:
    if check not in CHECKS:
        raise ValueError(f"no checksum {check!r}")
    return check


def read(spark: SparkSession, path: str, check: str = "none", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(segment, block, end, payload, error)"""
    spark.dataSource.register(SegmentSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("segments").option("check", _kind(check)).option("splitBytes", split_bytes).load(_qualified(spark, path))


def write(df: DataFrame, payload: str, order: list[str], path: str, check: str = "none", file_bytes: int = FILE_BYTES, segment: str | None = None, mode: str = "errorifexists") -> int:
    """Writes the rows of each partition in order, from the tasks, to a store that all executors reach, as files of some `file_bytes`, and returns the number of frames. (O002)

    With `segment`, rows are dealt by that column and each of its values has files
    of its own, which carry its name; else a file's name is its segment. A folder that
    holds commits is refused unless the mode is append or overwrite; an overwrite takes
    the older files away once the new ones are committed. Null payloads aren't written.
    """
    spark, target = df.sparkSession, _qualified(df.sparkSession, path)
    if mode not in ("errorifexists", "append", "overwrite"):
        raise ValueError(f"no mode {mode!r}")
    before = set(_commits(*_store(target)))
    if before and mode == "errorifexists":
        raise ValueError(f"{path} holds segments already")
    spark.dataSource.register(SegmentSource)
    named = F.col(segment).cast("string") if segment else F.lit(None).cast("string")
    dealt = df.repartition(segment).sortWithinPartitions(segment, *order) if segment else df.sortWithinPartitions(*order)
    rows = dealt.select(named.alias("segment"), F.col(payload).cast("binary").alias("payload"))
    rows.write.format("segments").option("check", _kind(check)).option("fileBytes", file_bytes).mode("overwrite" if mode == "overwrite" else "append").save(target)
    store, _ = _store(target)
    new = set(_commits(*_store(target))) - before
    return sum(f["blocks"] for c in new for f in json.loads(store.open_input_file(c).read()))


def seek(frames_: DataFrame, block: int) -> DataFrame:
    """(O006, O007)"""
    return frames_.where(F.col("block") >= block)


def committed(frames_: DataFrame, marks: DataFrame) -> DataFrame:
    """Frames that end at or before their segment's greatest mark (segment, committed). (O008)"""
    top = marks.groupBy("segment").agg(F.max("committed").alias("committed"))
    return frames_.join(top, "segment").where("end <= committed").drop("committed")
