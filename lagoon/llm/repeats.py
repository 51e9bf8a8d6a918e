"""Exact removal of repeated byte strings by a depth-limited radix sort.

Suffixes are told apart only through their first `length` bytes, in passes from
the most significant digit, and only groups of equal suffixes go on to the next
pass. What is equal after the last pass are exactly the repeated windows.

Only sampled suffixes are sorted. Of the `SEED`-byte strings in a window, the one
with the least hash is its anchor (the first one on ties); equal windows have
equal anchors at equal distances, so a window is found with its anchor and no
byte needs a row of its own.

1. First digit: the hash of an anchor's `SEED` bytes. Anchors that stand alone go.
2. Second digit: the hash of all bytes of all windows that an anchor stands for.
   In a group of two or more, every window is repeated. A group of one among
   others of the same first digit goes on, with one member of each other group.
3. Last digits: the windows of those. A first digit with up to `GROUP` second ones
   is sorted in one task, every window to its full depth. Larger ones are refined by
   shuffles in passes over ever smaller ranges of windows (`RANGES`), one row a
   range: if all bytes of a range stand elsewhere at the same distance, all its
   windows are repeated; if the bytes that its windows have in common stand nowhere
   else, none is; only what is left, and one of each set of equal ranges, is split
   further. Counts are pre-aggregated, so no task meets an unbounded group.

Strings are equal when their 64-bit hashes over random byte codes are, within a
group that agrees in the digits before.

Defined cases: a null or empty text, or one shorter than `length`, has no
windows. Rows are places of their own: repeated rows, and rows that share an id,
repeat each other's strings. Null ids are kept. An empty table gives no rows. Long
texts are scanned in overlapping blocks that share no window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm import scan
from lagoon.llm.shared import Table, arrow_batches, write

SEED = 50
GROUP = 500
#: Windows in a range, pass by pass, down to single ones; each is a multiple of the next.
RANGES = (30, 5, 1)
_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


def _least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash in every run of `width`, the first one on ties (of the upper 40 bits)."""
    key = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    n = len(key)
    rows = np.concatenate([key, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[: n - width + 1], before[width - 1 : n]) & _PLACE).astype(np.int64)


def anchors(buf: np.ndarray, off: np.ndarray, length: int, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of each anchor: document, place, first and last window that it stands for (places in the document), first and second digit."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(buf) < length:
        return none
    prefix = scan.Prefix(buf)
    seeds = prefix.fixed(seed)
    place = _least_places(seeds, length - seed + 1)
    sizes = np.diff(off)
    first, last = off[:-1][sizes >= length], off[1:][sizes >= length] - length
    if not len(first):
        return none
    steps = np.zeros(len(place) + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, last + 1, -1)
    windows = np.flatnonzero(np.cumsum(steps[:-1]))
    at = place[windows]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    lo, hi = windows[new], windows[np.concatenate([new[1:], [len(windows)]]) - 1]
    at = at[new]
    doc = np.searchsorted(off, at, "right") - 1
    digit2 = scan.mix(prefix.of(lo, hi + length) + (at - lo).astype(np.uint64))
    start = off[doc]
    return doc, at - start, lo - start, hi - start, seeds[at].view(np.int64), digit2.view(np.int64)


def _blocks(off: np.ndarray, length: int, limit: int = scan.CHUNK_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """(first document, end document, first byte, end byte): runs of documents, or overlapping parts of a long one."""
    for i, j in scan.chunks(off, limit):
        if j - i == 1 and off[j] - off[i] > 2 * limit:
            for a in range(int(off[i]), int(off[j]), limit):
                yield i, j, a, min(int(off[j]), a + limit + length - 1)
        else:
            yield i, j, int(off[i]), int(off[j])


def _text_hash(text_col: str):
    """Tells apart texts that share an id."""
    return F.xxhash64(text_col)


# at: place << 16 | (place - first window) << 8 | (place - last window)
_LO = "(shiftright(at, 16) - (shiftright(at, 8) & 255))"
_HI = "(shiftright(at, 16) - (at & 255))"


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = scan.flatten(b.column("text"))
            for i, j, a, z in _blocks(off, length):
                own = np.clip(off[i : j + 1], a, z) - a
                doc, place, lo, hi, d1, d2 = anchors(buf[a:z], own, length)
                shift = a - off[i] if j - i == 1 else 0
                take = pa.array(doc + i)
                at = ((place + shift) << 16) | ((place - lo) << 8) | (place - hi)
                yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("th").take(take), pa.array(d1), pa.array(d2), pa.array(at)], names=["id", "th", "d1", "d2", "at"])

    return docs.mapInArrow(run, f"id {id_type}, th long, d1 long, d2 long, at long")


def _contexts(contested: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of all windows of each contested anchor."""
    asked = contested.groupBy(F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth")).agg(F.collect_list(F.struct("d1", "n", "m", F.col("rep.at").alias("at"))).alias("asked"))
    joined = docs.join(asked, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))).select("id", "th", "text", "asked")
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = scan.flatten(b.column("text"))
            lists = b.column("asked")
            counts = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(b)), counts)
            flat = lists.flatten()
            at = flat.field("at").to_numpy()
            start = off[doc] + (at >> 16) - ((at >> 8) & 255)
            end = off[doc] + (at >> 16) - (at & 255) + length
            take = pa.array(doc)
            parts = pa.array([buf[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("th").take(take), flat.field("d1"), flat.field("n"), flat.field("m"), flat.field("at"), parts], names=["id", "th", "d1", "n", "m", "at", "bytes"])

    return joined.mapInArrow(run, f"id {id_type}, th long, d1 long, n long, m long, at long, bytes binary")


def _window_keys(b: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window in the rows: its row, its place in the document, and a key of its bytes and distance to the anchor."""
    buf, off = scan.flatten(b.column("bytes"))
    at = b.column("at").to_numpy()
    sizes = np.diff(off) - length + 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes = scan.Prefix(buf).fixed(length)[off[row] + inside]
    lo = (at >> 16) - ((at >> 8) & 255)
    distance = (((at >> 8) & 255)[row] - inside).astype(np.uint64)
    salt = scan.mix(b.column("d1").to_numpy().view(np.uint64))
    return row, lo[row] + inside, scan.mix(hashes + salt[row] + distance * np.uint64(0xC2B2AE3D27D4EB4F))


def _small_groups(rows: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows of the anchors that are alone in their second digit; rows come sorted by first digit."""
    id_type = rows.schema["id"].dataType.simpleString()
    out = f"id {id_type}, th long, start long, end long"

    def solve(table: pa.Table) -> pa.RecordBatch:
        b = table.combine_chunks().to_batches()[0]
        row, place, key = _window_keys(b, length)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        again &= (b.column("n").to_numpy() == 1)[row]
        hit = np.flatnonzero(again)
        edge = np.ones(len(hit) + 1, bool)
        edge[1:-1] = (row[hit[1:]] != row[hit[:-1]]) | (place[hit[1:]] != place[hit[:-1]] + 1)
        starts, ends = hit[edge[:-1]], hit[edge[1:]]
        take = pa.array(row[starts])
        return pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("th").take(take), pa.array(place[starts]), pa.array(place[ends] + length)], names=["id", "th", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not len(b):
                continue
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if len(held) < 2000:
                continue
            d1 = held.column("d1").to_numpy()
            whole = int(np.searchsorted(d1, d1[-1], "left"))  # the last group may go on
            if whole:
                yield solve(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield solve(held)

    return rows.repartition("d1").sortWithinPartitions("d1").mapInArrow(run, out)


def _ranges(rows: DataFrame, length: int, width: int) -> DataFrame:
    """Each row's windows (by distance to the anchor, near to far) cut into ranges of `width`, with keys of the bytes that all windows of a whole range have (core) and of the bytes of the row's own windows in it (whole)."""
    id_type = rows.schema["id"].dataType.simpleString()
    names = ("id", "th", "d1", "anchor", "alone", "near", "far", "core", "whole", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = scan.flatten(b.column("bytes"))
            near, far = b.column("near").to_numpy(), b.column("far").to_numpy()
            first = near // width
            n = far // width - first + 1
            row = np.repeat(np.arange(len(n)), n)
            part = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            lo, hi = np.maximum(near[row], part * width), np.minimum(far[row], part * width + width - 1)
            place = off[row] + far[row]  # of the anchor; a row's bytes start with its farthest window
            prefix = scan.Prefix(buf)
            salt = scan.mix(scan.mix(b.column("d1").to_numpy().view(np.uint64))[row] + part.astype(np.uint64))
            core = scan.mix(prefix.of(place - part * width, place - part * width - width + 1 + length) + salt)
            own = scan.mix(core + (lo * 256 + hi).astype(np.uint64))
            whole = scan.mix(prefix.of(place - hi, place - lo + length) + own)
            parts = pa.array([buf[s:e].tobytes() for s, e in zip((place - hi).tolist(), (place - lo + length).tolist(), strict=True)], pa.binary())
            same = [b.column(c).take(pa.array(row)) for c in names[:5]]
            yield pa.RecordBatch.from_arrays([*same, pa.array(lo), pa.array(hi), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), parts], names=list(names))

    return rows.select("id", "th", "d1", "anchor", "alone", "near", "far", "bytes").mapInArrow(run, f"id {id_type}, th long, d1 long, anchor long, alone boolean, near long, far long, core long, whole long, bytes binary")


def _large_groups(rows: DataFrame, length: int) -> Table:
    """A written table of the spans of repeated windows of the anchors that are alone in their second digit."""
    start = rows.select("id", "th", "d1", F.expr("shiftright(at, 16)").alias("anchor"), (F.col("n") == 1).alias("alone"), F.expr("at & 255").alias("near"), F.expr("shiftright(at, 8) & 255").alias("far"), "bytes")
    now, spans = write(start, "ranges"), None
    for width in RANGES:
        if now.df.isEmpty():
            break
        cut = write(_ranges(now.df, length, width), "ranges")
        now.drop()
        one = F.min(F.struct("id", "th", "d1", "anchor", "near", "far", "bytes")).alias("rep")
        classes = write(cut.df.groupBy("core", "whole").agg(F.count("*").alias("n"), F.max("alone").alias("alone"), one), "classes")
        repeated = cut.df.where("alone").join(classes.df.where("n > 1").select("core", "whole"), ["core", "whole"])
        found = repeated.select("id", "th", (F.col("anchor") - F.col("far")).alias("start"), (F.col("anchor") - F.col("near") + length).alias("end"))
        before, spans = spans, write(found if spans is None else found.unionByName(spans.df), "large")
        still = F.col("alone") & (F.col("n") == 1)
        open_ = write(classes.df.groupBy("core").agg(F.count("*").alias("m"), F.max(still).alias("open")).where("m > 1 AND open").select("core"), "open")
        now = write(classes.df.join(open_.df, "core").select("rep.*", still.alias("alone")), "ranges")
        for t in (cut, classes, open_, *([before] if before else [])):
            t.drop()
    now.drop()
    none = rows.select("id", "th", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")).where("false")
    return spans or write(none, "large")


def repeated_spans(docs: DataFrame, length: int, id_col: str = "doc_id", text_col: str = "text") -> Table:
    """A written table (id, th, spans): of each document with repeated strings, the byte ranges that they cover; th is `xxhash64(text)`."""
    arrow_batches(docs.sparkSession)
    if length > 255 or length <= SEED:
        raise ValueError(f"length must be over {SEED} and under 256")
    source = docs.select(F.col(id_col).alias("id"), _text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    found = write(_anchor_rows(source.where(F.octet_length("text") >= length), length), "anchors")
    # written, so that the join's sides are plain exchanges, whose hot partitions Spark can split
    again = write(found.df.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"), "again")
    together = write(found.df.join(again.df, "d1"), "together")
    found.drop()
    digits = write(together.df.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "at")).alias("rep")), "digits")
    resolved = together.df.join(digits.df.where("n > 1").select("d1", "d2"), ["d1", "d2"]).select("id", "th", F.expr(_LO).alias("start"), F.expr(f"{_HI} + {length}").alias("end"))
    of_first = write(digits.df.groupBy("d1").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("alone")).where("alone > 0").drop("alone"), "contested")
    contexts = write(_contexts(digits.df.join(of_first.df, "d1"), source, length), "contexts")
    small = _small_groups(contexts.df.where(F.col("m") <= GROUP), length)
    large = _large_groups(contexts.df.where(F.col("m") > GROUP), length)
    pieces = write(resolved.unionByName(small).unionByName(large.df).distinct(), "pieces")
    for t in (again, together, digits, of_first, contexts, large):
        t.drop()
    spans = write(pieces.df.groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    pieces.drop()
    return spans


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of ranges as maximal runs."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return list(zip(s[new].tolist(), e[np.concatenate([np.flatnonzero(new)[1:], [len(s)]]) - 1].tolist(), strict=True))


def _each(docs: DataFrame, spans: Table, id_col: str, text_col: str, extra: dict[str, pa.DataType], make: Callable[[bytes, list[tuple[int, int]]], tuple]) -> DataFrame:
    """A struct `row` of all columns of each document, and what `make` gives for its text and its merged spans."""
    found = spans.df.select(F.col("id").alias("rid"), F.col("th").alias("rth"), "spans")
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), _text_hash(text_col).alias("th"))
    place = docs.columns.index(text_col)
    joined = whole.join(found, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left").select("row", "spans")
    kinds = {pa.int64(): "long", pa.string(): "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in extra]
            lists = b.column("spans")
            for i, text in enumerate(b.column("row").field(place).to_pylist()):
                own = lists[i]
                runs = merged(own.values.field("start").to_numpy(), own.values.field("end").to_numpy()) if own.is_valid else []
                for c, v in zip(cols, make((text or "").encode(), runs), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(c, t) for c, t in zip(cols, extra.values(), strict=True))], names=["row", *extra])

    out = whole.select("row").schema
    for n, t in extra.items():
        out = out.add(n, kinds[t])
    return joined.mapInArrow(run, out)


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in runs:
        out.append(raw[at:s])
        at = e
    out.append(raw[at:])
    return b"".join(out)


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kept_text, n_removed): a struct of all columns, the text without the repeated strings (a character that is cut in two goes as a whole), and the bytes that went."""
    spans = repeated_spans(docs, length, id_col, text_col)
    return _each(docs, spans, id_col, text_col, {"kept_text": pa.string(), "n_removed": pa.int64()}, lambda raw, runs: (kept_bytes(raw, runs).decode(errors="ignore") if runs else raw.decode(), sum(e - s for s, e in runs)))


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    done = _each(docs, repeated_spans(docs, 200), "doc_id", "text", kinds, lambda raw, runs: (len(raw), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept_bytes(raw, runs)).hexdigest()))
    return done.select("row.doc_id", *kinds)
