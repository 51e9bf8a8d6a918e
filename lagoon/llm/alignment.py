"""Tokens of two tokenizers side by side, over a corpus of distinct segments.

A text is split before runs of white space, at characters for which both vocabularies
show that no token holds one after another kind of character: no merge crosses such
a place, so segments are encoded by themselves, and both tokenizers' tokens end there.

1. Tasks cut their texts into chunks of documents. A chunk's distinct segments are
   numbered, its documents become numbers, and its segments go to buckets by hash.
2. A bucket holds all occurrences of its segments: each distinct one is tokenised and
   aligned once and for all, and every chunk that asked gets its alignments back.
3. With them each chunk composes its documents (counts and groups), and its pairs of
   ids, each with the number of the chunk's documents that hold it linked.
4. Those numbers are summed over all chunks and joined back to the chunks' pairs; sums
   over links follow from segments' sums.

A segment or pair is at most one row of a chunk, whatever its frequency, so no key of
a shuffle is hot. Chunks, buckets and their answers are packed, some thousand segments
a row.

Defined cases: a text that is null or empty, or whose tokens' bytes differ from it (it
holds U+2581, which one vocabulary reads as a space), has no tokens: zeros and no
groups; a null id is kept; equal rows are documents of their own, and count as such; an
empty table gives no rows; further columns are ignored, whatever their names; a text
of any length is aligned whole, as a chunk of its own if it is longer than one.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm.shared import arrow_batches, write

#: Characters of text in a chunk, and bytes of the whole corpus for each bucket.
CHUNK, BUCKET = 8 << 20, 4 << 20
#: White space, as the byte-level tokenizer's pattern has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_MARK = "\u2581"
_workers: dict[tuple[str, str], "Aligner"] = {}


def safe_cuts(a: list[bytes], b: list[str]) -> str:
    """The ASCII white space before which texts may be split: in no entry of either vocabulary does it follow a character that isn't white space, nor (but for the space) the space that the second one puts first."""
    joint = {c: re.compile(f"[^{WHITE}]{re.escape(c)}") for c in WHITE if c.isascii()}
    entries = [t.decode("utf-8", "surrogateescape") for t in a]
    pieces = [p.replace(_MARK, " ") for p in b]
    alone = lambda c: c == " " or not any(f" {c}" in p for p in pieces)
    return "".join(c for c, found in joint.items() if alone(c) and not any(map(found.search, chain(entries, pieces))))


class Aligner:
    """Encodes segments by both tokenizers and cuts them where tokens of both end."""

    def __init__(self, a_file: str, b_file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self._a = Tokenizer.from_file(a_file)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in set(plain)]
        byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}
        if set(byte) != set(pre_tokenizers.ByteLevel.alphabet()):
            raise ValueError("the first vocabulary isn't byte-level")
        vocabulary = self._a.get_vocab(with_added_tokens=False)
        self._a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in byte for c in token):
                self._a_bytes[i] = bytes(byte[c] for c in token)
        ids = range(self._b.get_piece_size())
        text = lambda i: b"" if self._b.is_control(i) or self._b.is_unknown(i) else self._b.id_to_piece(i).replace(_MARK, " ").encode()
        self._b_bytes = [bytes([int(self._b.id_to_piece(i)[3:5], 16)]) if self._b.is_byte(i) else text(i) for i in ids]
        self._a_sizes, self._b_sizes = list(map(len, self._a_bytes)), list(map(len, self._b_bytes))
        self._space = self._b.piece_to_id(_MARK)
        self.safe = safe_cuts(self._a_bytes, [self._b.id_to_piece(i) for i in ids if not self._b.is_byte(i)])
        others = "".join(c for c in WHITE if c not in self.safe)
        self._split = re.compile(f"[{WHITE}]*[^{WHITE}]*(?:[{others}][{WHITE}]*[^{WHITE}]*)*")

    def segments(self, text: str) -> list[str]:
        """The parts of a space and the text; the first one starts with that space."""
        return self._split.findall(f" {text}")[:-1]

    def align(self, parts: list[str]) -> list[str]:
        """The groups of each segment as a1,a2|b1;a3|b2; | alone where either one's tokens don't spell the segment."""
        encoded = self._a.encode_batch_fast(parts, add_special_tokens=False)
        pieces = self._b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        out = []
        for part, e, b in zip(parts, encoded, pieces, strict=True):
            a = e.ids
            if part == " ":
                b = [self._space]  # the library would put no space before an empty text
            elif part[0] != " ":
                b = b[1:] if b[:1] == [self._space] else []  # and puts one here, which is a piece of its own
            raw = part.encode()
            spelt = b"".join(map(self._a_bytes.__getitem__, a)) == raw == b"".join(map(self._b_bytes.__getitem__, b))
            out.append(self._groups(a, b) if spelt else "|")
        return out

    def _groups(self, a: list[int], b: list[int]) -> str:
        out, i, j, from_a, from_b, end_a, end_b = [], 0, 0, 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                end_a += self._a_sizes[a[i]]
                i += 1
            else:
                end_b += self._b_sizes[b[j]]
                j += 1
            if end_a == end_b:
                out.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                from_a, from_b = i, j
        return ";".join(out)


def _aligner(files: tuple[str, str]) -> Aligner:
    if files not in _workers:
        _workers[files] = Aligner(*files)
    return _workers[files]


# --- packing ---------------------------------------------------------------


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2... values."""
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


# --- 1: chunks of numbered segments ----------------------------------------


def _chunked(rows: DataFrame, files: tuple[str, str], buckets: int, most: int) -> DataFrame:
    """(chunk, place, id, codes, parts): documents by place with their segments' numbers, and buckets by place with their segments in order of number."""
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["chunk", "place", "id", "codes", "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, split, kind = TaskContext.get().partitionId() << 33, _aligner(files).segments, pa.null()
        ids: list = []
        docs: list[array] = []
        numbers: dict[str, int] = {}
        size = 0

        def made() -> pa.RecordBatch:
            parts = list(numbers)
            raw = [p.encode() for p in parts]
            bucket = np.array([zlib.crc32(r) % buckets for r in raw], np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(parts), np.int32)
            place[order] = np.arange(len(parts), dtype=np.int32)
            present, first = np.unique(bucket[order], return_index=True)
            held = [b"\xff".join(raw[k] for k in order[i:j]) for i, j in pairwise([*first, len(parts)])]
            codes = [_packed(place[np.frombuffer(d, np.int32)]) for d in docs]
            n, m = len(docs), len(held)
            places = np.concatenate([np.arange(n), present])
            cols = [pa.array([chunk] * (n + m), pa.int64()), pa.array(places, pa.int64()), pa.array([*ids, *[None] * m], kind)]
            cols += [pa.array([*codes, *[None] * m], pa.binary()), pa.array([*[None] * n, *held], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            kind = b.column("id").type
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(i)
                parts = split(text) if text and _MARK not in text else []
                docs.append(array("i", [numbers.setdefault(p, len(numbers)) for p in parts]))
                size += len(text or "")
                if size >= most:
                    yield made()
                    ids, docs, numbers, size, chunk = [], [], {}, 0, chunk + 1
        if docs:
            yield made()

    return rows.mapInArrow(run, f"chunk long, place long, id {id_type}, codes binary, parts binary")


# --- 2: alignments of distinct segments ------------------------------------


def _answers(asked: DataFrame, files: tuple[str, str]) -> DataFrame:
    """(chunk, place, found): the groups of each asked segment, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, bucket, known = _aligner(files), None, {}
        for b in batches:
            found = []
            for place, blob in zip(b.column("place").to_pylist(), b.column("parts").to_pylist(), strict=True):
                if place != bucket:
                    bucket, known = place, {}
                parts = [p.decode() for p in blob.split(b"\xff")]
                new = [p for p in parts if p not in known]
                known.update(zip(new, aligner.align(new), strict=True))
                found.append(zlib.compress("\n".join(map(known.__getitem__, parts)).encode(), 1))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("place"), pa.array(found, pa.binary())], names=["chunk", "place", "found"])

    return asked.repartition("place").sortWithinPartitions("place").mapInArrow(run, "chunk long, place long, found binary")


# --- 3: documents of a chunk -----------------------------------------------


@dataclass
class Links:
    """Of segments by number: tokens of both tokenizers, groups and links; and each segment's pairs, one after another, with the links of each. A pair is the first one's id in the upper and the second one's in the lower 32 bits."""

    counts: np.ndarray
    start: np.ndarray
    pairs: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(text: bytes) -> "Links":
        """From the segments' groups, a line each."""
        buf = np.frombuffer(text + b"\n", np.uint8)
        ends = np.flatnonzero((buf < 48) | (buf > 57))  # each number ends at a sign
        sign, length = buf[ends], np.diff(ends, prepend=-1) - 1
        value = np.zeros(len(ends), np.int64)
        for k in range(int(length.max(initial=0))):
            more = length > k
            value[more] += (buf[ends[more] - 1 - k] - np.int64(48)) * 10**k
        before = lambda x: np.cumsum(x) - x
        line, over = sign == 10, (sign == 10) | (sign == 59)
        group, n_groups = before(over.astype(np.int64)), int(over.sum())
        right = before((sign == 124).astype(np.int64)) > group
        part = before(line.astype(np.int64))[over]  # the segment of each group
        sides = [(group[m], value[m]) for m in ((length > 0) & ~right, (length > 0) & right)]
        sizes = [np.bincount(g, minlength=n_groups) for g, _ in sides]
        of_part = lambda x: np.bincount(part, x, int(line.sum())).astype(np.int64)
        counts = np.stack([of_part(sizes[0]), of_part(sizes[1]), of_part(sizes[0] > 0), of_part(sizes[0] * sizes[1])], axis=1)

        # distinct ids of each group and side, and all pairs of those
        known = [np.unique(g << 32 | v, return_counts=True) for g, v in sides]
        (ga, a, ka), (gb, b, kb) = ((x >> 32, x & 0xFFFFFFFF, n) for x, n in known)
        n_b = np.bincount(gb, minlength=n_groups)
        reach = n_b[ga]
        inner = np.arange(int(reach.sum())) - np.repeat(_sums(reach)[:-1], reach)
        other = np.repeat(_sums(n_b)[:-1][ga], reach) + inner
        pair, of = np.repeat(a, reach) << 32 | b[other], np.repeat(part[ga], reach)
        times = np.repeat(ka, reach) * kb[other]
        order = np.lexsort((pair, of))
        pair, of, times = pair[order], of[order], times[order]
        first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        start = np.searchsorted(of[first], np.arange(len(counts) + 1))
        return Links(counts, start, pair[first], np.add.reduceat(times, first) if len(first) else times)


_COMPOSED = "chunk long, place long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, sizes binary, members binary, times binary, pairs array<long>, docs array<long>"


def _codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Segment numbers of a chunk's documents one after another, and where each document's begin and end."""
    each = [_unpacked(c, np.int32) for c in table.column("codes").to_pylist()]
    return (np.concatenate(each) if each else np.zeros(0, np.int32)).astype(np.int64), _sums(np.array(list(map(len, each)), np.int64))


def _compose(docs: pa.Table, answers: pa.Table, with_groups: bool) -> pa.Table:
    """Documents of a chunk, and in one row more its segments' pairs and how many of its documents hold each."""
    docs, answers = docs.sort_by("place"), answers.sort_by("place")
    text = b"\n".join(map(zlib.decompress, answers.column("found").to_pylist()))
    groups = text.decode().split("\n") if text else []
    read = Links.of(text) if text else Links(np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    counts = read.counts
    codes, at = _codes(docs)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    spoilt = np.unique(of[counts[codes, 2] == 0])  # a segment without groups isn't spelt by its tokens
    keep = ~np.isin(of, spoilt)
    codes, of = codes[keep], of[keep]
    at = np.searchsorted(of, np.arange(len(at)))
    sums = np.stack([_sums(counts[codes, k])[at] for k in range(4)])
    n_a, n_b, n_groups, n_links = np.diff(sums, axis=1)
    flat, texts = codes.tolist(), []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        texts.append(";".join([groups[k] for k in flat[i:j]]))
    digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]

    start, times = read.start, read.times
    sizes = np.diff(start)
    pairs, members = np.unique(read.pairs, return_inverse=True)
    held = np.unique(of * max(len(groups), 1) + codes)  # documents and their distinct segments
    doc, part = np.divmod(held, max(len(groups), 1))
    reach = sizes[part]
    inner = np.arange(int(reach.sum())) - np.repeat(_sums(reach)[:-1], reach)
    linked = np.unique(np.repeat(doc, reach) * max(len(pairs), 1) + members[np.repeat(start[part], reach) + inner])
    in_docs = np.bincount(linked % max(len(pairs), 1), minlength=len(pairs)) if len(pairs) else np.zeros(0, np.int64)

    chunk, n = docs.column("chunk")[0].as_py(), len(docs)
    last = lambda values, more, kind: pa.array([*values, more], kind)
    nothing = [None] * n
    cols = {"chunk": pa.array([chunk] * (n + 1), pa.int64()), "place": last(docs.column("place").to_pylist(), None, pa.int64())}
    cols |= {k: last(v.tolist(), None, pa.int64()) for k, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links))}
    cols |= {"groups_sha256": last(digests, None, pa.string()), "groups": last(texts if with_groups else nothing, None, pa.string())}
    cols |= {"sizes": last(nothing, _packed(sizes.astype(np.int32)), pa.binary()), "members": last(nothing, _packed(members.astype(np.int32)), pa.binary()), "times": last(nothing, _packed(times), pa.binary())}
    cols |= {"pairs": last(nothing, pairs.tolist(), pa.list_(pa.int64())), "docs": last(nothing, in_docs.tolist(), pa.list_(pa.int64()))}
    return pa.table(cols)


# --- 4: counts of pairs, and sums over links -------------------------------


def pair_counts(composed: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked, and whether no pair of its first id has more."""
    rows = composed.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("e"))
    counted = rows.groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    most = counted.groupBy("a").agg(F.max("n").alias("most"))
    return counted.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of a chunk with their sums over links; rows of numbers and of digests come together in `docs`, those of pairs and segments in `answers`."""
    import pyarrow.compute as pc

    numbered = docs.filter(pc.is_valid(docs.column("codes"))).sort_by("place")
    digests = docs.filter(pc.is_null(docs.column("codes"))).sort_by("place")
    own = answers.filter(pc.is_valid(answers.column("sizes")))
    counted = answers.filter(pc.is_null(answers.column("sizes"))).sort_by("at")
    start = _sums(_unpacked(own.column("sizes")[0].as_py(), np.int32))
    members, times = _unpacked(own.column("members")[0].as_py(), np.int32), _unpacked(own.column("times")[0].as_py(), np.int64)
    n, best = counted.column("n").to_numpy(), counted.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
    codes, at = _codes(numbered)
    aligned = digests.column("n_groups").to_numpy() > 0
    out = {"id": numbered.column("id")} | {k: digests.column(k) for k in ("n_a", "n_b", "n_groups", "n_links")}
    for name, values in (("n_best", best), ("count_sum", n)):
        of_part = np.diff(_sums(times * values[members])[start])
        out[name] = pa.array(np.where(aligned, np.diff(_sums(of_part[codes])[at]), 0), pa.int64())
    return pa.table(out | {k: digests.column(k) for k in ("groups_sha256", "groups")})


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups, which are null unless asked for) for each row."""
    arrow_batches(docs.sparkSession)
    files = (a_file, b_file)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunked = write(_chunked(rows, files, -(-total // bucket) or 1, chunk), "segments").df
    numbered = chunked.where("codes IS NOT NULL").select("chunk", "place", "id", "codes")
    answers = _answers(chunked.where("parts IS NOT NULL").select("chunk", "place", "parts"), files)
    by_chunk = numbered.select("chunk", "place", "codes").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    composed = write(by_chunk.applyInArrow(lambda d, a: _compose(d, a, with_groups), _COMPOSED), "composed").df

    own = composed.where("pairs IS NOT NULL").select("chunk", "sizes", "members", "times")
    asked = composed.where("pairs IS NOT NULL").select("chunk", F.posexplode("pairs").alias("at", "pair"))
    counted = asked.join(pair_counts(composed), "pair").select("chunk", "at", "n", "best")
    digests = composed.where("place IS NOT NULL").select("chunk", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")
    left = numbered.unionByName(digests, allowMissingColumns=True)
    right = counted.unionByName(own, allowMissingColumns=True)
    id_type = docs.schema[id_col].dataType.simpleString()
    out = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    made = left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(_score, f"id {id_type}, {out}")
    return made.withColumnRenamed("id", id_col)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).drop("groups")
