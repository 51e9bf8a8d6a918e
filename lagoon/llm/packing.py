"""Power-of-two packing.

A document of n tokens is split into pieces whose lengths are the powers of two
in n (and as many whole sequences as fit before), largest first. Pieces of equal
length form a bucket, and each piece is a sequence of its own: no sequence
crosses documents and none is padded.

Encoding is done once per distinct unit of text and worker, by the library
itself: neither its normaliser, its splitting pattern nor its special strings
reach across the borders of a unit (see `units`). A worker's table starts anew at
`MAX_UNITS`. Units are told apart by 64-bit hashes.

Defined cases: a null or empty text is the end token alone, one piece of length
1; a null id is kept; repeated rows are packed each for itself; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm import scan
from lagoon.llm.shared import arrow_batches

MAX_UNITS = 1_500_000
_workers: dict[str, "UnitEncoder"] = {}


_LETTER, _PUNCTUATION, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0xC3] = _LETTER
_KIND[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _PUNCTUATION
#: The same letters as in _KIND: U+00D7 and U+00F7 are signs.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def units(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes to encode, and the starts, ends and per-document counts of units that are encoded independently.

    White-space chunks of ASCII and Latin-1 letters and ASCII punctuation (without
    the apostrophe, which starts contractions) are cut between letters and
    punctuation; no other chunk is cut. The normaliser composes characters, then
    lower-cases; lower-casing ASCII letters before makes fewer distinct units, and
    isn't done in chunks with further characters beyond ASCII, for a capital letter
    may compose otherwise with a mark that follows it. Special strings are case-sensitive, so a
    text that may hold one is left as it is.
    """
    low = scan.LOWER[raw]
    kind = _KIND[raw]
    n = len(raw)
    if n > 1:
        special = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
        kind[special] = _OTHER
        for d in np.unique(np.searchsorted(off, special, "right") - 1):
            low[off[d] : off[d + 1]] = raw[off[d] : off[d + 1]]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        letter = (raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)
        kind[lead[~letter]] = _OTHER
        kind[lead[letter] + 1] = _LETTER
    starts, ends, _ = scan.words(raw, off, scan.NOT_SPACE)
    other = np.zeros(n + 1, np.int64)
    np.cumsum(kind == _OTHER, out=other[1:])
    whole = other[ends] > other[starts]
    edges = np.zeros(n + 1, np.int32)
    edges[starts[whole]] += 1
    np.subtract.at(edges, ends[whole], 1)
    plain = np.cumsum(edges[:-1]) == 0
    foreign = np.zeros(n + 1, np.int64)
    np.cumsum((kind == _OTHER) & (raw >= 0x80), out=foreign[1:])
    for a, z in zip(starts[own := foreign[ends] > foreign[starts]].tolist(), ends[own].tolist(), strict=True):
        low[a:z] = raw[a:z]
    cut = np.zeros(n, bool)
    cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] != 0)
    cut &= plain
    cut[starts] = True
    first = np.flatnonzero(cut)
    chunk = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(np.append(first[1:], n), ends[chunk]) if len(first) else first
    return low, first, last, np.diff(np.searchsorted(first, off))


class UnitEncoder:
    """Token ids of whole texts. Each distinct unit is encoded once, until there are `MAX_UNITS` of them."""

    def __init__(self, file: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(file)
        self._model.no_truncation()
        self._model.no_padding()
        vocabulary = self._model.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self._number: dict[int, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._starts = np.zeros((1 << 14) + 1, np.int64)

    def _put(self, ids: np.ndarray, ends: np.ndarray) -> None:
        n, at = len(self._number), int(self._starts[len(self._number)])
        if at + len(ids) > len(self._ids):
            self._ids = np.resize(self._ids, 2 * (at + len(ids)))
        self._ids[at : at + len(ids)] = ids
        if n + len(ends) + 1 > len(self._starts):
            self._starts = np.resize(self._starts, 2 * (n + len(ends) + 1))
        self._starts[n + 1 : n + 1 + len(ends)] = at + ends

    def _learn(self, keys: list[int], parts: list[bytes]) -> None:
        words, rest = [], []
        for k, p in zip(keys, parts, strict=True):
            (words if _LETTERS.fullmatch(p) else rest).append((k, p))
        lines = [words[i : i + 1024] for i in range(0, len(words), 1024)]
        for i in range(0, len(lines), 16):
            texts = [b" ".join([p for _, p in line]).decode() for line in lines[i : i + 16]]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self._model.encode_batch_fast(texts, add_special_tokens=False)])
            some = [w for line in lines[i : i + 16] for w in line]
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(some):  # a word that isn't one pre-token: each by itself
                rest.extend(some)
                continue
            self._put(ids, ends)
            self._number.update(zip([k for k, _ in some], range(len(self._number), len(self._number) + len(some)), strict=True))
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            ids = [e.ids for e in self._model.encode_batch([p.decode() for _, p in some], add_special_tokens=False)]
            self._put(np.array([x for e in ids for x in e], np.uint32), np.cumsum([len(e) for e in ids]))
            self._number.update(zip([k for k, _ in some], range(len(self._number), len(self._number) + len(some)), strict=True))

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text's start and end."""
        low, starts, ends, counts = units(raw, off)
        keys, at, which = np.unique(scan.Prefix(low).of(starts, ends), return_index=True, return_inverse=True)
        if len(self._number) > MAX_UNITS:
            self._clear()
        asked = keys.tolist()
        found = list(map(self._number.get, asked))
        fresh = [i for i, n in enumerate(found) if n is None]
        if fresh:
            whole = low.tobytes()
            s, e = starts[at[fresh]].tolist(), ends[at[fresh]].tolist()
            self._learn([asked[i] for i in fresh], [whole[a:b] for a, b in zip(s, e, strict=True)])
            for i in fresh:
                found[i] = self._number[asked[i]]
        number = np.array(found, np.int64)[which]
        begin, size = self._starts[number], self._starts[number + 1] - self._starts[number]
        sums = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=sums[1:])
        ids = self._ids[np.arange(sums[-1]) + np.repeat(begin - sums[:-1], size)]
        per_text = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=per_text[1:])
        return ids, sums[per_text]


def power_of_two_cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, then the binary digits of the rest from the largest."""
    out, at = [], 0
    while n - at >= most:
        out.append((at, most))
        at += most
    bit = most >> 1
    while bit:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, most: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of length), and the ids if asked for.

    sequence_id orders by bucket: its upper bits are the bucket, the lower ones number the pieces.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("the length of a sequence must be a power of two")
    arrow_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _workers:
            _workers[tokenizer_file] = UnitEncoder(tokenizer_file)
        for b in batches:
            raw, off = scan.flatten(b.column("text"))
            for i, j in scan.chunks(off):
                row, start, length, crc, total, bodies = [], [], [], [], [], []
                tokens, at = _workers[tokenizer_file].encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                for k in range(j - i):
                    body = tokens[at[k] : at[k + 1]].astype("<u4").tobytes() + end
                    n = len(body) // 4
                    if with_ids:
                        bodies.append(body)
                    for s, size in power_of_two_cuts(n, most):
                        piece = body[4 * s : 4 * (s + size)]
                        row.append(i + k)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                long = lambda x: pa.array(x, pa.int64())
                cols = [b.column("id").take(long(row)), long(start), long(length), long(crc), long(total)]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    limits = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(limits), pa.array(np.frombuffer(b"".join(bodies), "<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    bucket = (F.length(F.bin("length")) - 1).cast("int")
    return pieces.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        F.shiftleft(bucket.cast("long"), 58).bitwiseOR(F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), bucket.alias("bucket"), *(["ids"] if with_ids else []),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
