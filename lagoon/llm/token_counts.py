"""Token counts without token ids.

The vocabulary has no piece in which a space follows another character, so no
merge crosses the start of a run of spaces: a text falls into pre-tokens (a
run of spaces and the characters after it) that are encoded independently.

1. Frequent pre-tokens: each task counts the pre-tokens of all its texts and hands
   on the `HOT` most frequent ones; the `HOT` most frequent of all, of at most
   `HOT_BYTES` bytes, go to every task with their piece counts, whatever the corpus.
2. Each document's pre-token frequencies: the frequent ones are joined and summed at
   once; (document, pre-token, frequency) rows of the others are dealt by pre-token.
3. There each distinct pre-token's pieces are counted once for all of its rows, which
   stand together, and the products are summed by document.

What is frequent only decides the way of a row, never a count; no key of the shuffle
is hot, and few rows move.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null id is
kept; rows are independent, so repeated rows repeat their counts; an empty
table gives no rows; further columns are ignored; a text of any length is
counted whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm.shared import Table, arrow_batches, write

HOT, HOT_BYTES = 1 << 19, 48
#: Pre-tokens that a task counts together before it hands them on.
MAX_PRETOKENS = 500_000
_SPLIT = re.compile(" *[^ ]+| +")
_workers: dict[str, "PieceCounter"] = {}


def pretokens(text: str | None) -> list[str]:
    """The space before the text is the one that the library itself puts there."""
    return _SPLIT.findall(" " + text.replace("▁", " ")) if text else []


class PieceCounter:
    """Counts sentencepiece BPE pieces of pre-tokens."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        crossing = [p for p in map(self._model.id_to_piece, range(self._model.get_piece_size())) if re.search("[^▁]▁", p)]
        if crossing:
            raise ValueError(f"pieces with inner spaces, so pre-tokens are not independent: {crossing[:5]}")

    def count(self, parts: list[str]) -> list[int]:
        """A lone space, at the end of a text, is one piece; encoded by itself it would be the empty text."""
        return [1 if p == " " else len(ids) for p, ids in zip(parts, self._model.encode([p[1:] for p in parts], num_threads=1), strict=True)]


def _frequent(texts: DataFrame) -> DataFrame:
    """(p, n) of the pre-tokens that are frequent in some task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(pretokens(t))
                if len(seen) > MAX_PRETOKENS:
                    yield made(seen)
                    seen = Counter()
        yield made(seen)

    def made(seen: Counter) -> pa.RecordBatch:
        top = seen.most_common(HOT // 4)
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["p", "n"])

    return texts.mapInArrow(run, "p string, n long").where(F.octet_length("p") <= HOT_BYTES).groupBy("p").agg(F.sum("n").alias("n"))


def _hottest(frequent: Table, model_file: str) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens; of the last power of two that is among them, any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("p"), pa.array(_counter(model_file).count(b.column("p").to_pylist()), pa.int32())], names=["p", "pieces"])

    sized = frequent.df.select("p", F.length(F.bin("n")).alias("size"))
    room, last = HOT, 0
    for size, n in sorted(map(tuple, sized.groupBy("size").count().collect()), reverse=True):  # 63 rows
        if n > room:
            last = size
            break
        room -= n
    picked = sized.where(F.col("size") > last).unionByName(sized.where(F.col("size") == last).limit(room)).select("p")
    found = picked.mapInArrow(run, "p string, pieces int").toArrow()  # `HOT` rows at most
    return dict(zip(found.column("p").to_pylist(), found.column("pieces").to_pylist(), strict=True))


def _counter(model_file: str) -> PieceCounter:
    if model_file not in _workers:
        _workers[model_file] = PieceCounter(model_file)
    return _workers[model_file]


def _products(cells: DataFrame, model_file: str) -> DataFrame:
    """(row, n) of cells (row, p, n): the tokens of each; equal pre-tokens stand together and are counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, int] | None = None
        for b in batches:
            runs = pc.run_end_encode(b.column("p"))
            parts, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            again = bool(parts) and last is not None and parts[0] == last[0]
            pieces = ([last[1]] if again else []) + _counter(model_file).count(parts[again:])
            if parts:
                last = parts[-1], pieces[-1]
            n = b.column("n").to_numpy() * np.repeat(np.array(pieces, np.int64), np.diff(ends, prepend=0))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n)], names=["row", "n"])

    return cells.repartition("p").sortWithinPartitions("p").mapInArrow(run, "row long, n long")


def piece_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for each row."""
    arrow_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    frequent = write(_frequent(docs.select(F.col(text_col).alias("text"))), "frequent")
    hot = _hottest(frequent, model_file)
    frequent.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("p", pa.string()), ("n", pa.int64())]))
        for b in batches:
            known, rest = [], []
            for t in b.column("text").to_pylist():
                f = Counter(pretokens(t))
                pieces = list(map(hot.get, f))
                if None in pieces:
                    known.append(sum(k * n for k, n in zip(pieces, f.values(), strict=True) if k is not None))
                    rest.append([{"p": p, "n": n} for k, (p, n) in zip(pieces, f.items(), strict=True) if k is None])
                else:
                    known.append(sum(map(mul, pieces, f.values())))
                    rest.append([])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("n_bytes"), pa.array(known, pa.int64()), pa.array(rest, kind)], names=["row", "id", "n_bytes", "known", "rest"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    mine = write(rows.mapInArrow(run, f"row long, id {id_type}, n_bytes long, known long, rest array<struct<p:string,n:long>>"), "frequencies").df
    cells = mine.select("row", F.explode("rest").alias("e")).select("row", "e.*")
    more = _products(cells, model_file).groupBy("row").agg(F.sum("n").alias("more"))
    out = mine.select("row", "id", "n_bytes", "known").join(more, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = piece_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
