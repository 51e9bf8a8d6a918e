"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger keeps the
measurements and one bit for each failed rule; policies are versioned bit masks
over it, and ablations are aggregations of its bits. Changing a policy never
reads a text again.

Words are the maximal runs of characters other than white space
``[\\x20\\x09-\\x0D]``, compared as they stand.

Defined cases: a null or empty text has no words, measures 0 everywhere and
fails `few_words`; a null id is kept; each row stands for itself, so repeated
rows repeat; an empty table gives no rows; further columns are ignored; texts of
any length are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lagoon.llm import scan
from lagoon.llm.shared import arrow_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NOT_TAIL = np.array([b & 0xC0 != 0x80 for b in range(256)])
WINDOW = 5

#: Each rule as a condition under which a document fails, in integer arithmetic; a rule's bit is its place here and never changes.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
#: The rules that each version of the policy enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "short_words", "long_words"),
}


def mask_of(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def _per_document(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def _equal_to_other(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs again, and the places beyond the first of each key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    any_ = np.zeros(len(keys), bool)
    any_[order[1:][same]] = True
    later = np.flatnonzero(any_)
    any_[order[:-1][same]] = True
    return np.flatnonzero(any_), later


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    starts, ends, counts = scan.words(buf, off, scan.NOT_SPACE)
    doc = np.repeat(np.arange(n), counts)
    out = {"n_words": counts}
    solid = scan.NOT_SPACE[buf]
    out["word_chars"] = _per_document(solid & _NOT_TAIL[buf], off)
    out["n_symbols"] = _per_document(_SYMBOL[buf], off)
    prefix = scan.Prefix(buf)
    salt = scan.mix(np.arange(n, dtype=np.uint64) + np.uint64(77))

    breaks = np.flatnonzero(buf == 10)
    line_start = np.sort(np.concatenate([off[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([breaks, off[1:]]))
    line_doc = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, off)) + 1)
    filled = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(solid, out=filled[1:])
    with_word = filled[line_end] > filled[line_start]
    line_start, line_end, line_doc = line_start[with_word], line_end[with_word], line_doc[with_word]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    _, later = _equal_to_other(prefix.of(line_start, line_end) ^ salt[line_doc])
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)

    grams, whole = scan.ngrams(prefix.of(starts, ends), counts, WINDOW)
    at = np.flatnonzero(whole)
    repeated, _ = _equal_to_other(grams[at] ^ salt[doc[at]])
    covered = np.zeros(len(starts), bool)
    for j in range(WINDOW):
        covered[at[repeated] + j] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return out


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The id (or, to carry, a struct `row` of all columns) and `MEASURES` of each row."""
    arrow_batches(docs.sparkSession)
    columns = docs.columns if carry else list(dict.fromkeys([id_col, text_col]))
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column("row")
            buf, off = scan.flatten(row.field(place))
            told = row if carry else row.field(columns.index(id_col))
            for i, j in scan.chunks(off):
                part = measure(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([told.slice(i, j - i), *(pa.array(part[m].astype(np.int64)) for m in MEASURES)], names=["row", *MEASURES])

    rows = docs.select(F.struct(*columns).alias("row"))
    first = rows.schema["row"] if carry else StructField("row", docs.schema[id_col].dataType)
    schema = StructType([first, *(StructField(m, LongType()) for m in MEASURES)])
    measured = rows.mapInArrow(run, schema)
    return measured if carry else measured.withColumnRenamed("row", id_col)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Measurements and `failed`, a bit for each rule that a document fails."""
    bits: Column = F.lit(0).cast("long")
    for k, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs, id_col, text_col, carry).withColumn("failed", bits)


def apply_policy(marked: DataFrame, policy: str, into: str = "kept") -> DataFrame:
    return marked.withColumn(into, F.col("failed").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0)


def ablations(marked: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_only): how many documents fail each rule of a policy, and how many it alone rejects."""
    within = F.col("failed").bitwiseAND(F.lit(mask_of(policy)).cast("long"))
    patterns = marked.groupBy(within.alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]))
    return (
        patterns.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "v1")
    base = F.col("failed").bitwiseAND(F.lit(mask_of("base")).cast("long")) != 0
    return marked.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")
