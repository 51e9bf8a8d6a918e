"""Proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; sorting all
rows by fractional rank (rank + 1/2) / source size interleaves the sources in
proportion, and cutting that order into equal runs gives every shard the mixture
of the whole.

Both rankings are range sorts over many partitions with an offset for each
partition, so neither a hot source nor the whole table meets in one task.

Defined cases: a null text has no bytes (size 1, CRC of nothing, 0); a null
source is a source; null ids are kept; repeated rows are placed each for itself,
in any order among themselves; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm.shared import Table, write

_ROW_BITS = 33


def ordered(df: DataFrame, *keys: str) -> tuple[Table, DataFrame, int]:
    """The rows in a total order: a written table in it, its rows with `place` (gapless from 0), and their number."""
    spark = df.sparkSession
    table = write(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_row", _ROW_BITS)
    # one count for each partition of the sort, however many rows there are
    counts = sorted((r["p"], r["n"]) for r in table.df.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    starts = spark.createDataFrame(offsets, "_part long, _start long")
    rows = table.df.withColumn("_part", part).join(F.broadcast(starts), "_part")
    place = F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return table, rows.withColumn("place", place).drop("_row", "_part", "_start"), total


def interleave(df: DataFrame, n_shards: int, seed: int, source_col: str = "source", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows with `shard` and `slot` (gapless from 0 in each shard), in place of columns of these names; shard sizes differ by one at most."""
    key = F.struct(*key_cols).alias("key")
    work = df.select(F.struct(*df.columns).alias("row"), key, F.xxhash64(F.lit(seed), *key_cols).alias("shuffled"), F.col(source_col).alias("stratum"))
    by_source, ranked, total = ordered(work, "stratum", "shuffled", "key")
    sizes = ranked.groupBy("stratum").agg(F.min("place").alias("first"), F.count("*").alias("size")).withColumnRenamed("stratum", "of")
    joined = ranked.join(sizes, F.col("stratum").eqNullSafe(F.col("of")))
    frac = ((F.col("place") - F.col("first") + 0.5) / F.col("size")).alias("frac")
    # equal fractions of different sources fall in seeded order
    mixed, placed, _ = ordered(joined.select("row", "key", "shuffled", frac), "frac", "shuffled", "key")
    by_source.drop()
    shard = F.expr(f"place * {n_shards} div {max(total, 1)}")
    start = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in ("shard", "slot")]
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("place") - start).select(*kept, "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return interleave(rows, n_shards=8, seed=17, key_cols=("doc_id", "text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
