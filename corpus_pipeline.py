"""Documents to packed training sequences, in stages that each read what the one before has written.

1. quality: documents that fail the policy go.
2. near_dedup: of documents whose five-word shingles have a Jaccard similarity of
   0.8 or more, the one with the least id stays.
3. suffix_dedup: byte strings of 200 that occur more than once in what is left are
   cut out of the texts; a character that is cut in two goes as a whole.
4. decontaminate: documents that hold a benchmark item go.
5. packing: texts become token pieces of power-of-two lengths, one sequence each.

Null texts fail the quality rules, so only stages that are used alone meet them; an
empty table stays empty. All stages but the last keep the columns of documents,
and n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm import decontaminate, minhash, packing, quality, repeats
from lagoon.llm.shared import write

#: SQL can't express tokenising, nor the latent search.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(docs, carry=True), "v1").where("kept").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, width=5, percent=80)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(docs, 200)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, _ = decontaminate.marked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("matches") == 0).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        now = write(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
