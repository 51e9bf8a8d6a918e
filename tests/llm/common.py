"""Documents with the odd cases that every operator must stand, and plain implementations to compare with."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("id", "th", "spans", "n", "root", "text_hash", "kept", "matches", "row", "_hash", "_spans", "n_words", "failed", "shard", "slot", "place", "a", "b", "at", "kept_text", "word_chars", "length", "bucket")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(r.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(f"new{r.random():.6f}" if r.random() < share else w for w in text.split(" "))


def odd_rows() -> list[tuple]:
    base, shared = prose(1, 300), prose(2, 70)
    texts: list[tuple[int | None, str | None]] = [
        (1, base), (2, base), (3, base.upper()), (4, edited(base, 4, 0.02)), (5, edited(base, 5, 0.045)), (6, edited(base, 6, 0.3)),
        (7, None), (8, ""), (9, " \n\t "), (10, "one two three"), (11, "one two three"), (12, "a b c d"),
        (13, prose(13, 200) + "\n" + shared + "\n" + prose(14, 50)), (14, prose(15, 20) + " " + shared), (15, prose(16, 6000)),
        (16, "same line\n" * 40), (17, "é" * 250), (18, "###$$$ %%% ||| &&&\n" * 5), (None, prose(18, 40)), (None, prose(18, 40)), (None, None),
        (20, prose(20, 30)), (20, prose(20, 30)), (20, prose(21, 30)), (21, "</s><s>[INST] <|endoftext|> <|ENDOFTEXT|> it's 3.14 don't İß"), (22, "x\x00y \x85 z　w\r\n▁▁ end  "), (23, "word " * 300),
        (24, "a×b n×m matrix, x÷y ab× ÷2 É×é"),
    ]
    return [(i, t, "en", "src0" if k % 3 else None, None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


def odd_docs(spark, clashes: bool = False):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHES)) if clashes else df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
