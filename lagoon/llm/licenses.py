"""Search for licence notices.

Exact phrases are found as consecutive words. Short notices are found with up to
k edits: a notice is split into k + 1 seeds, one of which must stand unchanged in
any text within k edits of it (pigeonhole); where a seed occurs, the regex
library's bounded-error matching verifies the surroundings and reports the span.
Of neighbouring candidates those of fewest edits are taken first, then those of
more in the gaps that are left, so no place is lost to a better one beside it.

Texts are lower-cased (A-Z only); words are the maximal runs of ASCII digits and
letters and of non-ASCII characters.

Defined cases: a null or empty text has no words, no labels and score 0; a null
id is kept; repeated rows repeat; an empty table gives no rows; further columns
are ignored; texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm import scan
from lagoon.llm.shared import arrow_batches

#: Phrase and label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices in lower case, and their labels.
NOTICES = (
    ("licensed under the apache license", "apache"),
    ("under the terms of the gnu general public license", "gpl"),
    ("released under the mit license", "mit"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("permission is hereby granted, free of charge", "mit"),
    ("this program is free software", "gpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
)


def edits_allowed(notice: str) -> int:
    return max(2, len(notice) // 10)


def seeds(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces and their places; with at most k edits, one of them is untouched."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class FuzzyNotices:
    def __init__(self, notices=NOTICES) -> None:
        import regex

        self._rules = []
        for text, label in notices:
            k = edits_allowed(text)
            self._rules.append((text, label, k, seeds(text, k), [regex.compile(f"(?:{regex.escape(text)}){{e<={e}}}") for e in range(k + 1)]))

    def find(self, low: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, share of the notice that isn't edited), by notice and place, of the places where a notice stands with few enough edits.

        Of overlapping places of one notice the best is reported, the first of equals; what is before and after it is searched in turn.
        """
        out = []
        for text, label, k, parts, patterns in self._rules:
            near = []
            for at, seed in parts:
                p = low.find(seed)
                while p >= 0:
                    near.append((max(0, p - at - k), min(len(low), p - at + len(text) + k)))
                    p = low.find(seed, p + 1)
            near.sort()
            for i, (a, b) in enumerate(near):
                if i + 1 < len(near) and near[i + 1][0] <= b:
                    near[i + 1] = (a, max(b, near[i + 1][1]))
                    continue
                for start, end, edits in sorted(self._matches(patterns, low, a, b, len(text) - k)):
                    out.append((label, start, end, edits, max(0.0, 1 - edits / len(text))))
        return out

    @staticmethod
    def _matches(patterns: list, low: str, a: int, b: int, least: int) -> list[tuple[int, int, int]]:
        """Fewest edits first, and of those from left to right, always in the gaps that are left."""
        out, gaps = [], [(a, b)]
        for edits, pattern in enumerate(patterns):
            rest = []
            for a, b in gaps:
                for m in pattern.finditer(low, a, b):
                    out.append((m.start(), m.end(), edits))
                    rest.append((a, m.start()))
                    a = m.end()
                rest.append((a, b))
            gaps = [(a, b) for a, b in rest if b - a >= least]
        return out


def phrase_places(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Word counts, and for each phrase the documents and word places where it stands."""
    starts, ends, counts = scan.words(buf, off, scan.ALNUM)
    hashes = scan.Prefix(buf).of(starts, ends)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    docs, places = [], []
    for phrase, _ in PHRASES:
        parts = [p.encode() for p in phrase.split()]
        n = len(parts)
        hit = np.zeros(0, np.int64)
        if len(hashes) >= n:
            ok = doc[: len(doc) - n + 1] == doc[n - 1 :]
            for j, p in enumerate(parts):
                raw = np.frombuffer(p, np.uint8)
                ok &= hashes[j : len(hashes) - n + 1 + j] == scan.Prefix(raw).of(np.array([0]), np.array([len(raw)]))[0]
            hit = np.array([i for i in np.flatnonzero(ok) if all(buf[starts[i + j] : ends[i + j]].tobytes() == p for j, p in enumerate(parts))], np.int64)
        docs.append(doc[hit])
        places.append(hit - first[doc[hit]] if len(hit) else hit)
    return counts, docs, places


SPANS = "array<struct<label:string,start:long,end:long,edits:long>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, fuzzy_spans (code points in the text), labels, score.

    The score is 1 where a phrase stands exactly, else the share of a notice's characters that its best match leaves unedited, else 0.
    """
    arrow_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fuzzy = FuzzyNotices()
        for b in batches:
            raw, off = scan.flatten(b.column("text"))
            for i, j in scan.chunks(off):
                buf = scan.LOWER[raw[off[i] : off[j]]]
                own = off[i : j + 1] - off[i]
                counts, docs_of, places = phrase_places(buf, own)
                base: list[list[tuple[int, str]]] = [[] for _ in range(j - i)]
                for (_, label), ds, ps in zip(PHRASES, docs_of, places, strict=True):
                    for d, p in zip(ds.tolist(), ps.tolist(), strict=True):
                        base[d].append((p, label))
                cols: dict[str, list] = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "fuzzy_spans")}
                for d in range(j - i):
                    spans = fuzzy.find(buf[own[d] : own[d + 1]].tobytes().decode())
                    exact = {label for _, label in base[d]}
                    cols["n_base"].append(len(base[d]))
                    cols["first_word"].append(min((p for p, _ in base[d]), default=None))
                    cols["last_word"].append(max((p for p, _ in base[d]), default=None))
                    cols["base_labels"].append(",".join(sorted(exact)))
                    cols["labels"].append(",".join(sorted(exact | {x[0] for x in spans})))
                    cols["score"].append(1.0 if exact else max((x[4] for x in spans), default=0.0))
                    cols["fuzzy_spans"].append([dict(zip(("label", "start", "end", "edits"), x, strict=False)) for x in spans])
                long, text = pa.int64(), pa.string()
                kinds = {"n_base": long, "first_word": long, "last_word": long, "base_labels": text, "labels": text, "score": pa.float64(), "fuzzy_spans": pa.list_(pa.struct([("label", text), ("start", long), ("end", long), ("edits", long)]))}
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(counts.astype(np.int64)), *(pa.array(v, kinds[k]) for k, v in cols.items())], names=["id", "n_words", *cols])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, fuzzy_spans {SPANS}"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("fuzzy_spans").cast("long").alias("n_fuzzy"), "fuzzy_spans")
