"""Toxic spans by a linear-chain conditional random field.

Each word of a text is inside (T) or outside (O) of a toxic span. A word's score
for T comes from its identity and its first letters, and neighbouring states from
four transition weights. Words of labelled toxic documents are labelled T where
the log odds of a toxic document are 1 or more and hardly due to chance; on these labelled
tokens the weights are learnt by maximum likelihood. Forward-backward marginals
give the words of toxic spans and, summed and at their greatest, the score of a
document through a logistic function learnt on the documents' labels.

With two states, forward and backward messages are ratios, and a word maps one
ratio to the next by a 2 x 2 matrix. A batch of texts is one chain that starts
anew at each text, cut into lanes of `LANE` words: the product of each lane, then
the ratios at the lanes' ends, then all lanes at once.

Training reads a bounded sample: at most `MAX_TOXIC` toxic and `MAX_CLEAN` other
documents, the first by hash of their id, of at most `MAX_TRAIN_CHARS` characters
each. Every document is scored, as a whole.

Words are the maximal runs of ASCII digits and letters (lower-cased) and of
non-ASCII characters.

Defined cases: a null or empty text, or one without words, has no spans and the
score of no evidence; null ids are kept and never train; repeated rows repeat; of
contradictory labels the greater counts; labels that are null are no labels.
Without labels of both kinds nothing is learnt and every score is 0. An empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm import scan
from lagoon.llm.shared import arrow_batches

MAX_TOXIC, MAX_CLEAN, MAX_TRAIN_CHARS = 1200, 2400, 20_000
LANE = 64
PREFIX_BYTES = 5
STEPS = 60
#: Nats of evidence that make a word of toxic documents a labelled token; e**-10 of all other words would reach it by chance.
EVIDENCE = 10.0
#: Words below this probability don't add to a document's score, however many there are.
FAINT = 0.2


@dataclass
class Model:
    """Feature hashes in order with their weights, the score of a word without any, start and transition weights, and the logistic function of a document."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    start: float
    transition: np.ndarray
    document: np.ndarray


def word_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, words per document, and hashes of each word and of its first letters."""
    low = scan.LOWER[buf]
    starts, ends, counts = scan.words(low, off, scan.ALNUM)
    prefix = scan.Prefix(low)
    heads = scan.mix(prefix.of(starts, np.minimum(ends, starts + PREFIX_BYTES)) + np.uint64(1))
    return starts, ends, counts, prefix.of(starts, ends), heads


def _lookup(features: np.ndarray, weights: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(features):
        return np.zeros(len(asked))
    # most words have no weight: a table of 16 bits of the hash sets them aside before the search
    short = np.zeros(1 << 16, bool)
    short[features >> np.uint64(48)] = True
    out = np.zeros(len(asked))
    maybe = np.flatnonzero(short[asked >> np.uint64(48)])
    at = np.minimum(np.searchsorted(features, asked[maybe]), len(features) - 1)
    hit = features[at] == asked[maybe]
    out[maybe[hit]] = weights[at[hit]]
    return out


def _messages(up: np.ndarray, reset: np.ndarray, start: float, a: np.ndarray) -> np.ndarray:
    """Ratio of the forward messages of T and O at each word; up = exp(score), a[i, j] = exp(transition from i to j)."""
    n = len(up)
    lanes = -(-n // LANE)
    pad = lanes * LANE - n
    u = np.concatenate([up, np.ones(pad)]).reshape(lanes, LANE).T.copy()
    r = np.concatenate([reset, np.ones(pad, bool)]).reshape(lanes, LANE).T.copy()
    oo, ot, to, tt = np.where(r, 1.0, a[0, 0]), np.where(r, start, a[0, 1]) * u, np.where(r, 1.0, a[1, 0]), np.where(r, start, a[1, 1]) * u
    p = [np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)]
    for t in range(LANE):
        p = [p[0] * oo[t] + p[1] * to[t], p[0] * ot[t] + p[1] * tt[t], p[2] * oo[t] + p[3] * to[t], p[2] * ot[t] + p[3] * tt[t]]
        total = p[0] + p[1] + p[2] + p[3]
        p = [x / total for x in p]
    begin, ratio = [], 1.0
    for q0, q1, q2, q3 in zip(*(x.tolist() for x in p), strict=True):
        begin.append(ratio)
        ratio = (q1 + ratio * q3) / (q0 + ratio * q2)
    now = np.array(begin)
    out = np.empty((LANE, lanes))
    for t in range(LANE):
        now = (ot[t] + now * tt[t]) / (oo[t] + now * to[t])
        out[t] = now
    return out.T.ravel()[:n]


def marginals(scores: np.ndarray, counts: np.ndarray, start: float, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of T at each word, and the forward and backward ratios that it comes from."""
    n = len(scores)
    if not n:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    ends = np.cumsum(counts)
    first = np.zeros(n, bool)
    last = np.zeros(n, bool)
    first[(ends - counts)[counts > 0]] = True
    last[ends[counts > 0] - 1] = True
    up, a = np.exp(np.clip(scores, -30, 30)), np.exp(transition)
    forward = _messages(up, first, float(np.exp(start)), a)
    # backward: the same recursion from the other end with the transposed transitions, without the word's own score
    mirrored = _messages(up[::-1], last[::-1], 1.0, a.T)[::-1]
    backward = mirrored / up
    odds = forward * backward
    return odds / (1 + odds), forward, backward


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _greatest(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts))
    full = counts > 0
    if full.any():
        out[full] = np.maximum.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


def _evidence(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(counts)), np.log1p(_sums(np.where(p >= FAINT, p, 0.0), counts)), _greatest(p, counts)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _adam(x: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m = np.zeros_like(x)
    v = np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


@dataclass
class Chain:
    """Labelled tokens: of each its word, its first letters and whether it starts a text and is T; and how many texts, words and first letters there are."""

    word: np.ndarray
    head: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    y: np.ndarray
    n_word: int
    n_head: int

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Weights of words, of first letters, (bias, start) and transitions."""
        return x[: self.n_word], x[self.n_word : self.n_word + self.n_head], x[-6:-4], x[-4:].reshape(2, 2)

    def gradient(self, x: np.ndarray) -> np.ndarray:
        """Of the negative log likelihood of the labels."""
        w, h, (bias, start), transition = self.parts(x)
        p, forward, _ = marginals(w[self.word] + h[self.head] + bias, self.counts, start, transition)
        inner = np.flatnonzero(~self.first)
        before, now = self.y[inner - 1], self.y[inner]
        seen = np.array([[np.sum(~before & ~now), np.sum(~before & now)], [np.sum(before & ~now), np.sum(before & now)]], float)
        g = np.zeros_like(x)
        wrong = p - self.y
        g[: self.n_word] = np.bincount(self.word, weights=wrong, minlength=self.n_word)
        g[self.n_word : self.n_word + self.n_head] = np.bincount(self.head, weights=wrong, minlength=self.n_head)
        g[-6] = wrong.sum()
        g[-5] = wrong[self.first].sum()
        # of the pair (T, T): P(T at t) * P(T before | T at t), which needs only the forward ratio
        a, ratio = np.exp(transition), forward[inner - 1]
        tt = p[inner] * ratio * a[1, 1] / (a[0, 1] + ratio * a[1, 1])
        ot, to = p[inner] - tt, p[inner - 1] - tt
        expected = np.array([[len(inner) - tt.sum() - ot.sum() - to.sum(), ot.sum()], [to.sum(), tt.sum()]])
        g[-4:] = (expected - seen).ravel()
        return g


def train(texts: list[str], toxic: list[int]) -> Model | None:
    """None without documents of both kinds."""
    y_doc = np.array(toxic, bool)
    if not y_doc.any() or y_doc.all():
        return None
    buf, off = scan.flatten(pa.array(texts, pa.string()))
    parts = [word_features(buf[off[i] : off[j]], off[i : j + 1] - off[i])[2:] for i, j in scan.chunks(off)]
    counts, words, heads = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc = np.repeat(np.arange(len(counts)), counts)

    first = np.zeros(len(words), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True

    # labelled tokens: words of toxic documents that are far likelier in toxic ones; copies of a place (a word between the same two) count once, and so do many places in one document
    names, word = np.unique(words, return_inverse=True)
    before = np.where(first, np.uint64(0), np.roll(words, 1))
    after = np.where(np.roll(first, -1), np.uint64(0), np.roll(words, -1))
    place = scan.mix(scan.mix(words + scan.mix(before)) + after)
    toxic_at = np.unique(place[y_doc[doc]], return_index=True)[1]
    clean_at = np.unique(place[~y_doc[doc]], return_index=True)[1]
    pairs = np.unique(word[y_doc[doc]].astype(np.int64) * len(counts) + doc[y_doc[doc]])
    in_toxic = np.minimum(np.bincount(word[y_doc[doc]][toxic_at], minlength=len(names)), np.bincount(pairs // len(counts), minlength=len(names)))
    in_clean = np.bincount(word[~y_doc[doc]][clean_at], minlength=len(names))
    odds = np.log((in_toxic + 0.5) / (len(toxic_at) + 1)) - np.log((in_clean + 0.5) / (len(clean_at) + 1))
    # evidence in nats that a word isn't dealt to toxic and other places like all words
    share, both = len(toxic_at) / (len(toxic_at) + len(clean_at)), in_toxic + in_clean
    seen = np.clip(in_toxic / np.maximum(both, 1), 1e-9, 1 - 1e-9)
    evidence = both * (seen * np.log(seen / share) + (1 - seen) * np.log((1 - seen) / (1 - share)))
    y = ((odds >= 1) & (evidence >= EVIDENCE))[word] & y_doc[doc]

    head_names, head = np.unique(heads, return_inverse=True)
    n_word, n_head = len(names), len(head_names)
    chain = Chain(word, head, counts, first, y, n_word, n_head)
    n = max(1, len(words))

    def gradient(x: np.ndarray) -> np.ndarray:
        return chain.gradient(x) / n * 1000 + decay * x

    x = np.zeros(n_word + n_head + 6)
    decay = np.full(len(x), 1e-3)
    decay[n_word : n_word + n_head] = 0.05  # first letters are shared by many words and are trusted less
    x[-6] = -3.0
    x = _adam(x, gradient, STEPS, 0.25)
    w, h, (bias, start), transition = chain.parts(x)
    p, _, _ = marginals(w[word] + h[head] + bias, counts, start, transition)
    z = _evidence(p, counts)
    document = _adam(np.array([-2.0, 1.0, 1.0]), lambda c: z.T @ (_sigmoid(z @ c) - y_doc) / len(y_doc) + 1e-4 * c, 600, 0.05)

    hashes, weights = np.concatenate([names, head_names]), np.concatenate([w, h])
    strong = np.abs(weights) >= 0.05
    order = np.argsort(hashes[strong])
    return Model(hashes[strong][order], weights[strong][order], float(bias), float(start), transition, document)


def score_texts(model: Model, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """The score of each text, and its toxic spans in code points."""
    starts, ends, counts, words, heads = word_features(buf, off)
    scores = _lookup(model.features, model.weights, words) + _lookup(model.features, model.weights, heads) + model.bias
    p, _, _ = marginals(scores, counts, model.start, model.transition)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(off) - 1)]
    inside = np.flatnonzero(p >= 0.5)
    if len(inside):
        doc = np.repeat(np.arange(len(counts)), counts)[inside]
        edge = np.ones(len(inside) + 1, bool)
        edge[1:-1] = (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1] + 1)
        heads_of = np.concatenate([[0], np.cumsum(buf & 0xC0 != 0x80)])
        for k, e in zip(np.flatnonzero(edge[:-1]).tolist(), np.flatnonzero(edge[1:]).tolist(), strict=True):
            d = int(doc[k])
            base = heads_of[off[d]]
            spans[d].append((int(heads_of[starts[inside[k]]] - base), int(heads_of[ends[inside[e]]] - base)))
    return _sigmoid(_evidence(p, counts) @ model.document), spans


def bounded_sample(docs: DataFrame, labels: DataFrame, may_train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels to train on; `may_train` is a condition on the id."""
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64("id")
    asked = labelled.where(may_train)
    picked = asked.where("label > 0").orderBy(order, "id").limit(MAX_TOXIC).unionByName(asked.where("label = 0").orderBy(order, "id").limit(MAX_CLEAN))
    ids = {r["id"]: int(r["label"] > 0) for r in picked.collect()}
    if not ids:
        return [], []
    asked_ids = docs.sparkSession.createDataFrame([(i,) for i in ids], f"id {docs.schema[id_col].dataType.simpleString()}")  # at most MAX_TOXIC + MAX_CLEAN
    found = docs.where(F.length(text_col) <= MAX_TRAIN_CHARS).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(asked_ids), "id")
    rows = found.groupBy("id").agg(F.min("text").alias("text")).orderBy("id").collect()
    return [r["text"] for r in rows], [ids[r["id"]] for r in rows]


def toxic_scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) for each row."""
    arrow_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            buf, off = scan.flatten(b.column("text"))
            for i, j in scan.chunks(off):
                if model is None:
                    score, spans = np.zeros(j - i), [[]] * (j - i)
                else:
                    score, spans = score_texts(model, buf[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(score), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind)], names=["id", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, score double, spans array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    model = train(*bounded_sample(docs, labels, fold("id") != 0))
    held_out = F.coalesce(fold("doc_id") == 0, F.lit(False))
    return toxic_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"), "spans")
