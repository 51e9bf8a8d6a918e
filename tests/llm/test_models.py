"""Toxicity and decontamination."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lagoon.llm import decontaminate, toxicity
from tests.llm.common import edited, empty_docs, odd_docs, prose


def test_marginals_match_a_plain_chain():
    r = np.random.default_rng(4)
    counts = np.array([3, 0, 1, 65, 200, 2])
    scores, start, transition = r.normal(0, 2, counts.sum()), 0.7, r.normal(0, 1, (2, 2))
    p, _, _ = toxicity.marginals(scores, counts, start, transition)
    at, want = 0, []
    for n in counts:
        u = scores[at : at + n]
        at += n
        f, b = np.zeros((n, 2)), np.ones((n, 2))
        for t in range(n):
            f[t] = [1, np.exp(start + u[0])] if t == 0 else (f[t - 1] @ np.exp(transition)) * [1, np.exp(u[t])]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = np.exp(transition) @ ([1, np.exp(u[t + 1])] * b[t + 1])
            b[t] /= b[t].sum()
        m = f * b
        want.extend(m[:, 1] / m.sum(axis=1))
    assert np.abs(p - want).max() < 1e-12


def _plain_loss(chain, x):
    """Negative log likelihood of the labels, path by path scores summed with a plain forward pass."""
    w, h, (bias, start), transition = chain.parts(x)
    scores, at, loss = w[chain.word] + h[chain.head] + bias, 0, 0.0
    for n in chain.counts:
        u, y = scores[at : at + n], chain.y[at : at + n].astype(int)
        at += n
        if not n:
            continue
        path = (start + u[0]) * y[0] + sum(u[t] * y[t] + transition[y[t - 1], y[t]] for t in range(1, n))
        f = np.array([0.0, start + u[0]])
        for t in range(1, n):
            f = np.array([np.logaddexp(f[0] + transition[0, k], f[1] + transition[1, k]) + u[t] * k for k in (0, 1)])
        loss += np.logaddexp(*f) - path
    return loss


def test_gradient_against_differences():
    r = np.random.default_rng(7)
    counts = np.array([4, 0, 1, 70, 12])
    n = int(counts.sum())
    first = np.zeros(n, bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    chain = toxicity.Chain(r.integers(0, 6, n), r.integers(0, 3, n), counts, first, r.random(n) < 0.3, 6, 3)
    x, step = r.normal(0, 1, 6 + 3 + 6), 1e-5
    want = [(_plain_loss(chain, x + step * e) - _plain_loss(chain, x - step * e)) / (2 * step) for e in np.eye(len(x))]
    assert np.abs(chain.gradient(x) - want).max() < 1e-6


def test_document_scores_against_a_plain_chain():
    """A document's score from word by word marginals, of the whole text."""
    texts, labels = _labelled(200)
    model = toxicity.train(texts, labels)
    for t in (texts[0], texts[1], "rotten " * 300, ""):
        buf, off = toxicity.scan.flatten(pa.array([t]))
        _, _, counts, words, heads = toxicity.word_features(buf, off)
        known = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
        u = [known.get(a, 0.0) + known.get(b, 0.0) + model.bias for a, b in zip(words.tolist(), heads.tolist(), strict=True)]
        a, f, b = np.exp(model.transition), [], [np.ones(2)]
        for t_, s in enumerate(u):
            now = (np.array([1, np.exp(model.start)]) if t_ == 0 else f[-1] @ a) * [1, np.exp(s)]
            f.append(now / now.sum())
        for s in u[:0:-1]:
            back = a @ ([1, np.exp(s)] * b[-1])
            b.append(back / back.sum())
        p = [x[1] / x.sum() for x in (x * y for x, y in zip(f, reversed(b), strict=False))] if u else []
        z = [1.0, np.log1p(sum(x for x in p if x >= toxicity.FAINT)), max(p, default=0.0)]
        assert abs(toxicity.score_texts(model, buf, off)[0][0] - 1 / (1 + np.exp(-np.dot(z, model.document)))) < 1e-9


def _labelled(n):
    r = random.Random(6)
    texts, labels = [], []
    for i in range(n):
        words = prose(i, 60).split(" ")
        if i % 4 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vilest", "rotten", "wretch"]))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_spans_and_scores(spark):
    model = toxicity.train(*_labelled(200))
    rows = [(1, "A calm é text."), (2, "You Rotten wretch, é vilest of all"), (3, None), (4, ""), (None, "rotten")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS spans")
    got = {r["doc_id"]: r for r in toxicity.toxic_scores(df, model).collect()}
    text = rows[1][1]
    assert {w for s in got[2]["spans"] for w in text[s["start"] : s["end"]].replace(",", "").lower().split()} >= {"rotten", "wretch", "vilest"}
    assert got[2]["score"] >= 0.5 > got[1]["score"] and got[3]["score"] == got[4]["score"] < 0.5 and got[None]["score"] > got[1]["score"]


def test_long_and_repeated_texts(spark):
    """One toxic word in 60,000 marks its place and no other; equal rows have equal scores, whatever stands beside them."""
    model = toxicity.train(*_labelled(200))
    words = prose(900, 60_000).split(" ")
    words[41_000] = "rotten"
    rows = [(1, " ".join(words)), (2, "vilest rotten wretch"), (2, "vilest rotten wretch"), (3, "vilest rotten wretch"), (4, "x" * 200_000)]
    got = toxicity.toxic_scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    at = len(" ".join(words[:41_000])) + 1
    long = next(r for r in got if r["doc_id"] == 1)
    assert [(s["start"], s["end"]) for s in long["spans"]] == [(at, at + 6)]
    same = [(r["score"], r["spans"]) for r in got if r["doc_id"] in (2, 3)]
    assert len(same) == 3 and same[0] == same[1] == same[2]


def test_contradictory_and_missing_labels(spark):
    """The greater of several labels counts; labels that are null, or of ids that are, are none."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 0), (2, None), (3, None), (3, 1), (None, 1), (9, 1)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    texts, marks = toxicity.bounded_sample(docs, labels, F.lit(True))
    assert dict(zip(texts, marks, strict=True)) == {"text 0": 1, "text 1": 0, "text 3": 1}


def test_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id % 4 = 0")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    from pyspark.sql import functions as F

    model = toxicity.train(*toxicity.bounded_sample(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), F.col("id") % 4 != 0))
    got = toxicity.toxic_scores(docs.join(labels, "doc_id").select("doc_id", "text"), model).join(labels, "doc_id").select("score", "toxic").collect()
    hit = sum(r["score"] >= 0.5 for r in got if r["toxic"] == 1)
    wrong = sum(r["score"] >= 0.5 for r in got if r["toxic"] == 0)
    assert hit >= 0.8 * sum(r["toxic"] == 1 for r in got) and wrong <= 0.02 * len(got)


def test_without_labels(spark):
    assert toxicity.train(["a"], [1]) is None and toxicity.train([], []) is None
    assert {r["score"] for r in toxicity.toxic_scores(odd_docs(spark, clashes=True), None).collect()} == {0.0}
    assert not toxicity.toxic_scores(empty_docs(spark), None).count()


@pytest.mark.parametrize(("a", "b"), [("abcde", "ace"), ("", "x"), ("xyz", "xyz"), ("aaab", "baaa"), ("abc", "")])
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert decontaminate.common_subsequence(list(a), list(b)) == table[-1][-1]


def test_leaks_and_paraphrases(spark):
    items = [prose(100 + k, n) for k, n in enumerate((14, 30, 45, 60, 90))]
    rows = [(k, prose(200 + k, 120)) for k in range(60)]
    leaks = {1000 + k: f"{prose(300 + k, 40 + 13 * k)} {t} {prose(400 + k, 70)}" for k, t in enumerate(items)}
    near = {2000 + k: f"{prose(500 + k, 25)} {edited(t, 9 + k, 0.12)} {prose(600 + k, 30)}" for k, t in enumerate(items[1:], 1)}
    docs = spark.createDataFrame([*rows, *leaks.items(), *near.items(), (3000, None), (None, items[2]), (3001, "")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, asked).collect()}
    assert {(1000 + k, k) for k in range(5)} <= got and (None, 2) in got
    assert {(2000 + k, k) for k in range(1, 5) if _accepted(near[2000 + k], items[k])} <= got and not {d for d, _ in got if d is not None and d < 1000}


def test_recall_of_exact_copies(spark):
    from lagoon.llm.queries import queries

    sf = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["item_id"]) for r in queries()["op10_decontamination"](spark, sf).collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(r["doc_id"], i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, t in items if t in r["text"]}
    assert want and want <= got


def test_empty_benchmarks_and_clashes(spark):
    docs = odd_docs(spark, clashes=True)
    none = spark.createDataFrame([], "item_id long, text string")
    found, ids = decontaminate.marked(docs, none)
    assert ids == [] and found.where("size(matches) > 0").count() == 0
    assert decontaminate.contaminated(empty_docs(spark), none).count() == 0


def test_an_item_in_a_third_of_all_rows(spark):
    hot, common = prose(700, 29), "of the and to in is that of it the"
    rows = [(k, f"{prose(800 + k, 30)} {hot if k % 3 == 0 else prose(5000 + k, 29)} {prose(9000 + k, 10)} {common.upper() if k % 2 == 0 else 'in the'}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, hot), (2, common)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, asked).where("shared = 1").collect()}
    assert got == {(k, 1) for k in range(0, 1500, 3)} | {(k, 2) for k in range(0, 1500, 2)}


def _searcher(texts, items, **options):
    """A search without Spark: features and words counted in the texts themselves."""
    hashes, counts = decontaminate.word_hashes(*decontaminate.scan.flatten(pa.array(texts)))
    seen = np.bincount((hashes >> decontaminate._SHIFT).astype(np.int64), minlength=decontaminate.BUCKETS)
    r = np.random.default_rng(1)
    latent = decontaminate.Latent(np.ones(decontaminate.BUCKETS, bool), r.normal(size=(decontaminate.BUCKETS, 8)).astype(np.float32), seen, *np.unique(hashes, return_counts=True))
    return decontaminate.Searcher(latent, items, **options)


def _zipf(seed, n, vocabulary=30_000):
    r = np.random.default_rng(seed)
    return [f"w{int(vocabulary ** x)}" for x in r.random(n)]


def test_many_items_in_blocks(monkeypatch):
    """Matches don't depend on the items' blocks; what one look-up holds follows the block and not the benchmark."""
    items = [" ".join(_zipf(k, 40)) for k in range(1200)]
    texts = [" ".join([*_zipf(5000 + k, 150), edited(items[k * 7], k, 0.1 * (k % 4)), *_zipf(6000 + k, 100)]) for k in range(40)]
    flat = decontaminate.scan.flatten(pa.array(texts))
    found, held = [], []
    for block in (100, 1 << 20):
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK", block)
        made = _searcher([*texts, *items], items)
        found.append(made.search_both(*flat))
        hashes, _ = decontaminate.word_hashes(*flat)
        held.append(max(int((first[e + 1] - first[e]).sum()) for places, first, _ in made._blocks for _, e in [places.of(hashes)]))
    assert found[0] == found[1] and held[0] < 0.15 * held[1]
    want = {(k, k * 7) for k in range(40) if _accepted(texts[k], items[k * 7])}
    assert len(want) >= 30 and want <= {(d, k) for d, f in enumerate(found[0][0]) for k in f}
    assert all(w.keys() == f.keys() for f, w in zip(*found[0], strict=True))


def test_too_many_bytes_of_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_ITEM_BYTES", 10)
    asked = spark.createDataFrame([(1, "more than ten bytes")], "item_id long, text string")
    with pytest.raises(ValueError, match="bytes"):
        decontaminate.marked(empty_docs(spark), asked)


def _accepted(text: str, item: str) -> bool:
    """Whether any stretch of the text passes the verification, with every start tried."""
    from lagoon.llm import scan

    words, asked = (decontaminate.word_hashes(*scan.flatten(pa.array([t])))[0].tolist() for t in (text, item))
    n, lcs = len(asked), decontaminate.common_subsequence
    regions = (words[max(0, at - n // 4 - 2) : at + n + n // 2 + 2] for at in range(len(words)))
    last = asked[-decontaminate.ANSWER :]
    return any(lcs(asked, r) / n >= decontaminate.SHARED and lcs(last, r) / len(last) >= decontaminate.ANSWERED for r in regions)


def test_recall_of_edited_copies_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    hosts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    rates, planted = (0.0, 0.1, 0.2, 0.3, 0.35), {}
    for k, (rate, (item, text)) in enumerate((rate, x) for rate in rates for x in items):
        host = hosts[k][1].split(" ")
        place = (k * 37) % len(host)
        hosts[k] = (10**6 + k, " ".join([*host[:place], edited(text, k, rate), *host[place:]]))
        planted[10**6 + k, item] = (rate, hosts[k][1], text)
    docs = spark.createDataFrame(hosts, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    want = {pair: rate for pair, (rate, text, item) in planted.items() if _accepted(text, item)}
    found = {rate: (sum(r == rate for pair, r in want.items() if pair in got), sum(r == rate for r in want.values())) for rate in rates}
    print(found)
    assert all(n and hit == n for hit, n in found.values()), found
