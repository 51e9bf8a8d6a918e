"""Fill-in-the-middle and personal data against plain implementations."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagoon.llm import infill, personal, scan
from tests.llm.common import empty_docs, odd_docs, odd_rows

pa = pytest.importorskip("pyarrow")

# --- fill in the middle ----------------------------------------------------


def plain_fim(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    p, m = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", text, None, None
    a, b, z = text[:p], text[p:m], text[m:]
    return ("spm", f"<S>{z}<P>{a}<M>{b}", p, m - p) if h4 % 100 < 20 else ("psm", f"<P>{a}<S>{z}<M>{b}", p, m - p)


def random_texts(n):
    r = random.Random(5)
    parts = ["<", "P", "S", "M", ">", "<P", "<S>", "é", "日本", "😀", " ", "a", "x" * 700, "é" * 511, "\n", "\x00", "<<P>>"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("clashes", [False, True])
def test_fill_in_middle(spark, clashes):
    got = infill.transform(odd_docs(spark, clashes)).withColumn("again", infill.restored(F.col("output"), F.col("form")))
    want = Counter()
    for i, t, *_ in odd_rows():
        form, output, p, m = plain_fim(i, t)
        want[i, output, form, len(t or ""), p, m, t or ""] += 1
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("chunk", [1, 4000, 1 << 21])
def test_cuts_of_random_texts(chunk):
    texts = random_texts(400)
    buf, off = scan.flatten(pa.array(texts))
    for i, j in scan.chunks(off, chunk):
        outputs, forms, n, p, m = infill.cut(buf[off[i] : off[j]], off[i : j + 1] - off[i], list(range(i, j)), infill.Rates())
        for k in range(j - i):
            form, output, a, b = plain_fim(i + k, texts[i + k])
            assert (forms[k], outputs[k].decode(), int(n[k])) == (form, output, len(texts[i + k]))
            assert (int(p[k]), int(m[k])) == ((a, b) if form != "plain" else (-1, -1))


def test_bytes_that_are_no_text_are_units():
    raw = [b"\x80\x80a", b"\xe6\x97", b"\xf0\x9f\x98<P>", b"\xff" * 600 + b"<\xc3P>"]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    _, first, units, found = infill.count(infill._KINDS[buf], off)
    per = lambda x: [int(x[a:b].sum()) for a, b in zip(first, first[1:], strict=False)]
    assert per(units) == [3, 1, 4, 604] and per(found) == [0, 0, 1, 0]


def test_every_state_forgets_after_four_bytes():
    """What the blocks rest on: from any state, four classes lead to one state and the same flags after them."""
    r = random.Random(3)
    for _ in range(3000):
        seen = set()
        kinds = [r.randrange(8) for _ in range(infill.BEFORE)]
        for state in range(6):
            for k in kinds:
                state = int(infill._TABLE[(state & 7) * 8 + k]) & 7
            seen.add(state)
        assert len(seen) == 1


def test_no_rows(spark):
    assert infill.transform(empty_docs(spark)).count() == 0 == personal.find(empty_docs(spark)).count()


# --- personal data ---------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), place, kind, m.end()))
    return sorted(out)


def personal_texts():
    r = random.Random(11)
    parts = ["a.b@c.de", "@", ".", "x_y@q", "1.2.3.4", "256.1.1.1", "007.0.0.0255", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+1 (555) 555-0826", "+", "12", "0", " ", "-", "é", "日", "😀", "()", "\n", "%", "mail ", "99999999999999999999.1.1.1", "+1."]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    return [*texts, "a@b.cc " * 400 + "é" + "1.2.3.4," * 300, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", None, ""]


def test_base_spans(spark):
    texts = personal_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = personal.find(docs).select("doc_id", F.filter("spans", lambda s: s["place"] < 4).alias("spans")).collect()
    assert {r["doc_id"]: [(s["start"], s["place"], s["kind"], s["end"]) for s in r["spans"]] for r in got} == {i: plain_spans(t or "") for i, t in enumerate(texts)}


CASES = [
    ("IBAN GB82 WEST 1234 5698 7654 32.", "iban:5:32"), ("DE89370400440532013000", "iban:0:22"), ("DE89370400440532013001", ""),
    ("XDE89370400440532013000", ""), ("GB82 WEST 1234 5698 7654 32 IS it", "iban:0:27"),
    ("my ssn is 123-45-6789", "ssn:10:21"), ("number 123-45-6789", ""), ("ssn 000-45-6789", ""), ("ssn 9123-45-6789", ""), ("social security: 123-45-6789, order", ""),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_kinds_of_the_method(spark, text, want):
    found = personal.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(personal.joined(F.filter("spans", lambda s: s["place"] >= 4))).first()[0]
    assert found == want


def test_context_moves_scores(spark):
    texts = ["10.0.0.1", "server 10.0.0.1", "version 10.0.0.1", "the server version 10.0.0.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r[0]: r[1] for r in personal.find(df).select("doc_id", F.col("spans")[0]["score"]).collect()} == {0: 60, 1: 90, 2: 20, 3: 50}


def test_odd_documents_have_defined_rows(spark):
    got = personal.find(odd_docs(spark, True)).select("doc_id", personal.joined(F.col("spans"))).collect()
    assert Counter(r[0] for r in got) == Counter(i for i, *_ in odd_rows())


def test_main_path_is_native(spark):
    plan = personal.op13_personal_data(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_patterns_are_linear_on_long_runs(spark):
    texts = ["a" * 400_000, "1" * 400_000 + ".", "a@b" + ".c" * 200_000, "+1" * 150_000, "AB12" * 80_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in personal.find(df).select("doc_id", F.size("spans")).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0}
