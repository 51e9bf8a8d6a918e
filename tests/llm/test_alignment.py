"""Tokens of two tokenizers side by side against whole texts encoded at once."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import accumulate

import pytest

from lagoon.llm import alignment
from tests.llm.common import empty_docs, odd_docs, odd_rows, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


@pytest.fixture(scope="module")
def whole():
    """(groups of a text) by the libraries on whole texts, with token bytes made anew."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    chars = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    byte = {chr(c): c for c in chars} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in chars)}
    spelling = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if set(t) <= set(byte)}

    def spell(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("\u2581", " ").encode()

    def groups(text):
        if not text:
            return []
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        la, lb = [spelling[i] for i in ia], [spell(i) for i in ib]
        if not b"".join(la) == b"".join(lb) == (" " + text).encode():
            return []
        ends = [list(accumulate(map(len, parts))) for parts in (la, lb)]
        both = sorted(set(ends[0]) & set(ends[1]))
        pick = lambda ids, at, lo, hi: ids[bisect_right(at, lo) : bisect_right(at, hi)]
        return [(pick(ia, ends[0], lo, hi), pick(ib, ends[1], lo, hi)) for lo, hi in zip([0, *both], both, strict=False)]

    return groups


def brute(rows, groups):
    """Rows of the contract for (id, text) rows."""
    made = [(i, groups(t)) for i, t in rows]
    held = defaultdict(set)
    for k, (_, gs) in enumerate(made):
        for a, b in gs:
            for x in a:
                for y in b:
                    held[x, y].add(k)
    most = defaultdict(int)
    for (x, _), docs in held.items():
        most[x] = max(most[x], len(docs))
    out = Counter()
    for i, gs in made:
        every = [(x, y) for a, b in gs for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
        n = lambda k: sum(len(g[k]) for g in gs)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out[i, n(0), n(1), len(gs), len(every), sum(len(held[p]) == most[p[0]] for p in every), sum(len(held[p]) for p in every), digest, text] += 1
    return out


def found(docs, **options):
    return Counter(map(tuple, alignment.align(docs, *FILES, with_groups=True, **options).select(*COLUMNS).collect()))


def short_rows():
    return [(i, t[:3000] if t else t) for i, t, *_ in odd_rows()]


@pytest.mark.parametrize("options", [{}, {"chunk": 1, "bucket": 500}, {"chunk": 2000, "bucket": 1 << 20}])
def test_odd_documents(spark, whole, options):
    docs = odd_docs(spark, True).selectExpr("*", "1 AS chunk", "2 AS place", "3 AS codes").withColumn("text", alignment.F.substring("text", 1, 3000))
    assert found(docs, **options) == brute(short_rows(), whole)


def random_texts(n):
    r = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "\r", "\r\n", "\u00a0", "\u3000", "\u2028", "\x0b", "\x85", "\x1c", "\x00", "word", ";", ");", "{", "'s", "don't", "3.14", "é", "日本語", "😀", "<|endoftext|>", "</s>", "<0x41>", "\u0301", "ÅB", "\u200d", "\ufeff"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 15))) for _ in range(n)]
    return [*texts, "a\u2581b", prose(3, 200), " ", "   ", "\n", "x" * 3000]


def test_random_texts(spark, whole):
    rows = list(enumerate(random_texts(600)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs, chunk=900, bucket=400) == brute(rows, whole)


def test_segments_are_independent():
    """Each text's segments, encoded by themselves, give what the whole text does."""
    aligner = alignment.Aligner(*FILES)
    assert " " in aligner.safe and "\r" not in aligner.safe  # the second vocabulary has pieces like ';\r'
    for t in random_texts(300):
        assert "".join(aligner.segments(t)) == " " + t


def test_no_rows(spark):
    assert alignment.align(empty_docs(spark), *FILES).count() == 0


def test_links_of_segments():
    """Two segments, one that its tokens don't spell, and one with a pair in two groups."""
    got = alignment.Links.of(b"1,2|3;4|5,5;4|5\n|\n10|20;10|20")
    assert got.counts.tolist() == [[4, 4, 3, 5], [0, 0, 0, 0], [2, 2, 2, 2]] and got.start.tolist() == [0, 3, 3, 4]
    assert dict(zip(got.pairs.tolist(), got.times.tolist(), strict=True)) == {1 << 32 | 3: 1, 2 << 32 | 3: 1, 4 << 32 | 5: 3, 10 << 32 | 20: 2}
