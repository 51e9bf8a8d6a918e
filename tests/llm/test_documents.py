"""The operators on documents against plain implementations, on odd documents and on the smallest tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from lagoon.llm import licenses, minhash, packing, quality, repeats, sharding, token_counts
from tests.llm.common import LOWER, WORD, edited, empty_docs, odd_docs, odd_rows, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL, FILE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def read(spark, name="documents"):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


@pytest.fixture(params=["odd", "clashing", "table"])
def docs(request, spark):
    return read(spark) if request.param == "table" else odd_docs(spark, request.param == "clashing")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# --- token counts and packing ----------------------------------------------


def plain_token_counts(df):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in texts_of(df))


@pytest.mark.parametrize(("hot", "most"), [(1 << 16, 500_000), (7, 30), (0, 3)])
def test_token_counts(spark, docs, hot, most, monkeypatch):
    """With all pre-tokens sent to the tasks, few of them, and none; and with small and large counts before the shuffle."""
    monkeypatch.setattr(token_counts, "HOT", hot)
    monkeypatch.setattr(token_counts, "MAX_PRETOKENS", most)
    assert Counter(map(tuple, token_counts.piece_counts(docs, MODEL).collect())) == plain_token_counts(docs)


def plain_ids(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 2] for e in Tokenizer.from_file(FILE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("most", [64, 4096])
def test_packing(spark, docs, most):
    got = packing.pack(docs, FILE, 2, most, with_ids=True).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= most for r in got)
    want = []
    for (i, _), ids in zip(texts_of(docs), plain_ids([t for _, t in texts_of(docs)]), strict=True):
        for s, n in packing.power_of_two_cuts(len(ids), most):
            want.append((i, s, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s : s + n])), len(ids), tuple(ids[s : s + n])))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], tuple(r["ids"])) for r in got) == Counter(want)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4095, 4096, 4097, 12_289])
def test_cuts_cover_everything_once(n):
    cuts = packing.power_of_two_cuts(n, 4096)
    assert [x for s, k in cuts for x in range(s, s + k)] == list(range(n))


def test_packing_when_the_table_starts_anew(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lagoon.llm import scan

    monkeypatch.setattr(packing, "MAX_UNITS", 2)
    encoder = packing.UnitEncoder(FILE)
    for text in ("alpha beta, gamma", "delta don't " * 5, "", "alpha <|endoftext|>X"):
        ids, at = encoder.encode(*scan.flatten(pa.array([text, text])))
        assert [*ids[at[0] : at[1]].tolist(), 2] == plain_ids([text])[0] and np.array_equal(ids[: at[1]], ids[at[1] :])


def test_packing_of_random_strings():
    import random

    import numpy as np
    import pyarrow as pa

    from lagoon.llm import scan

    r = random.Random(31)
    pool = [*map(chr, range(0x20, 0x7F)), *map(chr, range(0xA0, 0x100)), *"aeiouAEIOUßÿ×÷×÷×÷ \n\t  .,;'-<|>", "\u0301", "\u0308", "漢", "字", "ひ", "한", "😀", "👩\u200d💻", "<|endoftext|>", "</s>", "'s", "don't", "\x00", "\x7f", "\u3000", "▁", "ﬁ", "İ", "ẞ"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(1, 14))) for _ in range(100_000)]
    encoder, step = packing.UnitEncoder(FILE), 2000
    for i in range(0, len(texts), step):
        ids, at = encoder.encode(*scan.flatten(pa.array(texts[i : i + step])))
        want = plain_ids(texts[i : i + step])
        got = [[*x.tolist(), 2] for x in np.split(ids, at[1:-1])]
        assert got == want, next((t, g, w) for t, g, w in zip(texts[i:], got, want, strict=False) if g != w)


# --- quality and licences --------------------------------------------------


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs):
    got = quality.apply_policy(quality.ledger(docs), "v1").collect()
    assert Counter((r["doc_id"], *(r[m] for m in quality.MEASURES)) for r in got) == Counter((i, *plain_quality(t)) for i, t in texts_of(docs))
    for r in got:
        m = {k: r[k] for k in quality.MEASURES}
        failed = [bool(eval(c.replace("AND", "and"), {}, m)) for c in quality.RULES.values()]
        assert r["failed"] == sum(f << k for k, f in enumerate(failed)) and r["kept"] == (not any(failed))


def test_ablations(spark):
    marked = quality.ledger(odd_docs(spark)).persist()
    bits = [r["failed"] for r in marked.collect()]
    for r in quality.ablations(marked, "v1").collect():
        bit = 1 << list(quality.RULES).index(r["rule"])
        assert r["n_failed"] == sum(bool(b & bit) for b in bits) and r["n_only"] == sum(b == bit for b in bits)


def test_clean_documents_stay(spark):
    labels = read(spark, "labels").where("quality = 1").select("doc_id")
    kept = quality.apply_policy(quality.ledger(read(spark)), "v1").where("n_words >= 30").join(labels, "doc_id")
    assert kept.where("NOT kept").count() <= 0.02 * kept.count()


NOTICE = "Licensed under the Apache License, Version 2.0. Also MIT license and cc by; GNU General Public License"


def test_license_phrases_and_edits(spark):
    rows = [(1, NOTICE), (2, "licensd undr the apche license"), (3, "nothing here"), (4, None), (5, "mit licensex"), (6, "Permission is hereby grantd free of charge to you"), (7, "é MIT LICENSE mit  license"), (None, "cc-by 4.0")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["base_labels"], got[1]["first_word"], got[1]["last_word"], got[1]["score"]) == (4, "apache,cc-by,gpl,mit", 3, 14, 1.0)
    assert got[2]["n_base"] == 0 and got[2]["labels"] == "apache" and 0 < got[2]["score"] < 1
    assert got[3]["labels"] == "" and got[4]["n_words"] == 0 and got[5]["n_base"] == 0
    assert got[6]["labels"] == "mit" and got[7]["n_base"] == 2 and got[7]["n_words"] == 5 and got[None]["base_labels"] == "cc-by"


def test_license_words(spark, docs):
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = []
    for i, t in texts_of(docs):
        words = word.findall((t or "").translate(LOWER))
        places = [(k, label) for phrase, label in licenses.PHRASES for n in [len(phrase.split())] for k in range(len(words)) if words[k : k + n] == phrase.split()]
        want.append((i, len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))))
    got = licenses.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_fuzzy_search_misses_nothing_within_its_edits():
    import random

    import regex

    r = random.Random(8)
    finder = licenses.FuzzyNotices()
    for notice, label in licenses.NOTICES:
        k = licenses.edits_allowed(notice)
        for _ in range(20):
            s = list(notice)
            for _ in range(r.randint(0, k)):
                s[r.randrange(len(s))] = r.choice("abcxyz ")
            text = prose(r.randint(0, 99), 20) + " " + "".join(s) + " " + prose(r.randint(0, 99), 20)
            there = bool(regex.search(f"(?:{regex.escape(notice)}){{e<={k}}}", text))
            assert there and label in {x[0] for x in finder.find(text)}


def plain_spans(text):
    """All of the text searched for each notice, without seeds."""
    import regex

    def best(pattern, a, b):
        m = pattern.search(text, a, b)
        return [] if not m else [*best(pattern, a, m.start()), (m.start(), m.end(), sum(m.fuzzy_counts)), *best(pattern, m.end(), b)]

    out = []
    for notice, label in licenses.NOTICES:
        pattern = regex.compile(f"(?:{regex.escape(notice)}){{e<={licenses.edits_allowed(notice)}}}", regex.BESTMATCH)
        out += [(label, *x) for x in best(pattern, 0, len(text))]
    return out


def test_fuzzy_spans_of_neighbours():
    import random

    r, finder = random.Random(12), licenses.FuzzyNotices()
    assert [x[1:4] for x in finder.find("the mozila publik license, mozilla public license, end")] == [(4, 25, 2), (27, 49, 0)]
    for order in (("licenze", "license"), ("license", "licenze")):
        assert len(finder.find(" ".join(f"released under the mit {w}" for w in order))) == 2
    seen = 0
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 4)):
            notice = list(r.choice(licenses.NOTICES)[0])
            for _ in range(r.randint(0, licenses.edits_allowed("".join(notice)))):
                at = r.randrange(len(notice))
                notice[at] = r.choice(["", "x", notice[at] + "q", "z "])
            parts += ["".join(notice), r.choice(["", " ", ", ", " é and so on ", prose(r.randint(0, 9), 3)])]
        text = "".join(parts)
        got = [x[:4] for x in finder.find(text)]
        seen += len(got)
        assert got == plain_spans(text), text
    assert seen > 300


# --- sharding --------------------------------------------------------------


def test_sharding(spark, docs):
    from pyspark.sql import functions as F

    got = sharding.interleave(docs.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).alias("size")), 8, 3, key_cols=("doc_id", "size")).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t or "")) for i, t in texts_of(docs))
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    sizes = [len(v) for v in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == min(8, len(got))
    for rows_ in by_shard.values():
        assert sorted(r["slot"] for r in rows_) == list(range(len(rows_)))
    for source, n in Counter(r["source"] for r in got).items():
        for rows_ in by_shard.values():
            assert abs(sum(r["source"] == source for r in rows_) - n / 8) <= 2


# --- near duplicates -------------------------------------------------------


def plain_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, len(sets[k]), least.get(root(k)), i == least.get(root(k))) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, docs, width):
    got = minhash.near_duplicates(docs, width).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == plain_components(texts_of(docs), width, 80)


def test_a_group_of_copies_with_chains(spark):
    base = prose(50, 150)
    rows = [(i, edited(base, i, share)) for i, share in enumerate([0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08] * 12)]
    chain, text = [], prose(51, 100)
    for k in range(12):
        text = edited(text, 900 + k, 0.02)
        chain.append((1000 + k, text))
    df = spark.createDataFrame(rows + chain, "doc_id long, text string")
    got = minhash.near_duplicates(df, 4).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == plain_components(rows + chain, 4, 80)


def test_parities_never_exceed_differences():
    import numpy as np

    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 60, 64, 65, 130, 500)]
    sets += [np.unique(np.concatenate([s[: len(s) * 4 // 5], r.integers(0, 1 << 63, max(1, len(s) // 6), dtype=np.uint64)])) for s in sets]
    for x in sets:
        for y in sets:
            a, b = (np.frombuffer(minhash.parity(s), np.uint8)[None, :] for s in (x, y))
            assert minhash.differing_bits(a, b)[0, 0] <= len(np.setxor1d(x, y))


def test_short_documents_with_three_words_in_common(spark):
    """The common shingles fill left half-keys of many documents; the blocks that compare them stay in proportion to the rows."""
    from pyspark.sql import functions as F

    from lagoon.llm.shared import write

    n = 100_000
    word = lambda k: F.concat(F.lit("w"), F.xxhash64("id", F.lit(k)))
    rows = spark.range(n).repartition(8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("all rights are reserved by us"), *(word(k) for k in range(7))).alias("text"))
    rows = rows.unionByName(spark.range(n, n + 50).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("v"), F.when((F.col("id") % 2 == 0) & (F.lit(k) == 0), F.lit("x")).otherwise(""), F.lit(str(k)), (F.col("id") - F.col("id") % 2).cast("string")) for k in range(20))).alias("text")))
    got = minhash.near_duplicates(rows, 4).select("doc_id", "component_id").where("doc_id != component_id")
    assert {tuple(r) for r in got.collect()} == {(k + 1, k) for k in range(n, n + 50, 2)}
    marked = minhash.signatures(rows.select(F.col("doc_id").alias("id"), "text"), 4, minhash.HALF, minhash.ROWS)
    left = write(marked.select(F.posexplode("lefts").alias("i", "l"), "rights"), "lefts").df
    most_left = left.groupBy("i", "l").count().agg(F.max("count")).first()[0]
    most = left.select("i", "l", F.posexplode("rights").alias("j", "r")).groupBy("i", "l", "j", "r").count().agg(F.max("count")).first()[0]
    assert most_left > minhash.BLOCK >= most


def test_one_of_each(spark):
    got = minhash.one_of_each(odd_docs(spark, clashes=True))
    rows = got.collect()
    ids = [r["doc_id"] for r in rows]
    assert set(got.columns) == set(odd_docs(spark, clashes=True).columns)
    assert set(ids) == {i for i, *_, kept in plain_components(texts_of(odd_docs(spark)), 5, 80) if kept} and not {2, 11} & set(ids) and ids.count(20) == 2
    assert sum(r["doc_id"] is None and r["text"] is not None for r in rows) == 1


# --- repeated strings ------------------------------------------------------


def plain_repeats(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        hit = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                hit[s : s + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if hit[k] and (k == 0 or not hit[k - 1]))
        out.append((i, len(b), sum(hit), runs, hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=True) if not h)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("group", [2, 500])
def test_repeated_strings(spark, docs, group, monkeypatch, tmp_path):
    monkeypatch.setattr(repeats, "GROUP", group)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = repeats.op4_repeated_strings(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == plain_repeats(texts_of(docs))


@pytest.mark.parametrize("group", [5, 500])
def test_large_groups_of_near_copies(spark, group, monkeypatch, tmp_path):
    """One passage in many settings, near copies of one text, and texts without an id."""
    monkeypatch.setattr(repeats, "GROUP", group)
    base, seed = prose(81, 60), prose(82, 20)
    rows = [(i, edited(base, i, 0.03)) for i in range(60)] + [(100 + i, prose(900 + i, 12) + seed + prose(1900 + i, 12)) for i in range(60)]
    rows += [(None, prose(3000 + i, 10) + (seed + base)[i : i + 190 + i] + prose(4000 + i, 10)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = repeats.op4_repeated_strings(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == plain_repeats(rows)


def test_rows_without_id_are_told_apart(spark):
    """Texts whose 32-bit hashes are equal keep their own spans."""
    from pyspark.sql import functions as F

    found = spark.range(400_000).select(F.concat(F.lit("t"), F.col("id")).alias("t")).groupBy(F.hash("t").alias("h")).agg(F.min("t").alias("x"), F.max("t").alias("y")).where("x < y").limit(3).collect()
    passage = prose(83, 60)
    rows = [(None, r[k]) for r in found for k in "xy"]
    docs = spark.createDataFrame([*rows, *[(None, passage)] * 2], "doc_id long, text string")
    assert docs.select(repeats._text_hash("text").alias("h")).distinct().count() == len(rows) + 1 and found
    got = Counter((r["row"]["text"], r["n_removed"]) for r in repeats.without_repeats(docs, 200).collect())
    assert got == Counter([*((t, 0) for _, t in rows), *[(passage, len(passage.encode()))] * 2])


def test_long_texts_are_scanned_in_blocks(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lagoon.llm import scan

    text = prose(70, 3000, 60) + prose(71, 40) + prose(70, 3000, 60)
    buf, off = scan.flatten(pa.array([text, "short", text[:700]]))
    whole = repeats.anchors(buf, off, 200)
    seen = set()
    for i, j, a, z in repeats._blocks(off, 200, 2000):
        own = np.clip(off[i : j + 1], a, z) - a
        doc, _, lo, hi, _, _ = repeats.anchors(buf[a:z], own, 200)
        shift = a - off[i] if j - i == 1 else 0
        seen.update((int(d) + i, w + shift) for d, x, y in zip(doc, lo, hi, strict=True) for w in range(x, y + 1))
    want = {(int(d), w) for d, x, y in zip(whole[0], whole[2], whole[3], strict=True) for w in range(x, y + 1)}
    assert {(d, int(w)) for d, w in seen} == want


def test_without_repeats_keeps_columns(spark):
    got = repeats.without_repeats(odd_docs(spark, clashes=True), 200)
    assert got.count() == len(odd_rows()) and got.columns == ["row", "kept_text", "n_removed"]


# --- empty tables ----------------------------------------------------------


def test_empty_tables(spark):
    none = empty_docs(spark)
    assert not token_counts.piece_counts(none, MODEL).count() and not packing.pack(none, FILE, 2).count()
    assert not quality.ledger(none).count() and not licenses.scan_licenses(none).count()
    assert not sharding.interleave(none, 8, 1).count() and not minhash.near_duplicates(none).count() and not repeats.without_repeats(none).count()


def test_low_percentages_are_refused(spark):
    with pytest.raises(ValueError, match="50"):
        minhash.near_duplicates(empty_docs(spark), 5, 40)


def _dissimilar(n, shared=40, own=26):
    """Documents with one long passage in common, similar to none but in planted pairs."""
    passage = prose(77, shared)
    rows = [(k, f"{passage} {prose(10_000 + k, own, 4000)}") for k in range(n)]
    return rows + [(n + k, rows[k][1] + " more words") for k in range(0, n, 50)]


@pytest.mark.parametrize("large", [3, 40])
def test_large_tables_are_parted_without_loss(spark, monkeypatch, large):
    """Tables of many dissimilar classes, parted by rare shingles, give what all pairs do."""
    monkeypatch.setattr(minhash, "LARGE", large)
    rows = _dissimilar(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in minhash.near_duplicates(docs, 4).select("doc_id", "component_id").where("doc_id != component_id").collect()}
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, t in rows for w in [t.split(" ")]}
    want = {(b, a) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert got == want and len(want) == 8


def test_parted_tables_grow_with_the_rows(spark, monkeypatch):
    """One table of classes that share a passage and nothing else: rare shingles bring hardly any two together."""
    from lagoon.llm.shared import write

    monkeypatch.setattr(minhash, "LARGE", 100)
    texts = spark.createDataFrame([(k.to_bytes(4, "big"), t) for k, t in _dissimilar(2000)[:2000]], "set_key binary, text string")
    groups = texts.selectExpr("set_key AS a", "1L AS g", "0 AS ij")
    roots = write(texts.selectExpr("set_key AS a", "set_key AS b").where("false"), "roots")
    parted, _ = minhash._refined(groups, texts, roots, 80, 4)
    sizes = [r["n"] for r in parted.groupBy("g").count().withColumnRenamed("count", "n").collect()]
    assert sum(n * n for n in sizes) < 2000 * 20
