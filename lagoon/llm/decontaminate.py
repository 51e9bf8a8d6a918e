"""Benchmark decontamination by latent semantic retrieval.

1. TF-IDF: words are hashed into `BUCKETS` features; documents are cut into
   passages of `PASSAGE` words, and document frequencies are counted over all
   passages of all documents.
2. Randomised SVD: with a fixed random matrix W of `RANK` columns, the product
   B = A'AW is summed over all passages (A: passages by features, weighted by
   TF-IDF), each partition adding its rows. On the driver, whose part is
   `BUCKETS` by `RANK` numbers whatever the corpus, the Nystroem form
   B (W'B)^-1 B' of A'A gives the leading right singular vectors, divided by their
   singular values so that no direction that all text shares dominates.
3. Candidates: every window of about an item's length, at a quarter of its length
   apart, is projected by prefix sums over its words and compared with the items
   of that length by cosine; `COSINE` is the least that goes on. Words of features
   that more than `COMMON` of all passages have tell nothing and are left out, of
   windows, items and the decomposition. That loses items of common words (a copied
   item makes its own words common) and part of the paraphrases, so every stretch of
   text that the verification can accept is a candidate too: it misses no more words
   of an item than the verification allows, so of that many and `ANCHORS` of the
   item's rarest words (by the passages that have the word itself) it holds `ANCHORS`
   at least. Those are looked up, `ITEM_BLOCK` items at a time, and the words that such
   stretches share with the whole item are counted. A match says which of the two
   ways led to it.
4. Verification on the words themselves: an upper bound from the words in common,
   then the longest common subsequence with the whole item, and with the item's
   answer, which is its last `ANSWER` words (all of a shorter item).

Items longer than the largest window are searched by probes of that size and
verified as a whole around each candidate.

Words are the maximal runs of ASCII digits and letters (lower-cased) and of
non-ASCII characters, told apart by 64-bit hashes.

Defined cases: null or empty texts, or ones without words, match nothing, and so do
such items; null ids are kept; repeated rows repeat; repeated item ids are items of
their own; an empty table of documents or items gives no matches; further columns
are ignored; texts of any length are searched whole. What is looked up in is made once
and broadcast: a benchmark's size doesn't follow the corpus, and over `MAX_ITEMS`
items or `MAX_ITEM_BYTES` bytes of them are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lagoon.llm import scan
from lagoon.llm.shared import arrow_batches

BUCKETS, RANK, PASSAGE = 8192, 48, 64
#: A feature of a larger share of passages tells nothing, unless it is in no more than FEW.
COMMON, FEW = 0.02, 20
#: The least cosine, and the same for windows of up to 8 words, where one word at an edge weighs more.
COSINE, COSINE_SHORT = 0.7, 0.55
#: Sizes of the windows that are compared, in informative words.
WINDOWS = (5, 8, 13, 20, 32)
#: Rare words of an item that a stretch of text must hold to be looked at.
ANCHORS = 3
ANSWER = 8
SHARED, ANSWERED = 0.6, 0.5
MAX_ITEMS, MAX_ITEM_BYTES = 200_000, 32 << 20
#: Items whose words are looked up together; what one look-up holds grows with them.
ITEM_BLOCK = 2048
_SLICES = 32
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = scan.LOWER[buf]
    starts, ends, counts = scan.words(low, off, scan.ALNUM)
    return scan.Prefix(low).of(starts, ends), counts


def _passages(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The passage of each word, and how many there are."""
    n = -(-counts // PASSAGE)
    first = np.cumsum(n) - n
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first, counts) + within // PASSAGE, int(n.sum())


class Places:
    """Looks words up in a sorted list of them; a bit for each prefix of a hash turns most others away."""

    def __init__(self, words: np.ndarray, bits: int = 20) -> None:
        self.words, self._shift = words, np.uint64(64 - bits)
        self._maybe = np.zeros(1 << bits, bool)
        self._maybe[words >> self._shift] = True

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are listed, and where."""
        at = np.flatnonzero(self._maybe[hashes >> self._shift])
        if not len(at):
            return at, at
        entry = np.minimum(np.searchsorted(self.words, hashes[at]), len(self.words) - 1)
        real = self.words[entry] == hashes[at]
        return at[real], entry[real]


def _frequencies(texts: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Passages that have each feature, passages, and passages that have each word of a vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, own, places = np.zeros(BUCKETS, np.int64), 0, np.zeros(len(vocabulary), np.int64), Places(vocabulary)
        for b in batches:
            buf, off = scan.flatten(b.column("text"))
            for i, j in scan.chunks(off):
                hashes, counts = word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                passage, n = _passages(counts)
                pairs = np.sort(passage * BUCKETS + (hashes >> _SHIFT).astype(np.int64))
                if len(pairs):
                    seen += np.bincount(pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] % BUCKETS, minlength=BUCKETS)
                total += n
                at, entry = places.of(hashes)
                if len(at):
                    pairs = np.sort(passage[at] * len(vocabulary) + entry)
                    own += np.bincount(pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] % len(vocabulary), minlength=len(vocabulary))
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(-1, BUCKETS), some + BUCKETS])), pa.array(np.concatenate([[total], seen, own[some]]))], names=["feature", "n"])

    rows = texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows, and one for each word of the vocabulary
    out = np.zeros(1 + BUCKETS + len(vocabulary), np.int64)
    out[rows.column("feature").to_numpy() + 1] = rows.column("n").to_numpy()
    return out[1 : BUCKETS + 1], int(out[0]), out[BUCKETS + 1 :]


def _range_product(texts: DataFrame, weights: np.ndarray, random: np.ndarray) -> np.ndarray:
    """A'AW summed over all passages."""
    weighted = (weights[:, None] * random).astype(np.float32)
    step = BUCKETS // _SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, RANK), np.float32)
        for b in batches:
            buf, off = scan.flatten(b.column("text"))
            for i, j in scan.chunks(off):
                hashes, counts = word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                if not len(hashes):
                    continue
                passage, _ = _passages(counts)
                feature = (hashes >> _SHIFT).astype(np.int64)
                told = weights[feature] > 0
                passage, feature = passage[told], feature[told]
                if not len(feature):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
                rows = np.add.reduceat(weighted[feature], starts, axis=0)
                order = np.argsort(feature.astype(np.uint16), kind="stable")
                sorted_features = feature[order]
                first = np.flatnonzero(np.concatenate([[True], sorted_features[1:] != sorted_features[:-1]]))
                at = np.cumsum(np.concatenate([[False], passage[1:] != passage[:-1]]))
                total[sorted_features[first]] += np.add.reduceat(rows[at[order]], first, axis=0)
        total *= weights[:, None]
        parts = [total[k * step : (k + 1) * step].astype(np.float32).tobytes() for k in range(_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(list(range(_SLICES)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "part"])

    def add(key, table: pa.Table) -> pa.Table:
        out = np.zeros(step * RANK, np.float64)
        for x in table.column("part"):
            out += np.frombuffer(x.as_py(), np.float32)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

    parts = texts.mapInArrow(run, "slice int, part binary").withColumn("salt", F.spark_partition_id() % 64)
    once = parts.groupBy("slice", "salt").applyInArrow(lambda key, t: add(key, t), "slice int, part binary")
    rows = once.groupBy("slice").applyInArrow(lambda key, t: add(key, t), "slice int, part binary").collect()  # BUCKETS by RANK numbers
    out = np.zeros((BUCKETS, RANK))
    for r in rows:
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["part"], np.float32).reshape(step, RANK)
    return out


@dataclass
class Latent:
    """Which features tell passages apart, what a word of each adds to a passage's place in the latent space, and how many passages have it; and the passages that have each word of a vocabulary."""

    informative: np.ndarray
    projection: np.ndarray
    seen: np.ndarray
    vocabulary: np.ndarray
    known: np.ndarray

    @staticmethod
    def fit(texts: DataFrame, vocabulary: np.ndarray | None = None, seed: int = 11) -> Latent:
        vocabulary = np.zeros(0, np.uint64) if vocabulary is None else vocabulary
        seen, total, known = _frequencies(texts, vocabulary)
        informative = seen <= max(COMMON * total, FEW)
        weights = np.where(informative, np.log((total + 1) / (seen + 1)), 0.0)
        random = np.random.default_rng(seed).normal(size=(BUCKETS, RANK))
        made = Latent.of(informative, weights, random, _range_product(texts, weights, random), seen, total)
        return replace(made, vocabulary=vocabulary, known=known)

    def rarity(self, words: np.ndarray) -> np.ndarray:
        """Passages that have each word, or its feature where it isn't in the vocabulary."""
        out = self.seen[(words >> _SHIFT).astype(np.int64)]
        at, entry = Places(self.vocabulary).of(words)
        out[at] = self.known[entry]
        return out

    @staticmethod
    def of(informative: np.ndarray, weights: np.ndarray, random: np.ndarray, product: np.ndarray, seen: np.ndarray, total: int) -> Latent:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        core = random.T @ product
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        good = values > max(values.max(), 0) * 1e-9
        if not good.any():
            return Latent(informative, np.zeros((BUCKETS, 1), np.float32), seen, *none)
        # A'A is about F F', F = product core^(-1/2); its singular vectors and values
        left, singular, _ = np.linalg.svd(product @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
        keep = singular > singular[0] * 1e-6
        return Latent(informative, (weights[:, None] * left[:, keep] / singular[keep] * np.sqrt(max(total, 1))).astype(np.float32), seen, *none)


@dataclass
class Item:
    """All words, the same sorted, the informative ones sorted, and the answer."""

    words: np.ndarray
    sorted: np.ndarray
    told: np.ndarray
    answer: np.ndarray

    @cached_property
    def bits(self) -> tuple[dict, dict]:
        """The places of each word in the item and in the answer."""
        return bits_of(self.words.tolist()), bits_of(self.answer.tolist())


class Items:
    """Items by number, their words in a few long arrays."""

    def __init__(self, texts: list[str], latent: Latent) -> None:
        self.words, counts = word_hashes(*scan.flatten(pa.array(texts, pa.string())))
        owner = np.repeat(np.arange(len(counts)), counts)
        informative = latent.informative[(self.words >> _SHIFT).astype(np.int64)]
        order = np.lexsort((self.words, owner))
        self.sorted, self.told = self.words[order], self.words[order][informative[order]]
        self.at = np.concatenate([[0], np.cumsum(counts)])
        self.told_at = np.concatenate([[0], np.cumsum(np.bincount(owner[informative], minlength=len(counts)))])
        self._held: dict[int, Item] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_held": {}}

    def __len__(self) -> int:
        return len(self.at) - 1

    def __getitem__(self, k: int) -> Item:
        found = self._held.get(k)
        if found is None:
            if len(self._held) > 4096:
                self._held.clear()
            found = self._held[k] = self._made(k)
        return found

    def _made(self, k: int) -> Item:
        a, z = self.at[k], self.at[k + 1]
        return Item(self.words[a:z], self.sorted[a:z], self.told[self.told_at[k] : self.told_at[k + 1]], self.words[max(a, z - ANSWER) : z])


class Searcher:
    def __init__(self, latent: Latent, texts: list[str], cosine: tuple[float, float] = (COSINE, COSINE_SHORT), shared: float = SHARED, answered: float = ANSWERED) -> None:
        self._latent, self._cosine, self._shared, self._answered = latent, cosine, shared, answered
        self.items = Items(texts, latent)
        probes: dict[int, list[tuple[int, np.ndarray, int]]] = {}
        for k in range(len(self.items)):
            feature = (self.items[k].words >> _SHIFT).astype(np.int64)
            told = np.flatnonzero(latent.informative[feature])
            for at in range(0, len(told), WINDOWS[-1]):
                part = told[at : at + WINDOWS[-1]]
                if at and len(part) < WINDOWS[-1] // 2:
                    continue
                place = latent.projection[feature[part]].sum(axis=0)
                size = min(WINDOWS, key=lambda s: abs(np.log(s / len(part))))
                probes.setdefault(size, []).append((k, place / (np.linalg.norm(place) or 1), at))
        self._probes = {s: (np.array([p[0] for p in ps]), np.stack([p[1] for p in ps]).astype(np.float32).T.copy(), np.array([p[2] for p in ps])) for s, ps in probes.items()}
        self._index()

    def _index(self) -> None:
        """The items of each anchor, and of each item the words it must share, the anchors to find and the length of a stretch."""
        sizes = np.diff(self.items.at)
        self._least = np.maximum(1, np.ceil(self._shared * sizes - 1e-9).astype(np.int64))
        self._anchors = np.minimum(ANCHORS, self._least)
        self._span = sizes // 4 + 2 + sizes + sizes // 2 + 2
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((self._latent.rarity(self.items.words), owner))  # of equally rare words the first
        nth = np.arange(len(order)) - np.repeat(self.items.at[:-1], sizes)
        picked = nth < (sizes - self._least + self._anchors)[owner]
        words, owner = self.items.words[order][picked], owner[picked]
        self._blocks: list[tuple[Places, np.ndarray, np.ndarray]] = []
        for low in range(0, len(sizes), ITEM_BLOCK):
            a, z = np.searchsorted(owner, (low, low + ITEM_BLOCK))
            order = np.lexsort((owner[a:z], words[a:z]))
            every, mine = words[a:z][order], owner[a:z][order]
            once = np.concatenate([[True], (every[1:] != every[:-1]) | (mine[1:] != mine[:-1])])[: len(every)]
            anchors, n = np.unique(every[once], return_counts=True)
            if len(anchors):
                self._blocks.append((Places(anchors, 17), np.concatenate([[0], np.cumsum(n)]), mine[once]))

    def stretches(self, hashes: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Items, and the documents and first words of all stretches that share enough words with each; of those that share the same words, or fewer of them, the first."""
        for block in self._blocks:
            yield from self._stretches(block, hashes, limits)

    def _stretches(self, block: tuple[Places, np.ndarray, np.ndarray], hashes: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        places, first, owner = block
        at, entry = places.of(hashes)
        if not len(at):
            return
        n = first[entry + 1] - first[entry]
        item = owner[np.repeat(first[entry] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        keys = np.sort(item * len(hashes) + np.repeat(at, n))
        item, at = keys // max(len(hashes), 1), keys % max(len(hashes), 1)
        doc = np.searchsorted(limits, at, "right") - 1
        last = np.arange(len(at)) + self._anchors[item] - 1
        to = np.minimum(last, len(at) - 1)
        near = np.flatnonzero((last < len(at)) & (item[to] == item) & (doc[to] == doc) & (at[to] - at < self._span[item]))
        for k, rows in zip(*_runs(item[near]), strict=True):
            hit, d, span = at[near[rows]], doc[near[rows]], int(self._span[k])
            a, z = np.maximum(limits[d], hit - span + 1), np.minimum(limits[d + 1], hit + span)
            a[1:] = np.maximum(a[1:], z[:-1])  # each word once
            n = np.maximum(z - a, 0)
            place = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            known = self.items[k].sorted
            common = known[np.minimum(np.searchsorted(known, hashes[place]), len(known) - 1)] == hashes[place]
            place, d = place[common], np.repeat(d, n)[common]
            end = np.searchsorted(place, np.minimum(place + span, limits[d + 1]))
            kept = np.flatnonzero((end - np.arange(len(place)) >= self._least[k]) & np.concatenate([[True], end[1:] != end[:-1]])[: len(place)])
            if len(kept):
                yield k, d[kept], place[kept]

    def candidates(self, feature: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, items, and the places where the items may start, of texts of informative words only."""
        docs, items, places = [], [], []
        if len(feature):
            steps = self._latent.projection[feature]
            sums = np.zeros((len(steps) + 1, steps.shape[1]), np.float32)
            np.cumsum(steps, axis=0, out=sums[1:])
            ends = np.cumsum(own)
            first = ends - own
            for size, (keys, matrix, offsets) in self._probes.items():
                stride = max(1, size // 4)
                n = np.where(own > 0, np.maximum(0, -(-(own - size) // stride)) + 1, 0)
                doc = np.repeat(np.arange(len(own)), n)
                start = first[doc] + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * stride
                end = np.minimum(start + size, ends[doc])
                for i in range(0, len(start), 8192):
                    part = sums[end[i : i + 8192]]
                    part -= sums[start[i : i + 8192]]
                    least = np.sqrt(np.einsum("ij,ij->i", part, part)) * self._cosine[size <= 8] + 1e-6
                    scores = part @ matrix
                    hit = np.flatnonzero(scores.max(axis=1) >= least)
                    row, col = np.nonzero(scores[hit] >= least[hit, None])
                    row = hit[row]
                    docs.append(doc[row + i])
                    items.append(keys[col])
                    places.append(start[row + i] - offsets[col])
        return tuple(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (docs, items, places))

    def likely(self, told: np.ndarray, first: np.ndarray, end: np.ndarray, place: np.ndarray, item: Item) -> np.ndarray:
        """Which of the places (among informative words) have enough informative words of the item around them: of all words to share, its others can be the rest at most."""
        n = len(item.told)
        at = (place - n // 4 - 1)[:, None] + np.arange(n + n // 2 + n // 4 + 2)
        words = told[np.clip(at, 0, len(told) - 1)]
        common = item.told[np.minimum(np.searchsorted(item.told, words), n - 1)] == words
        common &= (at >= first[:, None]) & (at < end[:, None])
        return common.sum(axis=1) >= max(1, self._shared * len(item.words) - (len(item.words) - n))

    def verify(self, words: np.ndarray, item: Item, at: int) -> tuple[float, float, int, int] | None:
        """(shared, answered, first word, end word) of the item in the words around a place."""
        n = len(item.words)
        a, z = max(0, at - n // 4 - 2), min(len(words), at + n + n // 2 + 2)
        region = words[a:z]
        where = np.minimum(np.searchsorted(item.sorted, region), n - 1)
        common = item.sorted[where] == region
        if common.sum() < self._shared * n:
            return None
        of_item = region[common].tolist()
        whole, answer = item.bits
        got = subsequence(whole, n, of_item) / n
        if got < self._shared:
            return None
        told = subsequence(answer, len(item.answer), of_item) / len(item.answer)
        if told < self._answered:
            return None
        inside = np.flatnonzero(common)
        return got, told, a + int(inside[0]), a + int(inside[-1]) + 1

    def search(self, buf: np.ndarray, off: np.ndarray) -> list[dict[int, tuple[float, float, int, int]]]:
        """The best match of each item in each document."""
        return self.search_both(buf, off)[0]

    def search_both(self, buf: np.ndarray, off: np.ndarray) -> tuple[list[dict[int, tuple[float, float, int, int]]], list[dict[int, int]]]:
        """The best match of each item in each document, and the ways that led to one: 1 the cosine, 2 the words, 3 both."""
        hashes, counts = word_hashes(buf, off)
        out: list[dict[int, tuple[float, float, int, int]]] = [{} for _ in counts]
        ways: list[dict[int, int]] = [{} for _ in counts]
        feature = (hashes >> _SHIFT).astype(np.int64)
        told = np.flatnonzero(self._latent.informative[feature])
        limits = np.concatenate([[0], np.cumsum(counts)])
        cuts = np.searchsorted(told, limits)
        docs, items, places = self.candidates(feature[told], np.diff(cuts))
        words = hashes[told]
        order = np.argsort(items, kind="stable")
        for k, rows in zip(*_runs(items[order]), strict=True):
            at = order[rows]
            item, doc = self.items[k], docs[at]
            for i in range(0, len(at), 4096):
                part = slice(i, i + 4096)
                found = np.flatnonzero(self.likely(words, cuts[doc[part]], cuts[doc[part] + 1], places[at[part]], item)) + i
                for d, place in zip(doc[found].tolist(), places[at[found]].tolist(), strict=True):
                    if out[d].get(k, (0, 0))[:2] == (1, 1):
                        continue
                    start = int(limits[d])
                    best = self.verify(hashes[start : int(limits[d + 1])], item, int(told[max(place, int(cuts[d]))]) - start)
                    if best:
                        ways[d][k] = 1
                        out[d][k] = max(best, out[d].get(k, best))
        for k, at, places in self.stretches(hashes, limits):
            item = self.items[k]
            for d, place in zip(at.tolist(), places.tolist(), strict=True):
                if out[d].get(k, (0, 0))[:2] == (1, 1):
                    ways[d][k] |= 2
                    continue
                start = int(limits[d])
                best = self.verify(hashes[start : int(limits[d + 1])], item, place - start + len(item.words) // 4 + 2)
                if best:
                    ways[d][k] = ways[d].get(k, 0) | 2
                    out[d][k] = max(best, out[d].get(k, best))
        return out, ways


def _runs(sorted_keys: np.ndarray) -> tuple[list[int], list[slice]]:
    if not len(sorted_keys):
        return [], []
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])).tolist()
    return sorted_keys[first].tolist(), [slice(a, b) for a, b in zip(first, [*first[1:], len(sorted_keys)], strict=True)]


def bits_of(a: list) -> dict:
    """Of each element a number with a bit for each of its places."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    return places


def subsequence(places: dict, n: int, b: list) -> int:
    """Length of the longest common subsequence of n elements, by their bits, and another list."""
    row = full = (1 << n) - 1
    get = places.get
    for y in b:
        m = get(y)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    return subsequence(bits_of(a), len(a), b)


MATCHES = "matches array<struct<item:int,shared:double,answered:double,first_word:long,end_word:long,found_by:string>>"
WAYS = {1: "cosine", 2: "words", 3: "both"}


def marked(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, list]:
    """A struct `row` of all columns of each document, and its `matches` (of the items by number, the numbers' ids come beside); without any it is clean."""
    spark = docs.sparkSession
    arrow_batches(spark)
    if (items.agg(F.sum(F.octet_length(item_text_col))).first()[0] or 0) > MAX_ITEM_BYTES:
        raise ValueError(f"more than {MAX_ITEM_BYTES} bytes of items")
    rows = items.select(F.col(item_id_col).alias("id"), F.col(item_text_col).alias("text")).orderBy("id", "text").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items")
    told = [r["text"] or "" for r in rows]
    vocabulary = np.unique(word_hashes(*scan.flatten(pa.array(told, pa.string())))[0])
    shared = spark.sparkContext.broadcast(Searcher(Latent.fit(docs.select(F.col(text_col).alias("text")), vocabulary), told))  # bounded by the items
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = shared.value
        kind = pa.list_(pa.struct([("item", pa.int32()), ("shared", pa.float64()), ("answered", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("found_by", pa.string())]))
        for b in batches:
            buf, off = scan.flatten(b.column("row").field(place))
            for i, j in scan.chunks(off):
                found, ways = searcher.search_both(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                names = ("item", "shared", "answered", "first_word", "end_word", "found_by")
                cells = [[dict(zip(names, (k, *v, WAYS[w[k]]), strict=True)) for k, v in sorted(f.items())] for f, w in zip(found, ways, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("row").slice(i, j - i), pa.array(cells, kind)], names=["row", "matches"])

    whole = docs.select(F.struct(*docs.columns).alias("row"))
    return whole.mapInArrow(run, StructType([whole.schema["row"], *StructType.fromDDL(MATCHES)])), [r["id"] for r in rows]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_id_col: str = "item_id") -> DataFrame:
    """(id, item id, shared, answered, first_word, end_word, found_by) of every item that a document holds."""
    found, ids = marked(docs.select(F.col(id_col).alias("id"), "text"), items, item_id_col=item_id_col)
    found = found.select("row.id", "matches")
    spark = docs.sparkSession
    names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {items.schema[item_id_col].dataType.simpleString()}")
    cells = found.select("id", F.explode("matches").alias("m")).select("id", "m.*")
    return cells.join(F.broadcast(names), "item").select(F.col("id").alias(id_col), F.col("item_id").alias(item_id_col), "shared", "answered", "first_word", "end_word", "found_by")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
