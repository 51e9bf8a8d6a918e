"""Near-duplicate documents by MinHash with tensored banding.

`half` left and `half` right half-keys are made from `rows` minhashes each; table
(i, j) keys a document by left half-key i and right half-key j. So half * half
tables cost 2 * half * rows minhashes, about the square root of what as many
separate tables would. A pair of similarity s shares a table with probability
(1 - (1 - s**rows)**half)**2: 0.9996 at 0.8 with the defaults, more above.

1. Documents with the same shingle set form one class; only classes go on.
2. Classes that share a left half-key with another one are keyed by their tables.
3. Candidates are pairs that share a table, confirmed on the full shingle sets of
   both texts in two passes: each class with the hub of one of its tables, the class
   that shares most left half-keys with others; then, in tables whose classes still
   belong to several components, the classes outside of the largest one with all
   others. The last pass compares parities of the sets in blocks before it makes a
   pair: their differing bits never exceed the differing shingles, so no similar
   pair is lost. Tables with many such classes are parted before by the shingles that are rare
   in them, two similar sets sharing one of their rarest. A pair is made in the first of the tables that it shares, and not
   if its ends are already connected, for its link can't change a component.

Words are maximal runs other than white space, A-Z lower-cased. A document's set
has its distinct `width`-word shingles; with fewer words, the whole sequence as
one shingle.

Defined cases: a null or empty text has the empty set and is linked with nothing;
its component is itself. Null ids are kept; an id's component is the least id that
isn't null reachable from it (null if there is none). Rows that repeat an id are
documents of their own. An empty table gives no rows; further columns are
ignored; whole texts of any length count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.llm import scan
from lagoon.llm.components import components
from lagoon.llm.shared import Table, arrow_batches, write

HALF, ROWS = 12, 3


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    low = scan.LOWER[buf]
    starts, ends, counts = scan.words(low, off, scan.NOT_SPACE)
    hashes = scan.Prefix(low).of(starts, ends)
    grams, _ = scan.ngrams(hashes, counts, width)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(grams[at : at + n - width + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for h in hashes[at : at + n]:
                whole = scan.mix(whole + h)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


class HalfKeys:
    def __init__(self, half: int, rows: int, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.half, self.rows = half, rows
        n = 2 * half * rows
        self._a = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._b = r.integers(0, 1 << 63, n, dtype=np.uint64)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """2 * half keys: the left ones, then the right ones."""
        least = np.full(len(self._a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 4096):
            x = shingles[i : i + 4096, None] * self._a[None, :]
            x += self._b
            np.minimum(least, x.min(axis=0), out=least)
        least = least.reshape(2 * self.half, self.rows)
        key = np.arange(2 * self.half, dtype=np.uint64)
        for r in range(self.rows):
            key = scan.mix(key + least[:, r])
        return key.view(np.int64)


def parity(shingles: np.ndarray) -> bytes:
    """Whether each of 2 or more buckets for a shingle holds an odd number of them. Two sets differ in at least as many shingles as their parities in bits."""
    bits = max(64, 2 << int(max(1, len(shingles)) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of every row of a with every row of b, at the width of the narrower: buckets of the wider are the narrower's, split by upper bits of the hash."""
    width = min(a.shape[1], b.shape[1])
    narrow = [np.bitwise_xor.reduce(x.reshape(len(x), -1, width), axis=1) if x.shape[1] > width else x for x in (a, b)]
    a, b = (np.ascontiguousarray(x).view(np.uint64) for x in narrow)
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def signatures(docs: DataFrame, width: int, half: int, rows: int) -> DataFrame:
    """(id, text_hash, n_shingles, set_key, parity, lefts, rights); set_key is a 128-bit digest of the shingle set, null if it is empty."""
    arrow_batches(docs.sparkSession)
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = HalfKeys(half, rows)
        for b in batches:
            buf, off = scan.flatten(b.column("text"))
            for i, j in scan.chunks(off):
                sets = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                digest, odd, left, right = [], [], [], []
                for s in sets:
                    if len(s):
                        digest.append(scan.mix(s).sum().tobytes() + scan.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().tobytes())
                        odd.append(parity(s))
                        k = keys.of(s)
                        left.append(k[:half])
                        right.append(k[half:])
                    else:
                        digest.append(None)
                        odd.append(None)
                        left.append(None)
                        right.append(None)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, j - i), b.column("text_hash").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(odd, pa.binary()), pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))],
                    names=["id", "text_hash", "n_shingles", "set_key", "parity", "lefts", "rights"],
                )

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, f"id {id_type}, text_hash long, n_shingles long, set_key binary, parity binary, lefts array<long>, rights array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    sides = pairs.join(texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a")), "a")
    sides = sides.join(texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            keys_b = batch.column("b").to_pylist()
            (buf_a, off_a), (buf_b, off_b) = scan.flatten(batch.column("text_a")), scan.flatten(batch.column("text_b"))
            keep = []
            for i, j in scan.chunks(off_a):
                for k, s in zip(range(i, j), shingle_sets(buf_a[off_a[i] : off_a[j]], off_a[i : j + 1] - off_a[i], width), strict=True):
                    if keys_b[k] != hub:
                        hub = keys_b[k]
                        hub_set = shingle_sets(buf_b[off_b[k] : off_b[k + 1]], np.array([0, off_b[k + 1] - off_b[k]]), width)[0]
                    n, m = len(s), len(hub_set)
                    if 100 * min(n, m) < percent * max(n, m):
                        continue
                    both = np.concatenate([s, hub_set])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (n + m - common):
                        keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, half: int = HALF, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each document; texts whose sets have a Jaccard similarity of percent / 100 or more are linked; under 50 percent, at which the tables lose pairs, it is refused."""
    if percent < 50:
        raise ValueError(f"percent must be 50 or more, not {percent}")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = write(signatures(source, width, half, rows), "signatures")
    classes = write(
        marked.df.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n"), F.first("parity").alias("parity"), F.first("lefts").alias("lefts"), F.first("rights").alias("rights")),
        "classes",
    )

    # tables, only for classes that share a left half-key
    left = classes.df.select("set_key", F.posexplode("lefts").alias("i", "left"))
    # written, so that the joins' sides are plain exchanges, whose hot partitions Spark can split
    met = write(left.groupBy("i", "left").agg(F.count("*").alias("n")).where("n > 1"), "met")
    lefts = write(left.join(met.df, ["i", "left"]).groupBy("set_key").agg(F.collect_list(F.struct("i", "left")).alias("met"), F.sum("n").alias("degree")), "lefts")  # `half` entries at most
    crossed = lefts.df.join(classes.df.select("set_key", "rights"), "set_key").select("set_key", "degree", "rights", F.explode("met").alias("l"))
    keyed = write(crossed.select("set_key", "degree", "l", F.posexplode("rights").alias("j", "right")).select(F.xxhash64("l.i", "l.left", "j", "right").alias("t"), "set_key", "degree", (F.col("l.i") * half + F.col("j")).cast("int").alias("ij")), "tables")
    hubs = write(keyed.df.groupBy("t").agg(F.max(F.struct("degree", "set_key")).alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"), "hubs")
    shared = write(keyed.df.join(hubs.df, "t").select("t", "ij", "set_key", F.col("hub.set_key").alias("hub"), F.col("hub.degree").alias("of")), "shared")
    best = write(shared.df.groupBy("set_key").agg(F.max(F.struct("of", "hub")).alias("h")).select(F.col("set_key").alias("a"), F.col("h.hub").alias("b")), "best")

    # whole texts of the classes that have a candidate
    reps = classes.df.join(best.df.select(F.col("a").alias("set_key")), "set_key").select("set_key", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    hashed = source.withColumn("text_hash", F.xxhash64("text"))
    found = hashed.join(reps, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash")))
    texts = write(found.select("set_key", "text").dropDuplicates(["set_key"]), "texts")

    roots = _roots(write(_confirmed(best.df.where("a != b"), texts.df, width, percent), "links"))
    groups = shared.df.select(F.col("set_key").alias("a"), F.col("t").alias("g"), "ij")
    tested = best.df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    groups, refined = _refined(groups, texts.df, roots, percent, width)
    rest = write(_left_over(groups, classes.df, roots, percent, half).join(tested, ["a", "b"], "left_anti"), "rest")
    roots = _joined(roots, write(_confirmed(rest.df, texts.df, width, percent), "links"))
    for t in (classes, met, lefts, keyed, hubs, shared, texts, best, rest, *refined):
        t.drop()

    joined = marked.df.join(roots.df.select(F.col("a").alias("set_key"), F.col("b").alias("root")), "set_key", "left")
    rooted = joined.select("id", "text_hash", "n_shingles", F.coalesce("root", "set_key").alias("root"))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    out = rooted.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "root")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near duplicates: of each component the document with the least id, of rows that repeat it the one with the least hash of its text."""
    kept = near_duplicates(docs, width, percent, id_col=id_col, text_col=text_col).where("kept")
    rows = F.struct(F.col(id_col).alias("_rid"), F.col("text_hash").alias("_rh"))
    stay = kept.where("root IS NOT NULL").groupBy("root").agg(F.min(rows).alias("r")).select("r.*").unionByName(kept.where("root IS NULL").select(rows.alias("r")).select("r.*").distinct())
    hashed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    found = hashed.join(stay, F.col("id").eqNullSafe(F.col("_rid")) & (F.col("h") == F.col("_rh")), "left_semi")
    return found.dropDuplicates(["id", "h"]).select("row.*")


def _roots(links: Table) -> Table:
    """(a, b): each class with a link (a, b) and the root of its tree. A link leads to a class of greater degree, so there are no cycles; each step doubles the length of a jump."""
    now = links
    while True:
        further = now.df.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumped = write(now.df.join(further, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "roots")
        now.drop()
        now = Table(jumped.spark, jumped.path, jumped.df.select("a", "b").schema)
        if jumped.df.where("moved").isEmpty():
            return now


def _joined(roots: Table, links: Table) -> Table:
    """The roots after further links, which join whole components."""
    out = roots
    if not links.df.isEmpty():
        between = write(_rooted(_rooted(links.df, "a", roots), "b", roots).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "between")
        merged = components(between.df)
        tops = merged.df.select(F.col("a").alias("b"), F.col("b").alias("top"))
        moved = roots.df.join(tops, "b", "left").select("a", F.coalesce("top", "b").alias("b"))
        out = write(moved.unionByName(merged.df.join(roots.df.select("a"), "a", "left_anti")), "roots")
        for t in (between, merged, roots):
            t.drop()
    links.drop()
    return out


def _rooted(df: DataFrame, key: str, roots: Table) -> DataFrame:
    found = df.join(roots.df.select(F.col("a").alias(key), F.col("b").alias(f"root_{key}")), key, "left")
    return found.withColumn(f"root_{key}", F.coalesce(f"root_{key}", key))


BLOCK = 512
#: Classes outside of a table's largest component from which on the table is parted by rare shingles.
LARGE = 8 * BLOCK


def _refined(groups: DataFrame, texts: DataFrame, roots: Table, percent: int, width: int) -> tuple[DataFrame, list[Table]]:
    """The tables (a, g, ij), large ones parted by shingle, and what was written for that.

    Of a set of n shingles a similar one lacks at most n - ceil(n * percent / 100), so
    one more than that many of its shingles, the rarest in the table, hold one that is
    among the other's own rarest: classes that share none of them aren't similar.
    A passage that many texts share is common in its table, and brings no two together.
    """
    parts = _rooted(groups, "a", roots).groupBy("g", "root_a").agg(F.count("*").alias("n"))
    large = write(parts.groupBy("g").agg((F.sum("n") - F.max("n")).alias("out")).where(F.col("out") > LARGE).select("g"), "large")
    if large.df.isEmpty():
        return groups, [large]
    picked = write(groups.join(large.df, "g"), "picked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = scan.flatten(b.column("text"))
            for i, j in scan.chunks(off):
                sets = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                yield pa.RecordBatch.from_arrays([b.column("a").slice(i, j - i), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["a", "set"])

    asked = texts.withColumnRenamed("set_key", "a").join(picked.df.select("a").distinct(), "a")
    sets = write(asked.select("a", "text").mapInArrow(run, "a binary, set array<long>"), "sets")
    held = write(picked.df.join(sets.df, "a").select("g", "ij", "a", F.size("set").alias("n"), F.explode("set").alias("s")), "held")
    counts = write(held.df.groupBy("g", "s").agg(F.count("*").alias("f")), "counts")
    rank = F.row_number().over(Window.partitionBy("g", "a").orderBy("f", "s"))
    first = held.df.join(counts.df, ["g", "s"]).withColumn("k", rank).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    told = first.where("f > 1").select("a", F.xxhash64("g", "s").alias("g"), "ij")
    return groups.join(large.df, "g", "left_anti").select("a", "g", "ij").unionByName(told), [large, picked, sets, held, counts]


def _left_over(groups: DataFrame, classes: DataFrame, roots: Table, percent: int, half: int) -> DataFrame:
    """Unconnected pairs (a, b) that share a table and may be similar enough.

    In each table of several components, the classes outside of its largest one
    meet all others, in blocks of about `BLOCK` by `BLOCK` classes. A pair comes out
    only if its parities allow it to be similar enough: of sets of n and m shingles,
    at most (n + m) * (100 - percent) / (100 + percent) may be in one only.
    """
    rooted = _rooted(groups, "a", roots).withColumnRenamed("root_a", "root")
    parts = rooted.groupBy("g", "root").agg(F.count("*").alias("n"))
    of_group = parts.groupBy("g").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("most")).where("parts > 1")
    split = of_group.select("g", F.col("most.root").alias("main"), F.ceil((F.col("all") - F.col("most.n")) / BLOCK).alias("n_out"), F.ceil(F.col("all") / BLOCK).alias("n_in"))
    sets = classes.select(F.col("set_key").alias("a"), F.col("n").alias("size"), "parity", "lefts", "rights")
    rows = rooted.join(split, "g").join(sets, "a")
    place = lambda n, salt: F.pmod(F.xxhash64("a", F.lit(salt)), F.col(n))
    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = ["ij", "a", "root", "size", "parity", "lefts", "rights"]
    outside = rows.where("root != main").withColumn("x", place("n_out", 1)).select("g", "x", steps("n_in").alias("y"), F.lit(0).alias("side"), F.lit(True).alias("out"), *cols)
    others = rows.withColumn("y", place("n_in", 2)).select("g", steps("n_out").alias("x"), "y", F.lit(1).alias("side"), (F.col("root") != F.col("main")).alias("out"), *cols)
    cells = outside.unionByName(others).select(F.xxhash64("g", "x", "y").alias("cell"), "g", "x", "y", "side", "out", *cols)

    def meet(rows: list[dict]) -> Iterator[tuple[bytes, bytes]]:
        near: dict[tuple[int, int], list[dict]] = {}
        for r in rows:
            near.setdefault((r["side"], len(r["parity"])), []).append(r)
        for (side, wide), a in near.items():
            for (other, width), b in near.items():
                if side or not other or max(wide, width) > 2 * min(wide, width):
                    continue
                bits = differing_bits(*(np.frombuffer(b"".join(r["parity"] for r in x), np.uint8).reshape(len(x), -1) for x in (a, b)))
                n, m = (np.array([r["size"] for r in x]) for x in (a, b))
                i, j = np.nonzero(bits * (100 + percent) <= (n[:, None] + m[None, :]) * (100 - percent))
                if not len(i):
                    continue
                # of the tables that a pair shares, the first one makes it
                left, right = ((np.array([r[k] for r in a])[i] == np.array([r[k] for r in b])[j]).argmax(axis=1) for k in ("lefts", "rights"))
                mine = np.flatnonzero(left * half + right == a[0]["ij"])
                for p, q in ((a[x], b[y]) for x, y in zip(i[mine].tolist(), j[mine].tolist(), strict=True)):
                    if p["root"] != q["root"] and (not q["out"] or p["a"] < q["a"]):
                        yield (p["a"], q["a"]) if p["a"] < q["a"] else (q["a"], p["a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and (held[0]["g"], held[0]["x"], held[0]["y"]) != (r["g"], r["x"], r["y"]):
                    yield _pairs(set(meet(held)))
                    held = []
                held.append(r)
        yield _pairs(set(meet(held)))

    return cells.repartition("cell").sortWithinPartitions("cell", "g", "x", "y").mapInArrow(run, "a binary, b binary").distinct()


def _pairs(found: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4).select("doc_id", "n_shingles", "component_id", "kept")
