"""Hits of caches that keep the keys used last, from reuse distances. (O122, O237, O238)

An access hits a cache of some capacity if that many keys, its own included, were
used since the key's last use. A trace is cut into blocks of positions; what the
largest cache holds at the start of a block is the latest keys of all blocks before,
which are merged in two levels. The blocks are then read side by side.

Policies that aren't a function of the latest keys (clock hands, adaptive borders,
frequency sketches) have no such form and aren't offered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.operators.ranks import in_order, offsets

#: Blocks of one upper block.
FAN = 64


def _latest(df: DataFrame, groups: list[str], most: int) -> DataFrame:
    """The keys that each group used last, with the positions of those uses."""
    last = df.groupBy(*groups, "_k").agg(F.max("_p").alias("_p"))
    return last.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("_p")))).where(F.col("_n") <= most).drop("_n")


def _held_before(latest: DataFrame, groups: list[str], step: str, most: int) -> DataFrame:
    """What is held when each step begins: the latest keys of all steps before. Rows of (groups, step, key, position) come and go; one group's keys at a time are in memory."""
    rows = latest.select(*groups, step, "_k", "_p")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at, held, out = None, None, {}, []
        for b in batches:
            kind = b.schema
            for *g, s, k, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != of:
                    of, at, held = g, s, {}
                elif s != at:
                    at = s
                    out += [(*g, s, *kp) for kp in held.items()]
                held.pop(k, None)
                held[k] = p
                if len(held) > most:
                    del held[next(iter(held))]
                if len(out) > 10_000:
                    yield _batch(out, kind)
                    out = []
        if out:
            yield _batch(out, kind)

    return in_order(rows, groups, [step, "_p"]).mapInArrow(run, fields)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


def distances(keys: list) -> np.ndarray:
    """Of each access the number of keys used since the key's last use, itself included; 0 at its first.

    With the place of the last use of each access's key, that is the accesses before it
    whose own last use is no later than its, less its last use's place. They are counted
    for all accesses at once: halves of ever longer stretches, the left one's against the
    right one's, by sorting.
    """
    n, seen = len(keys), {}
    last = np.full(n, -1, np.int64)
    for i, k in enumerate(keys):
        last[i] = seen.get(k, -1)
        seen[k] = i
    before, place, width = np.zeros(n, np.int64), np.arange(n), 1
    while width < n:
        order = np.lexsort((place, last, place // (2 * width)))
        left = (place[order] // width) % 2 == 0
        so_far = np.cumsum(left)
        stretch = place[order] // (2 * width)
        first = np.searchsorted(stretch, stretch)
        so_far -= np.where(first > 0, so_far[first - 1], 0)
        before[order[~left]] += so_far[~left]
        width *= 2
    return np.where(last >= 0, before - last, 0)


def reuse_distances(trace: DataFrame, shard: Column, key: str, order: str, most: int, width: int, block: int | None = None) -> DataFrame:
    """(shard, key, position, distance) of every access: the number of keys used since the key's last use, itself included, or null if there are more than `most` or it wasn't used before.

    `order` is a number that no two accesses of a shard share; some `width` of it are
    sorted together. Accesses without an order are left out; a null key is a key.
    Time grows with the rows, and memory with a block's rows and `most`.
    """
    block = block or max(4096, FAN * most)
    rows = trace.where(F.col(order).isNotNull()).select(shard.alias("shard"), F.col(key).alias("_k"), F.col(order).alias("_o"))
    rows = offsets(rows, ["_o"], F.floor(F.col("_o") / width), ["shard"], "_p").withColumn("_p", F.col("_p").cast("long")).drop("_o")
    rows = rows.withColumn("_block", F.floor(F.col("_p") / block)).withColumn("_upper", F.floor(F.col("_block") / FAN))
    of_block = _latest(rows, ["shard", "_upper", "_block"], most)
    upper = _held_before(_latest(of_block, ["shard", "_upper"], most), ["shard"], "_upper", most).withColumn("_block", F.lit(-1).cast("long"))
    held = _held_before(upper.unionByName(of_block), ["shard", "_upper"], "_block", most)
    all_rows = held.select("shard", "_block", "_k", "_p", F.lit(True).alias("_held")).unionByName(rows.select("shard", "_block", "_k", "_p", F.lit(False).alias("_held")))
    kinds = all_rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, block, schema = None, [], None

        def made() -> pa.RecordBatch:
            found = distances([k for _, k, _, _ in block])
            rows = [(s, k, p, int(d) if 0 < d <= most else None) for (s, k, p, held_before), d in zip(block, found, strict=True) if not held_before]
            kinds_ = [schema.field("shard").type, schema.field("_k").type, pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds_)], names=["shard", "key", "position", "distance"])

        for b in batches:
            schema = b.schema
            for s, n, k, p, held_before in zip(*(b.column(c).to_pylist() for c in ("shard", "_block", "_k", "_p", "_held")), strict=True):
                if (s, n) != of:
                    if block:
                        yield made()
                    of, block = (s, n), []
                block.append((s, k, p, held_before))
        if block:
            yield made()

    fields = f"shard {kinds['shard'].dataType.simpleString()}, key {kinds['_k'].dataType.simpleString()}, position long, distance int"
    return in_order(all_rows, ["shard", "_block"], ["_p"]).mapInArrow(run, fields)


def replay(trace: DataFrame, shard: Column, key: str, order: str, capacities: list[int], width: int, block: int | None = None) -> DataFrame:
    """(shard, capacity, hits, misses, hit_ratio) of caches of several capacities over the same trace."""
    distances = reuse_distances(trace, shard, key, order, max(capacities), width, block)
    totals = distances.groupBy("shard").agg(F.count("*").alias("_n"), *(F.count_if(F.col("distance") <= c).alias(f"_{c}") for c in capacities))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("capacity"), F.col(f"_{c}").alias("hits")) for c in capacities))).alias("e")
    out = totals.select("shard", each, "_n").select("shard", "e.capacity", "e.hits", (F.col("_n") - F.col("e.hits")).alias("misses"))
    return out.withColumn("hit_ratio", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6))
