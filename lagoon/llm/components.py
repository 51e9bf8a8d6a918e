"""Connected components by alternating large-star and small-star steps.

Both steps only shrink towards the smallest neighbour, so the number of edges
never grows, a star's centre is found by pre-aggregated minima, and nothing of a
component is gathered in one task. Each step is written, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.shared import Table, write


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.join(_minima(both), "a").where("b > a")
    return joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them; edges lead from larger to smaller."""
    joined = edges.join(_minima(edges), "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(edges: DataFrame) -> Table:
    """(node, root) for every node of an edge that isn't itself the least of its component; edges have columns a and b of one ordered type."""
    start = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = write(start, "edges")
    seen = None
    while True:
        large = write(_large_star(now.df), "large")
        now.drop()
        now = write(_small_star(large.df), "small")
        large.drop()
        state = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return Table(now.spark, now.path, now.df.select(F.col("a"), F.col("b")).schema)
        seen = state
