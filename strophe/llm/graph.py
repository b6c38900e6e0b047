"""Connected components by alternating large and small stars on written edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import materialize


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a partition as stars around the smallest member: same components, fewer rounds."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    names = [x for x in parent if find(x) != x]
    yield pd.DataFrame({"u": [find(x) for x in names], "v": names}, dtype="int64")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge, but for the roots; ``edges``: (u, v), long.

    Each round is written to the shared folder. ``root`` is the smallest node of the component.
    """
    edges = materialize(edges.filter("u != v").mapInPandas(_forest, "u long, v long").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "stars")
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u != v")
        large = materialize(large.distinct(), "large-star")
        # small star: around the smallest of a node's smaller neighbours
        low = materialize(large.groupBy("v").agg(F.min("u").alias("m")), "low")
        near = large.join(low, "v")
        small = near.select(F.col("m").alias("u"), "v").union(near.select(F.col("m").alias("u"), F.col("u").alias("v")))
        edges = materialize(small.filter("u != v").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
