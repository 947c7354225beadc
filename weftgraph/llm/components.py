"""Connected components by alternating large and small stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: a, b (long).  node, component for every node with a link, the component being its smallest node.

    Each round ties a node's larger neighbours, then its smaller ones, to the smallest; rounds grow with the logarithm
    of the longest chain.  Rounds are written to the shared folder, so no lineage builds up.
    """
    tidy = lambda df: df.where("u <> v").distinct()
    now = materialize(tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), name)
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u"), F.least("u", "w").alias("w"))
        large = tidy(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v"))
        now = materialize(tidy(small.unionByName(least.select("u", F.col("w").alias("v")))), name)


class Sets:
    """Union-find inside one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
        return a != b
