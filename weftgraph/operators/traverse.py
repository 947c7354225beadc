"""Graph traversal: k-hop context, reverse impact, bounded containment, path products.

Frontiers stay DataFrames.  An edge touches a frontier by its source or its target: its ends are two rows of one left
semi join, because a join on "source or target" would be a nested loop.  Each hop uses the one before once, so plans grow
by a constant.  Frontiers are distinct before each join, so hubs meet each row once; AQE splits what is still skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import cut

#: Hops whose plan is kept whole; beyond that lineage is cut every hop.
PLAIN_HOPS = 3


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def touching(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Edges with an end in the frontier (id), twice where both are."""
    ends = edges.withColumn("_end", F.explode(F.array("source_id", "target_id")))
    return ends.join(frontier, ends["_end"] == frontier["id"], "left_semi").drop("_end")


def incident(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    return touching(edges, frontier).dropDuplicates(["id"])


def context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges within `hops` (at least one) undirected hops of the seeds (id).

    The edges of hop i + 1 hold those of hop i, so the last hop is the result, and hops before it read the ends of edges
    only.  Past PLAIN_HOPS it stops once a hop adds nothing.
    """
    frontier, size = seeds.select("id").distinct(), -1
    for hop in range(1, max(1, hops)):
        frontier = endpoints(touching(edges.select("source_id", "target_id"), frontier))
        if hop >= PLAIN_HOPS:
            frontier = cut(frontier)
            if (now := frontier.count()) == size:
                break
            size = now
    found = incident(edges, frontier)
    reached = endpoints(found).union(seeds.select("id")).distinct()
    return nodes.join(reached, "id", "left_semi"), found


def query_context(nodes, edges, file_path=None, symbol_type=None, relation_type=None, hops: int = 1):
    """context() of the nodes that match; edges are filtered before the traversal.  Empty filters match all."""
    seeds = where_all(nodes, file_path=file_path, entity_kind=symbol_type)
    return context(nodes, where_all(edges, relation_type=relation_type), seeds, hops)


def where_all(df: DataFrame, **equal) -> DataFrame:
    for name, value in equal.items():
        if value:
            df = df.where(F.col(name) == value)
    return df


def reachable(pairs: DataFrame, start: DataFrame, limit: int | None = None) -> DataFrame:
    """id, hop: everything reachable over pairs (a, b) from start (id), by the fewest hops; cycles are fine."""
    seen = cut(start.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier, hop = seen.select("id"), 0
    while limit is None or hop < limit:
        hop += 1
        step = pairs.join(frontier, pairs["a"] == frontier["id"], "left_semi").select(F.col("b").alias("id")).distinct()
        step = cut(step.join(seen, "id", "left_anti"))
        if step.isEmpty():
            break
        seen = cut(seen.unionByName(step.withColumn("hop", F.lit(hop))))
        frontier = step
    return seen


def impacted_files(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """file_path of every file that depends on a changed one (file_path), directly or not, and the changed ones.

    Without any dependent of a changed file everything is impacted; without a changed file nothing is.
    """
    place = nodes.select("id", "file_path")
    pairs = (
        edges.join(place.select(F.col("id").alias("source_id"), F.col("file_path").alias("b")), "source_id")
        .join(place.select(F.col("id").alias("target_id"), F.col("file_path").alias("a")), "target_id")
        .where("a <> b").select("a", "b").distinct()
    )
    start = changed.select(F.col("file_path").alias("id")).distinct()
    if start.isEmpty():
        return start.withColumnRenamed("id", "file_path")
    pairs = cut(pairs)
    if pairs.join(start, pairs["a"] == start["id"], "left_semi").isEmpty():
        every = nodes.select("file_path").union(start.select(F.col("id").alias("file_path")))
        return every.distinct()
    return reachable(pairs, start).select(F.col("id").alias("file_path"))


def containment(edges: DataFrame, root: DataFrame, depth: int = 3) -> DataFrame:
    """entity, edge_id, hop and path of 1 to `depth` CONTAINS steps out of root (id)."""
    steps = edges.where(F.col("relation_type") == "CONTAINS").select("source_id", "target_id", F.col("id").alias("edge_id"))
    at = root.select(F.col("id").alias("entity"), F.array("id").alias("path"))
    out = None
    for hop in range(1, depth + 1):
        at = at.join(steps, at["entity"] == steps["source_id"]).where(~F.array_contains("path", F.col("target_id"))).select(
            F.col("target_id").alias("entity"), "edge_id", F.lit(hop).alias("hop"), F.array_append("path", F.col("target_id")).alias("path")
        )
        out = at if out is None else out.unionByName(at)
        at = at.select("entity", "path")
    return out


def path_products(edges: DataFrame, start: DataFrame, score: Column, depth: int = 3, least: float = 0.3) -> DataFrame:
    """entity, hop, score: ends of directed walks of up to `depth` edges whose product of scores passes `least`.

    Scores lie in [0, 1], so a walk at or below the bound is dropped where it gets there.
    """
    steps = edges.select("source_id", "target_id", score.alias("w"))
    at = start.select(F.col("id").alias("entity"), F.lit(1.0).alias("score"))
    out = None
    for hop in range(1, depth + 1):
        at = at.join(steps, at["entity"] == steps["source_id"]).select(
            F.col("target_id").alias("entity"), F.lit(hop).alias("hop"), (F.col("score") * F.col("w")).alias("score")
        ).where(F.col("score") > least)
        out = at if out is None else out.unionByName(at)
        at = at.select("entity", "score")
    return out
