"""PageRank by Jacobi iteration: damping 0.85, teleport 1 - d for each node, dangling mass dropped, scores over their sum."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut

# Damping, most rounds, and the change below which it stops.
DAMPING, ROUNDS, EPSILON = 0.85, 100, 1e-4


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, epsilon: float = EPSILON) -> DataFrame:
    """nodes: id; edges: source_id, target_id, repeated ones counted.  id, page_rank_score.

    An edge to a missing node still counts in its source's out-degree.  Parallel edges are summed once, before the
    rounds, and each round shuffles sums by target only.
    """
    ids = cut(nodes.select("id").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("page_rank_score", F.lit(0.0))
    pairs = edges.groupBy("source_id", "target_id").agg(F.count("*").alias("k"))
    degree = pairs.groupBy("source_id").agg(F.sum("k").alias("d"))
    # Kept by source for all rounds, so that a round shuffles scores and sums only; lost blocks come from a short lineage.
    share = pairs.join(degree, "source_id").select("source_id", "target_id", (F.col("k") / F.col("d")).alias("w"))
    share = share.repartition("source_id").persist(StorageLevel.MEMORY_AND_DISK)
    scores = ids.withColumn("score", F.lit(1.0 / n))
    for _ in range(rounds):
        got = share.join(scores, share["source_id"] == scores["id"]).groupBy("target_id").agg(F.sum(F.col("w") * F.col("score")).alias("s"))
        new = scores.join(got, scores["id"] == got["target_id"], "left").select(
            "id", F.col("score").alias("old"), (F.lit(1 - damping) + damping * F.coalesce("s", F.lit(0.0))).alias("score")
        )
        new = cut(new)
        change = new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        scores = new.select("id", "score")
        if change < epsilon:
            break
    share.unpersist()
    total = scores.agg(F.sum("score")).first()[0]
    return scores.select("id", (F.col("score") / total).alias("page_rank_score"))
