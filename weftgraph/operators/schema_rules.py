"""Declared rules and templates of the graph schema as queries: impact, thresholds, coverage, search, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .traverse import context, path_products, reachable

# Complexity thresholds, hops and least score of a change's impact, and the range of a complexity.
CYCLOMATIC, COGNITIVE, IMPACT_HOPS, IMPACT_SCORE, VALUE_RANGE = 15, 20, 3, 0.3, (1, 50)


def dependency_impact(edges: DataFrame, changed: DataFrame, relation: str = "DEPENDS_ON") -> DataFrame:
    """id, hop of everything that changed (id) reaches over `relation` edges."""
    pairs = edges.where(F.col("relation_type") == relation).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return reachable(pairs.distinct(), changed).where("hop > 0")


def complexity_flags(entities: DataFrame) -> DataFrame:
    return entities.where((F.col("cyclomatic") > CYCLOMATIC) | (F.col("cognitive") > COGNITIVE))


def coverage(changed: DataFrame, edges: DataFrame, relation: str = "VERIFIES") -> DataFrame:
    """id, tests, covered of changed entities (id) by edges from tests."""
    n = edges.where(F.col("relation_type") == relation).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
    return changed.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("tests"), (F.coalesce("n", F.lit(0)) > 0).alias("covered"))


def code_search(entities: DataFrame, words: str, *columns: str) -> DataFrame:
    """Entities with the words in one of the columns; case counts."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.col(c), F.lit(words)), F.lit(False))
    return entities.where(hit)


def change_impact(edges: DataFrame, changed: DataFrame, score, hops: int = IMPACT_HOPS, least: float = IMPACT_SCORE) -> DataFrame:
    """entity, best_score, hops over walks of up to `hops` edges whose product of scores passes `least`."""
    ends = path_products(edges, changed, score, hops, least)
    return ends.groupBy("entity").agg(F.max("score").alias("best_score"), F.array_sort(F.collect_set("hop")).alias("hops"))


def context_retrieval(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, kinds: tuple[str, ...], hops: int = 2):
    """Undirected context over some relation types."""
    return context(nodes, edges.where(F.col("relation_type").isin(*kinds)), seeds, hops)


def violations(df: DataFrame, unique: list[str] = (), required: list[str] = (), ranges: dict | None = None) -> DataFrame:
    """rule, detail, rows: broken constraints; no rows if all hold."""
    out = df.sparkSession.createDataFrame([], "rule string, detail string, rows long")
    if unique:
        again = df.groupBy(*unique).count().where("count > 1")
        out = out.unionByName(again.agg(F.count("*").alias("rows")).select(F.lit("unique").alias("rule"), F.lit(",".join(unique)).alias("detail"), "rows"))
    checks = {("required", c): F.col(c).isNull() | (F.col(c).cast("string") == "") for c in required}
    checks |= {("range", c): ~F.col(c).between(*r) for c, r in (ranges or {}).items()}
    if checks:  # one pass for all of them
        counts = df.agg(*(F.count_if(x).alias(f"c{i}") for i, x in enumerate(checks.values())))
        rows = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(c).alias("detail"), F.col(f"c{i}").alias("rows")) for i, (k, c) in enumerate(checks)))
        out = out.unionByName(counts.select(F.inline(rows)))
    return out.where("rows > 0")


def cardinality(edges: DataFrame, relation: str, most: int) -> DataFrame:
    """source_id, n of sources with more than `most` edges of a relation."""
    n = edges.where(F.col("relation_type") == relation).groupBy("source_id").agg(F.count("*").alias("n"))
    return n.where(F.col("n") > most)
