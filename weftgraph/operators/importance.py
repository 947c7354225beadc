"""Importance scores by stages, top shares, and the plug points for scorers and taggers.

The scorers of this engine are deterministic formulas; a model behind a service can take their place as a
mapInPandas function.  Both see batches, so a service is called once a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Batch sizes of scoring and tagging, the top share, and the range of a score.
SCORE_BATCH, TAG_BATCH, TOP_SHARE, LOWEST, HIGHEST = 10, 100, 0.2, 1, 100
#: So many nodes at most are broadcast to the edges that hold them.
MANY = 1_000_000


def top_share(df: DataFrame, score: str, share: float = TOP_SHARE, by: list[str] | None = None) -> DataFrame:
    """The best max(1, int(n * share)) rows, ties by id: of all rows, or of each group.

    Without groups the size comes from a count and the rows from a distributed top-k, so nothing is sorted in one task
    beyond the rows kept.
    """
    if by:
        w = W.partitionBy(*by)
        rank = F.row_number().over(w.orderBy(F.desc(score), "id"))
        keep = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * F.lit(share)))
        return df.withColumns({"_rank": rank, "_keep": keep}).where("_rank <= _keep").drop("_rank", "_keep")
    n = df.count()
    return df.orderBy(F.desc(score), "id").limit(min(n, max(1, int(n * share))))


def important_nodes(nodes: DataFrame, threshold: float) -> DataFrame:
    """id, type, importance of nodes at or above the threshold's whole part; a missing score is 0."""
    score = F.coalesce(F.col("importance"), F.lit(0))
    return nodes.select("id", "type", score.alias("importance")).where(F.col("importance") >= int(threshold))


def metric_score(*metrics: str) -> Column:
    """1 to 100 from metric columns: a saturating sum of their logarithms."""
    total = sum((F.log1p(F.coalesce(F.col(m), F.lit(0)).cast("double")) for m in metrics), F.lit(0.0))
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.round(100 * (1 - F.exp(-total / 4))))).cast("int")


def score_batches(nodes: DataFrame, scorer: Callable, batch: int = SCORE_BATCH) -> DataFrame:
    """id, importance from scorer(list of row dicts) -> {id: score}, called once for each `batch` rows; clamped."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = frame.to_dict("records")
            for i in range(0, len(rows), batch):
                got = scorer(rows[i : i + batch])
                yield pd.DataFrame({"id": list(got), "importance": [max(LOWEST, min(HIGHEST, int(v))) for v in got.values()]})

    return nodes.mapInPandas(run, "id string, importance int")


def tag_batches(functions: DataFrame, tagger: Callable, batch: int = TAG_BATCH) -> DataFrame:
    """id, tags from tagger(list of row dicts) -> {id: [tag]}, called once for each `batch` rows."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = frame.to_dict("records")
            for i in range(0, len(rows), batch):
                got = tagger(rows[i : i + batch])
                yield pd.DataFrame({"id": list(got), "tags": [list(v) for v in got.values()]})

    return functions.mapInPandas(run, "id string, tags array<string>")


def keyword_tags(name: Column | str) -> Column:
    """Default tags by the words of a function's name."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    words = {
        "testing": "test|mock|fixture", "utility": "util|helper|format|convert|parse", "io": "read|write|load|save|open",
        "network": "http|request|client|server|fetch", "storage": "db|query|store|cache", "lifecycle": "init|start|stop|close|new",
    }
    found = F.array(*(F.when(F.regexp_like(low, F.lit(p)), F.lit(t)) for t, p in words.items()))
    return F.filter(found, lambda t: t.isNotNull())


def members(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """owner, id: what owners hold over has_* edges; one equi join, in which up to MANY nodes go to the edges."""
    held = edges.where(F.col("relation_type").isin(*relations)).select(F.col("source_id").alias("owner"), F.col("target_id").alias("id"))
    own = nodes.where(F.col("type").isin(*kinds))
    return held.join(F.broadcast(own) if own.limit(MANY + 1).count() <= MANY else own, "id")


def staged_importance(nodes: DataFrame, edges: DataFrame, score: Column) -> DataFrame:
    """id, type, importance: packages; functions and structs of the top fifth of packages; methods of the top fifth of
    structs.  Functions of test files get none.  nodes: id, type and the metrics that score uses."""
    scored = nodes.withColumn("importance", score)
    packages = scored.where("type = 'package'")
    best = top_share(packages, "importance").select(F.col("id").alias("owner"))
    inner = members(scored, edges, ("has_function", "has_struct"), ("function", "struct")).join(best, "owner", "left_semi")
    inner = inner.where(~((F.col("type") == "function") & F.contains("id", F.lit("_test.go"))))
    top = top_share(inner.where("type = 'struct'").dropDuplicates(["id"]), "importance").select(F.col("id").alias("owner"))
    methods = members(scored, edges, ("has_method",), ("function",)).join(top, "owner", "left_semi")
    pick = lambda df: df.select("id", "type", "importance")
    return pick(packages).unionByName(pick(inner)).unionByName(pick(methods)).dropDuplicates(["id"])


def prompt(kind: str, lines: Column) -> Column:
    """Text of one batch for a scoring service."""
    return F.concat(F.lit(f"Rate the importance of each {kind} from {LOWEST} to {HIGHEST}; answer as JSON.\n"), lines)


def batch_prompts(nodes: DataFrame, kind: str, batch: int = SCORE_BATCH) -> DataFrame:
    """batch, prompt: `batch` nodes each, in id order within a hash bucket, so that no global sort is needed."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(64))
    place = F.row_number().over(W.partitionBy(bucket).orderBy("id")) - 1
    numbered = nodes.withColumn("batch", F.concat_ws("-", bucket, F.floor(place / batch)))
    line = F.concat(F.lit("- "), F.col("id"))
    return numbered.groupBy("batch").agg(prompt(kind, F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("prompt"))
