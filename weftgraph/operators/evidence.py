"""Evaluation reports over case results: means, rank percentile, failure counts, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.lineage import cut


def rank_percentiles(rows: DataFrame, by: list[str], value: str, share: float = 0.95) -> DataFrame:
    """by, value: of each group the value at 1-based rank max(int(n * share), 1), without interpolation; nulls left out.

    Equal values are counted first and dealt out by ranges of group and value, so a group lies in many tasks; its ranks
    are the counts before each range, one row a range, plus running counts inside it.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    counted = cut(counted.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    ranges = counted.groupBy(*by, "_range").agg(F.sum("_n").alias("_n"))
    whole = W.partitionBy(*by)
    ranges = ranges.select(
        *(F.col(c).alias(f"_{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), F.sum("_n").over(whole).alias("_all"),
        (F.sum("_n").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    inside = F.sum("_n").over(W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    upto = counted.withColumn("_upto", inside).join(ranges, same).withColumn("_upto", F.col("_upto") + F.col("_before"))
    rank = F.greatest(F.floor(F.col("_all") * F.lit(share)), F.lit(1))
    return upto.where(F.col("_upto") >= rank).groupBy(*by).agg(F.min(value).alias(value))


def failure_taxonomy(cases: DataFrame) -> DataFrame:
    return cases.where(F.coalesce(F.col("failure_type"), F.lit("")) != "").groupBy("failure_type").agg(F.count("*").alias("cases"))


def report(cases: DataFrame, month: str | None = None) -> DataFrame:
    """One row: month, total, means, p95 latency, failure counts by type.  Raises on no cases."""
    if cases.isEmpty():
        raise ValueError("a report needs at least one case")
    head = cases.agg(
        F.count("*").alias("total_cases"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("false_positive_count").alias("mean_false_positives"), F.avg("cost_usd").alias("mean_cost_usd"),
    )
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("failure_type", "cases"))))
    failures = failure_taxonomy(cases).agg(F.coalesce(counts, F.create_map().cast("map<string,bigint>")).alias("failure_taxonomy"))
    p95 = rank_percentiles(cases.select(F.lit(0).alias("one"), "latency_ms"), ["one"], "latency_ms").select("latency_ms").first()
    return head.crossJoin(failures).select(  # two one-row aggregates
        F.lit(month).alias("month"), "*", F.lit(p95[0] if p95 else None).cast("double").alias("p95_latency_ms")
    )


def report_json(head: DataFrame) -> DataFrame:
    """One JSON document with sorted keys."""
    return head.select(F.to_json(F.struct(*sorted(head.columns))).alias("json"))


def report_markdown(head: DataFrame, cases: DataFrame) -> str:
    """The report as Markdown.  It lists every case, so it is for evaluation sets; rows stream through the driver."""
    r = head.first()
    lines = [f"# Monthly Benchmark Report: {r.month}", "", f"- Cases: {r.total_cases}", f"- Precision: {r.precision:.4f}",
             f"- Recall: {r.recall:.4f}", f"- Mean false positives: {r.mean_false_positives:.4f}",
             f"- P95 latency (ms): {r.p95_latency_ms:.2f}", f"- Mean cost (USD): {r.mean_cost_usd:.6f}", "", "## Failure Taxonomy", ""]
    lines += [f"- {k}: {v}" for k, v in sorted(r.failure_taxonomy.items())] or ["- none"]
    lines += ["", "## Cases", ""]
    for c in cases.orderBy("case_id").toLocalIterator():
        lines.append(f"- {c.case_id}: precision={c.precision:.4f}, recall={c.recall:.4f}, latency_ms={c.latency_ms:.2f}")
    return "\n".join(lines) + "\n"


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, with the first created_at: an aggregation, so partial sums go over the network."""
    rest = [c for c in df.columns if c not in (*keys, order, "created_at")]
    made = [F.min_by("created_at", order).alias("created_at")] if "created_at" in df.columns else []
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"), F.max(order).alias(order), *made).select(
        *keys, "_r.*", order, *(["created_at"] if made else [])
    )


def running_slots(events: DataFrame, tenant: str, order: str, delta: str) -> DataFrame:
    """Slots in use after each event: +1 and -1 summed in order and never below 0.

    The clamped sum is the plain sum less its lowest value so far where that is negative; per tenant windows.
    """
    w = W.partitionBy(tenant).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(delta).over(w)
    summed = events.withColumn("_sum", total)
    return summed.withColumn("slots", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).drop("_sum")
