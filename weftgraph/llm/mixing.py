"""Mixing sources to target weights: Sainte-Lague apportionment.

Each source's documents are dealt over streams ("shards" of the mix) and laid end to end in a seeded order; a stream is
cut into blocks of BLOCK tokens.  The mix's blocks are apportioned to sources by highest Sainte-Lague quotients,
then each source's quota to its streams in the same way, and a seeded permutation of each stream says which blocks are
taken once more than the others.  A document's taken words are what its blocks cover, so none passes `repeats` times.

Streams per source follow its size up to MAX_STREAMS, so a source with a third of all rows is spread widely, and the
driver sees at most sources * MAX_STREAMS counts.

Cases: null text has size 0 and takes 0; a null source is a source of its own, last in order; repeated rows count each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import insort
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, materialize

BLOCK, STREAM_TOKENS, MAX_STREAMS, CYCLE = 32, 65_536, 4_096, (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(weights: list[float], seats: int, limits: list[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), ties to the earlier; limits cap single shares.

    The divisor is bisected to just above the last quotient that wins, so only a handful of seats are dealt one by
    one: the result equals dealing all of them.
    """
    limits = limits or [seats] * len(weights)
    seats = min(seats, sum(x for x, w in zip(limits, weights) if w > 0))
    if not seats:
        return [0] * len(weights)

    def at(divisor: float) -> list[int]:  # shares whose quotients weight / (2 k + 1) reach the divisor
        return [min(limit, int((w / divisor + 1) // 2)) if w > 0 else 0 for w, limit in zip(weights, limits)]

    low, high = min(w for w in weights if w > 0) / (2 * max(limits) + 3), 2 * max(weights)
    for _ in range(200):
        mid = math.sqrt(low * high)
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    out = at(high)
    queue: list[tuple[Fraction, int]] = []
    for i, w in enumerate(weights):
        if w > 0 and out[i] < limits[i]:
            insort(queue, (-Fraction(w) / (2 * out[i] + 1), i))
    while sum(out) < seats:
        _, i = queue.pop(0)
        out[i] += 1
        if out[i] < limits[i]:
            insort(queue, (-Fraction(weights[i]) / (2 * out[i] + 1), i))
    return out


def targets(sizes: list[int], weights: list[float], share: float, repeats: int) -> list[float]:
    """Split share * sum(sizes) by weight; what passes repeats * size is reshared until nothing does."""
    left, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > repeats * sizes[i]}
        for i in over or free:
            out[i] = float(repeats * sizes[i]) if over else left * weights[i] / total
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


def mix(docs: DataFrame, share: float = 1.5, repeats: int = 2, seed: int = 7) -> DataFrame:
    """docs: doc_id, source, text.  One row per document: doc_id, size, source_size, target, taken."""
    spark = docs.sparkSession
    rows = materialize(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
        .withColumn("u", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))),
        "mix",
    )
    order = lambda s: (s is None, s or "")  # noqa: E731  Python compares strings by code point
    found = sorted(rows.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: order(r.source))
    weights = [CYCLE[i % len(CYCLE)] for i in range(len(found))]
    goal = targets([r["size"] for r in found], weights, share, repeats)
    plan = [
        (r.source, r["size"], t, max(1, min(MAX_STREAMS, r["size"] // STREAM_TOKENS))) for r, t in zip(found, goal)
    ]
    # One row per source, next to what the driver has just gathered by source.
    streams = spark.createDataFrame(plan, "s string, source_size long, target double, streams long")
    rows = rows.join(F.broadcast(streams), F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "stream", F.pmod("u", F.col("streams")).cast("int")
    )
    counts = rows.groupBy("s", "stream").agg(F.sum("size").alias("n")).collect()
    by: dict[str | None, list] = {}
    for c in sorted(counts, key=lambda c: c.stream):
        by.setdefault(c.s, []).append((c.stream, c.n))
    blocks = {s: [-(-n // BLOCK) for _, n in x] for s, x in by.items()}
    room = [repeats * sum(blocks.get(p[0], [])) for p in plan]
    quota = sainte_lague(goal, round(sum(goal) / BLOCK), room)
    table = []
    for (s, size, target, _), q in zip(plan, quota):
        if target >= repeats * size:  # the whole source, ragged last blocks included
            q = repeats * sum(blocks.get(s, []))
        b = blocks.get(s, [])
        for (stream, n), k, q_s in zip(by.get(s, []), b, sainte_lague([n for _, n in by.get(s, [])], q, [repeats * x for x in b])):
            if k:
                step = next(x for x in range((k * 5) // 8 | 1, k + 2) if math.gcd(x, k) == 1)
                table.append((s, stream, k, q_s // k, q_s % k, step, (seed * 7919 + stream * 104_729) % k))
    quotas = spark.createDataFrame(table, "s string, stream int, k long, base long, extra long, step long, shift long")
    upto = F.sum("size").over(W.partitionBy("s", "stream").orderBy("u", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("end", upto).join(
        F.broadcast(quotas.select(F.col("s").alias("qs"), F.col("stream").alias("qstream"), "k", "base", "extra", "step", "shift")),
        F.col("s").eqNullSafe(F.col("qs")) & (F.col("stream") == F.col("qstream")), "left",
    )
    begin = F.col("end") - F.col("size")
    chosen = F.aggregate(
        F.sequence(F.floor(begin / BLOCK), F.floor((F.col("end") - 1) / BLOCK)), F.lit(0).cast("long"),
        lambda acc, b: acc + F.when(
            F.pmod(b * F.col("step") + F.col("shift"), F.col("k")) < F.col("extra"),
            F.least(F.col("end"), (b + 1) * BLOCK) - F.greatest(begin, b * BLOCK),
        ).otherwise(F.lit(0)).cast("long"),
    )
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("base") * F.col("size") + chosen).cast("long")
    return rows.select("doc_id", "size", F.col("source_size"), "target", taken.alias("taken"))


def op7_mix(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text"))
