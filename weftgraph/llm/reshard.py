"""Sharding: minimum-cost-flow resharding.

An old layout of shards is cut into blocks.  A minimum-cost flow from old shard sizes to new capacities says how many
bytes stay and how many move between each pair of shards; whole blocks realise it, and only files of shards that lose
or gain a block are rewritten.

The flow has (old + new shards) nodes and the block table at most `old * blocks_per_shard + new * SPLIT` rows,
whatever the input: these parameters, not the data, bound what the driver holds and what is broadcast.

Cases: null text has size 1; null ids and repeated rows are rows like any other; an empty table gives no rows; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize

#: Equal texts share a block and so a shard for as long as sizes stay within EVEN of each other.  Where they don't, blocks
#: above 1/SPLIT of a shard are dealt out by row in parts of that size: no group of copies decides a shard's size.
EVEN, SPLIT = 0.01, 64
#: Columns that a rewrite adds or uses.
RID, SHARD, SLOT = "__weft_rid", "weft_shard", "weft_slot"


@dataclass(frozen=True)
class Layout:
    old_shards: int = 12
    new_shards: int = 16
    blocks_per_shard: int = 1024


def min_cost_flow(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """Cheapest flow from old shards to new ones: bytes that keep their shard number cost 0, bytes that move cost 1.

    Successive shortest paths on the residual graph; sum(capacity) must be at least sum(supply).
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, int(i != j))
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    potential, left = [0] * len(graph), sum(supply)
    while left:
        far = [1 << 60] * len(graph)
        far[source], via, heap = 0, {}, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room and (e := d + cost + potential[a] - potential[b]) < far[b]:
                    far[b], via[b] = e, (a, k)
                    heapq.heappush(heap, (e, b))
        if sink not in via:
            raise ValueError("the new shards cannot hold all bytes")
        potential = [p + min(d, far[sink]) for p, d in zip(potential, far)]
        path, at = [], sink
        while at != source:
            a, k = via[at]
            path.append(graph[a][k])
            at = a
        push = min(left, *(x[1] for x in path))
        for x in path:
            x[1] -= push
            graph[x[0]][x[3]][1] += push
        left -= push
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for b, room, _, _ in graph[i]:
            if n <= b < n + m:
                flow[i][b - n] = supply[i] - room
    return flow


def place_blocks(blocks: list[tuple[tuple, int]], supply: list[int], capacity: list[int]) -> dict[tuple, int]:
    """New shard of each block.  blocks: ((old shard, ...), bytes).  Large blocks first, each to the flow with the most
    bytes left; then single moves from the fullest to the emptiest shard for as long as they even out sizes."""
    flow = [row[:] for row in min_cost_flow(supply, capacity)]
    fill, out, members = [0] * len(capacity), {}, [[] for _ in capacity]
    for key, size in sorted(blocks, key=lambda b: (-b[1], b[0])):
        row = flow[key[0]]
        to = max(range(len(row)), key=lambda j: (row[j], j == key[0], -j))
        row[to] -= size
        fill[to] += size
        out[key] = to
        members[to].append((size, key))
    for _ in range(20_000):
        over = [f - c for f, c in zip(fill, capacity)]
        a, b = over.index(max(over)), over.index(min(over))
        gap = over[a] - over[b]
        size, key = min(members[a], key=lambda x: (abs(2 * x[0] - gap), x[1]), default=(0, None))
        if not 0 < size < gap or gap - abs(gap - 2 * size) < max(2, sum(capacity) // 10_000_000):
            break
        members[a].remove((size, key))
        members[b].append((size, key))
        out[key], fill[a], fill[b] = b, fill[a] - size, fill[b] + size
    return out


def plan_reshard(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """One row per document: rid (its place in the scan), doc_id, size, text_crc32, old_shard, shard, slot."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = materialize(
        docs.select(
            F.col("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
        )
        .withColumn("old_shard", F.pmod("h", F.lit(layout.old_shards)).cast("int"))
        .withColumn("block", F.pmod(F.shiftright("h", 20), F.lit(layout.blocks_per_shard)).cast("int"))
        .withColumn("rid", F.monotonically_increasing_id())
        .drop("h"),
        "reshard",
    )
    sizes = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).collect()
    total = sum(r.bytes for r in sizes)
    supply = [0] * layout.old_shards
    for r in sizes:
        supply[r.old_shard] += r.bytes
    capacity = [total * (j + 1) // layout.new_shards - total * j // layout.new_shards for j in range(layout.new_shards)]
    shard = max(1, total // layout.new_shards)
    whole, fill = {(r.old_shard, r.block): r.bytes for r in sizes}, [0] * layout.new_shards
    for key, to in place_blocks(list(whole.items()), supply, capacity).items():
        fill[to] += whole[key]
    even = max(fill) - min(fill) <= EVEN * shard
    # At most new_shards * SPLIT + one per block: bounded by the layout.
    parts = spark.createDataFrame(
        [(*key, 1 if even else max(1, -(-size * SPLIT // shard))) for key, size in whole.items()], "old_shard int, block int, parts long"
    )
    rows = rows.join(F.broadcast(parts), ["old_shard", "block"]).withColumn(
        "part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    )
    keys = ["old_shard", "block", "part"]
    stats = rows.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    placed = place_blocks([((r.old_shard, r.block, r.part), r.bytes) for r in stats], supply, capacity)
    first, table = [0] * layout.new_shards, []
    for r in sorted(stats, key=lambda r: tuple(r[k] for k in keys)):
        to = placed[r.old_shard, r.block, r.part]
        table.append((r.old_shard, r.block, r.part, to, first[to]))
        first[to] += r.n
    plan = spark.createDataFrame(table, "old_shard int, block int, part int, shard int, first long")
    at = F.row_number().over(W.partitionBy(*keys).orderBy("doc_id", "rid")) - 1
    return rows.join(F.broadcast(plan), keys).select(
        "rid", "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + at).alias("slot")
    )


def rewrite_affected(plan: DataFrame, docs: DataFrame, path: str) -> list[int]:
    """Write the shards that lose or gain a row into path, one folder SHARD=number each, with each row's SLOT; their
    numbers.  Other shards keep their files, and old shards that the plan leaves empty lose theirs.

    docs: the scan that was planned; rows meet the plan by their place in it, so null and repeated ids are safe.
    """
    spark = docs.sparkSession
    moved = plan.where("shard <> old_shard")
    changed = moved.select("shard").unionByName(moved.select(F.col("old_shard").alias("shard"))).distinct()
    kept = plan.select("shard").distinct()
    numbers = sorted(r.shard for r in changed.join(kept, "shard", "left_semi").collect())  # shards of the layout, not rows
    place = plan.join(F.broadcast(changed), "shard", "left_semi").select(F.col("rid").alias(RID), F.col("shard").alias(SHARD), F.col("slot").alias(SLOT))
    rows = docs.withColumn(RID, F.monotonically_increasing_id()).join(place, RID).drop(RID)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SHARD).parquet(path)
    for r in changed.join(kept, "shard", "left_anti").collect():
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{SHARD}={r.shard}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return numbers


def op5_reshard(docs: DataFrame) -> DataFrame:
    return plan_reshard(docs.select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )
