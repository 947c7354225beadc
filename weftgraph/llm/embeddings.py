"""Embedding near-dedup with spherical-cap filters.

Filter directions are a random product code: after a seeded rotation a vector is cut into BLOCKS blocks, each block has
a number of random unit words, and a filter is one word a block, so words ** BLOCKS directions need a small table only.
A filter's cap holds the vectors whose inner product with it reaches alpha; alpha is the quantile, over random vectors of
the same dimension, at which a vector lies in so many caps on average (caps_for).  The number of words follows the
number of vectors, so that a cap holds about BUCKET of them at every size, and the caps of a vector grow with the root of
the words, which keeps the recall: of random pairs at cosine 0.93, 0.988 in 16 dimensions, 0.997 in 64 and 0.998 in 256
with 128 words, and no less with 512 and 2048.  List decoding finds all caps of a vector from the scores by block: a word
takes part only if it reaches alpha with the other block's best.  A vector in fewer caps than the average also takes its
nearest directions up to that number, found among the best words of each block.  Vectors of one label that share a filter
are candidates; cosines are then taken in double precision, and a pair counts in the first filter that it shares only.

Equal vectors of a label are one class with a weight.  A bucket above TILE classes is cut into tiles and every pair of
its tiles is a unit of work, so no task gets an unbounded group, and units send counts and spanning edges, never pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
nothing; vectors of different lengths do not link; repeated rows are copies; null ids count as links but name no
component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import expand, materialize, rows_per_batch
from .components import components

LIMIT, BLOCKS, CODEWORDS, CAPS, BUCKET, TILE = 0.93, 2, 128, 16, 64, 2048


def words_for(vectors: int) -> int:
    """Words of a block, so that a cap holds about BUCKET vectors; CODEWORDS at least."""
    return max(CODEWORDS, math.ceil((vectors * CAPS / math.sqrt(CODEWORDS) / BUCKET) ** (2 / 3)))


def caps_for(count: int) -> int:
    """Caps of a vector: CAPS with CODEWORDS words a block, and as the root of the words beyond."""
    return round(CAPS * math.sqrt(count / CODEWORDS))


@lru_cache(8)
def _code(dim: int, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation of the (padded) vectors; the words, BLOCKS x count x width, scaled so that filters are unit; alpha."""
    width = -(-dim // BLOCKS)
    random = np.random.default_rng(dim)
    rotation = np.linalg.qr(random.standard_normal((width * BLOCKS, width * BLOCKS)))[0][:dim]
    words = random.standard_normal((BLOCKS, count, width))
    words = words / np.linalg.norm(words, axis=2, keepdims=True) / np.sqrt(BLOCKS)
    # the quantile of about a million inner products of random unit vectors with filters, at CAPS of all filters
    unit = random.standard_normal((512, dim))
    parts = (unit / np.linalg.norm(unit, axis=1, keepdims=True) @ rotation).reshape(512, BLOCKS, -1)
    pick = random.integers(0, count, (BLOCKS, 2048))
    inner = sum(parts[:, b] @ words[b, pick[b]].T for b in range(BLOCKS))
    return rotation, words, _tail(inner.ravel(), caps_for(count) / count**BLOCKS)


def _tail(values: np.ndarray, share: float) -> float:
    """The value that this share of them reaches; beyond what a sample can tell, as far out as a normal would be."""
    least = 64 / len(values)
    if share >= least:
        return float(np.quantile(values, 1 - share))
    normal = NormalDist()
    return float(np.quantile(values, 1 - least)) * normal.inv_cdf(1 - share) / normal.inv_cdf(1 - least)


def decode(unit: np.ndarray, count: int = CODEWORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and filter number of every cap that each unit vector lies in."""
    (rotation, words, alpha), least = _code(unit.shape[1], count), caps_for(count)
    parts = (unit @ rotation).reshape(len(unit), BLOCKS, -1)
    out_row, out_filter = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(unit), 512):
        left, right = (parts[at : at + 512, b] @ words[b].T for b in range(BLOCKS))
        order = np.argsort(-right, axis=1)
        ranked = np.take_along_axis(right, order, 1)
        row, a = np.nonzero(left + ranked[:, :1] >= alpha)
        need = alpha - left[row, a]
        n = np.zeros(len(row), np.int64)  # how many of the other block's words reach it: they come first
        low, high = n, np.full(len(row), count)
        while (low < high).any():
            middle = (low + high) // 2
            fits = (middle < count) & (ranked[row, np.minimum(middle, count - 1)] >= need)
            low, high = np.where(fits & (low < high), middle + 1, low), np.where(fits, high, middle)
        n = low
        b = order[np.repeat(row, n), expand(np.zeros(len(n), np.int64), n)]
        row, number = np.repeat(row, n), np.repeat(a, n) * count + b
        few = np.flatnonzero(np.bincount(row, minlength=len(left)) < least)
        if len(few):
            keep = ~np.isin(row, few)
            best = np.argsort(-left[few], axis=1)[:, :least]
            sums = np.take_along_axis(left[few], best, 1)[:, :, None] + ranked[few][:, None, :least]
            top = np.argsort(-sums.reshape(len(few), -1), axis=1, kind="stable")[:, :least]
            more = np.take_along_axis(best, top // sums.shape[2], 1) * count + np.take_along_axis(order[few], top % sums.shape[2], 1)
            row, number = np.concatenate((row[keep], np.repeat(few, top.shape[1]))), np.concatenate((number[keep], more.ravel()))
        out_row.append(row + at)
        out_filter.append(number)
    return np.concatenate(out_row), np.concatenate(out_filter)


def number_kind(vectors: DataFrame):
    """float32 travels as such: it is exact, and half the bytes."""
    small = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    return (np.float32, "float") if small else (np.float64, "double")


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, key, vector: packed numbers and their 128-bit key within the label; both null where it can't link."""
    kind, element = number_kind(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = [], []
            for label, x in zip(batch.column("label").to_pylist(), batch.column("embedding")):
                x = x.values
                v = np.empty(0, kind)
                if label is not None and x is not None and len(x) and not x.null_count:
                    v = x.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no negative zeros
                if len(v) and np.isfinite(v).all() and v.any():
                    data.append(v.tobytes())
                    keys.append(xxhash.xxh3_128_digest(data[-1] + str(label).encode()))
                else:
                    data.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(data, pa.binary())],
                ["vec_id", "label", "key", "vector"],
            )

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast(f"array<{element}>"))
    return rows.mapInArrow(run, "vec_id long, label string, key binary, vector binary")


def filter_entries(classes: DataFrame, kind, count: int = CODEWORDS) -> DataFrame:
    """label, dim, filter, id, weight, filters, vector: each class once for every filter that it exceeds; filters: the
    smaller ones that it exceeds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[int]] = {}
            data = batch.column("vector").to_pylist()
            for i, v in enumerate(data):
                by.setdefault(len(v), []).append(i)
            for size, rows in by.items():
                dim = size // np.dtype(kind).itemsize
                v = np.frombuffer(b"".join(data[i] for i in rows), kind).reshape(len(rows), dim).astype(np.float64)
                v = v / np.abs(v).max(1, keepdims=True)
                row, number = decode(v / np.linalg.norm(v, axis=1, keepdims=True), count)
                order = np.lexsort((number, row))
                row, number = row[order], number[order].astype(np.int32)
                cuts = np.searchsorted(row, np.arange(len(rows) + 1)).tolist()
                lists = [number[a:x].tobytes() for a, b in zip(cuts, cuts[1:]) for x in range(a, b)]
                at = pa.array(np.array(rows)[row])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").take(at), pa.array(np.full(len(row), dim)), pa.array(number), batch.column("id").take(at),
                     batch.column("weight").take(at), pa.array(lists, pa.binary()), batch.column("vector").take(at)],
                    ["label", "dim", "filter", "id", "weight", "filters", "vector"],
                )

    return classes.select("label", "id", "weight", "vector").mapInArrow(
        run, "label string, dim long, filter int, id long, weight long, filters binary, vector binary"
    )


def _unit(table: pa.Table, limit: float, kind) -> pa.Table:
    """Of the classes of one unit: links that count here, and the smallest class that each reaches within the unit."""
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    ids, weight, tile = (table.column(c).to_numpy() for c in ("id", "weight", "tile"))
    cross = len(np.unique(tile)) > 1  # a unit of two tiles counts pairs between them only
    v = np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    lists = [np.frombuffer(x, np.int32) for x in table.column("filters").to_pylist()]
    seen, column = np.unique(np.concatenate(lists), return_inverse=True)
    earlier = np.zeros((len(ids), len(seen)), np.float32)
    earlier[np.repeat(np.arange(len(ids)), list(map(len, lists))), column] = 1
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    near = []
    for a in range(0, len(ids), 256):
        hit = v[a : a + 256] @ v.T >= limit
        hit[np.arange(len(hit)), np.arange(a, a + len(hit))] = False
        if cross:
            hit &= tile[a : a + 256, None] != tile[None, :]
        i, j = np.nonzero(hit)
        near.append((i + a, j))
        if len(i):
            counts = hit & (earlier[a : a + 256] @ earlier.T == 0)
            links[a : a + 256] += counts @ weight
    i, j = (np.concatenate([x[k] for x in near]) for k in (0, 1))
    while len(i):
        now = label.copy()
        np.minimum.at(now, i, label[j])
        now = now[now]
        if (now == label).all():
            break
        label = now
    keep = (links > 0) | (label < np.arange(len(ids)))
    return pa.table({"id": ids[keep], "links": links[keep], "least": ids[label[keep]]})


def grouped(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows_per_batch(vectors.sparkSession, 2000)
    rows = materialize(valid_vectors(vectors), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    classes = materialize(classes.where("id is not null"), "vector-classes")
    kind, _ = number_kind(vectors)
    entries = filter_entries(classes, kind, words_for(classes.count()))
    bucket = ["label", "dim", "filter"]
    hot = entries.groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > TILE)
    hot = materialize(hot.withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")).drop("size"), "hot-filters")
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    unit = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.concat_ws("/", F.least(k, tile), F.greatest(k, tile))))
    entries = (
        entries.join(hot, bucket, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("tile", tile).withColumn("unit", unit).drop("tiles")
    )
    done = _per_unit(entries, [*bucket, "unit"], limit, kind)
    done = materialize(done, "vector-links")
    found = components(done.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")), "vector-components")
    links = done.groupBy("id").agg(F.sum("links").alias("links"))
    names = (
        classes.select("key", "id", "weight").join(links, "id", "left")
        .join(found.withColumnRenamed("node", "id"), "id", "left")
        .select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    )
    out = rows.select("vec_id", "key").join(names, "key", "left")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _per_unit(entries: DataFrame, keys: list[str], limit: float, kind) -> DataFrame:
    """_unit() over every unit of two or more classes.  Units are small and many, so partitions are sorted by unit and
    walked as a stream, holding one unit at a time."""
    names = [*keys, "tile", "id", "weight", "filters", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            if len(table) > 1:
                yield from _unit(table, limit, kind).to_batches()

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                numbers = batch.column(k).dictionary_encode().indices.to_numpy()
                change |= numbers[1:] != numbers[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(batch.column(k)[a].as_py() for k in keys)
                if key != last and held:
                    yield from work(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield from work(held)

    return (
        entries.select(*names).repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(run, "id long, links long, least long")
    )


def op8_embeddings(vectors: DataFrame) -> DataFrame:
    return grouped(vectors.select("vec_id", "label", "embedding"))
