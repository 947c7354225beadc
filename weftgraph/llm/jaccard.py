"""N-gram Jaccard join with signature trees.

Documents with equal shingle sets are one class.  In the order of their hashes, the first shingles of two sets that link
must have some in common (prefix filter): each document counts its first 30 % or so in a count-min sketch in slices
(sketch.py), and one with too few that may lie in other documents cannot link with anything.  The other classes order
their shingles by frequency, rare ones first; classes that share one of their first n - ceil(t n) + 1 shingles form
candidate neighbourhoods, which are dealt out in units.
In a unit a tree over the classes holds, in each node, the OR of its members' bitmaps and their range of sizes; a
traversal of pairs of nodes prunes those whose largest possible overlap is too small, and pairs inside one component.
What is left is counted on the sets of 64-bit shingle hashes.

A neighbourhood above UNIT classes is cut into tiles, and every pair of its tiles is a unit: no task gets an unbounded
group and no pair is lost.  The join returns components, not links: pairs inside a component are not all looked at, so
it has no number of links for a document.

Rows are told apart by their place in the scan, so docs must be a scan of files or a table that materialize() wrote.

Cases: null or wordless text has an empty set, no links and its own id as component; fewer than five words are one
shingle; repeated rows share a class; rows with null id take part in their class, and their component is null if all of
the class's ids are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import U64, materialize, rows_per_batch, sequence_starts, span_hashes, text_array, windows_hash, word_spans
from .components import Sets, components
from .sketch import GROUP_ROWS, grouped_texts, may_repeat, numbered, repeated, slices_for, texts_of
from .substring import FACTORS

SIZE, PERCENT = 5, 80
#: Classes in a unit, in a leaf and in a node above leaves; bits of a signature.
UNIT, LEAF, FANOUT, BITS = 512, 4, 8, 1 << 14


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, cuts = text_array(column)
    data = _LOWER[data]
    starts, ends, sizes = word_spans(data, cuts)
    every = windows_hash(span_hashes(data, starts, ends), SIZE, FACTORS[0])
    first, out = sequence_starts(sizes), []
    for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
        if b - a >= SIZE:
            out.append(np.unique(every[a : b - SIZE + 1]))
        else:
            words = data[cuts[i] : cuts[i + 1]].tobytes().split()
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], U64))
    return out


def _least_overlap(n: int) -> int:
    """Shingles that a set of n has in common with any that it links with, at least."""
    return -(-PERCENT * n // 100)


def counted_prefix(n: int) -> tuple[int, int]:
    """How many of a set's n shingles, in the order of the hashes, are counted in the sketch, and how many of these must
    lie in other documents for a link.  With prefixes longer by l than the filter needs, linked sets share l + 1 of their
    first ones; the partner's prefix is longer by a tenth of its own size, which is at least the least overlap."""
    return n - _least_overlap(n) + max(1, -(-n // 10)), max(1, -(-_least_overlap(n) // 10))


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, key (of the set); of candidates only: items, the whole set, packed (once for equal sets of neighbouring
    documents), and first, the length of the prefix."""
    rows_per_batch(docs.sparkSession, GROUP_ROWS)
    docs, _ = numbered(docs)
    texts = grouped_texts(docs)
    words = max(1, (docs.select(F.sum(F.octet_length("text"))).first()[0] or 0) // 6)  # about; it only sizes things
    slices = slices_for(3 * words // 10)

    def count(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([*(s[: counted_prefix(len(s))[0]] for s in shingle_sets(batch.column("text")) if len(s)), np.empty(0, U64)])

    def decide(texts: pa.Table, found: pa.Table) -> pa.Table:
        batch = texts_of(texts)
        sets = shingle_sets(batch.column("text"))
        parts = [s[: counted_prefix(len(s))[0]] if len(s) else s for s in sets]
        cuts = sequence_starts(np.fromiter(map(len, parts), np.int64, len(parts))).tolist()
        may = np.concatenate(([0], np.cumsum(may_repeat(np.concatenate([*parts, np.empty(0, U64)]), slices, found))))
        rows, known = [], set()
        for doc_id, s, a, b in zip(batch.column("doc_id").to_pylist(), sets, cuts, cuts[1:]):
            items = first = None
            key = xxhash.xxh3_128_digest(s.tobytes())
            if len(s) and may[b] - may[a] >= counted_prefix(len(s))[1]:
                first = len(s) - _least_overlap(len(s)) + 1
                if key not in known:
                    known.add(key)
                    items = s.tobytes()
            rows.append((doc_id, len(s), key, first, items))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["doc_id", "n", "key", "first", "items"])

    found = repeated(docs, count, slices)
    return texts.groupBy("group").cogroup(found.groupBy("group")).applyInArrow(decide, "doc_id long, n long, key binary, first long, items binary")


def _exploded(table: DataFrame) -> DataFrame:
    """id and token for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, np.int64) for x in batch.column("items").to_pylist()]
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), list(map(len, parts)))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([*parts, np.empty(0, np.int64)]))], ["id", "token"])

    return table.select("id", "items").mapInArrow(run, "id long, token long")


class SignatureTree:
    """Two levels of nodes over sets in the order of their smallest items, which brings near copies together."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        bits = np.zeros((len(sets), BITS), bool)
        for i, s in enumerate(sets):
            bits[i, (s % U64(BITS)).astype(np.int64)] = True
        self.spare = self.size - bits.sum(1)  # items that share a bit with another item of their set
        packed = np.packbits(bits, axis=1).view(U64)
        self.levels = [self._level(np.arange(len(sets)), packed, self.size, self.size, self.spare, 1)]
        for fan in (LEAF, FANOUT):
            self.levels.append(self._level(*self.levels[-1][:5], fan))

    @staticmethod
    def _level(first, bitmap, least, most, spare, fan: int) -> tuple:
        """First member below, bitmap, least and most size, spare items; of groups of `fan` nodes."""
        at = np.arange(0, len(first), fan)
        over = lambda f, x: f.reduceat(x, at, axis=0)
        return first[at], over(np.bitwise_or, bitmap), over(np.minimum, least), over(np.maximum, most), over(np.maximum, spare)

    def may(self, level: int, a: int, others: np.ndarray) -> np.ndarray:
        """Of the other nodes, those with a possible overlap that is large enough for some pair of members."""
        _, bitmap, least, most, spare = self.levels[level]
        common = np.bitwise_count(bitmap[a] & bitmap[others]).sum(1, dtype=np.int64) + np.minimum(spare[a], spare[others])
        overlap = np.minimum(np.minimum(common, most[a]), most[others])
        # overlap / (x + y - overlap) >= p, for the smallest sizes x, y that the nodes hold
        fits = (100 * most[a] >= PERCENT * least[others]) & (100 * most[others] >= PERCENT * least[a])
        return others[fits & ((100 + PERCENT) * overlap >= PERCENT * (least[a] + least[others]))]

    def links(self, joined: Sets) -> Iterator[tuple[int, int]]:
        """Pairs that link and were not yet in one component; enough of them to give all components."""
        n = [len(x[0]) for x in self.levels]
        below = lambda level, x, fan: np.arange(x * fan, min((x + 1) * fan, n[level]))
        for p in range(n[2]):
            for q in self.may(2, p, np.arange(p, n[2])).tolist():
                if self._one(joined, 2, p, q):
                    continue
                for a in below(1, p, FANOUT).tolist():
                    others = below(1, q, FANOUT)
                    for b in self.may(1, a, others[others >= a]).tolist():
                        if self._one(joined, 1, a, b):
                            continue
                        for x in below(0, a, LEAF).tolist():
                            others = below(0, b, LEAF)
                            for y in self.may(0, x, others[others > x]).tolist():
                                if joined.find(x) != joined.find(y) and self.alike(x, y):
                                    joined.join(x, y)
                                    yield x, y

    def _one(self, joined: Sets, level: int, a: int, b: int) -> bool:
        """Whether all members of two nodes are in one component."""
        fan = (1, LEAF, LEAF * FANOUT)[level]
        root = joined.find(a * fan)
        return all(joined.find(x) == root for y in {a, b} for x in range(y * fan, min((y + 1) * fan, len(self.sets))))

    def alike(self, x: int, y: int) -> bool:
        a, b = self.sets[x], self.sets[y]
        if len(a) > len(b):
            a, b = b, a
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        both = int((b[at] == a).sum())
        return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _unit_links(table: pa.Table) -> pa.Table:
    ids = table.column("id").to_numpy()
    sets = [np.frombuffer(x, U64) for x in table.column("items").to_pylist()]
    order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i]), int(ids[i])))
    ids, sets = ids[order], [sets[i] for i in order]
    found = list(SignatureTree(sets).links(Sets(len(sets))))
    a, b = (np.array([ids[x[k]] for x in found], np.int64) for k in (0, 1))
    return pa.table({"a": a, "b": b})


def links(classes: DataFrame) -> DataFrame:
    """classes: id, n, first, items.  Pairs of ids that link: enough of them to give all components."""
    # Rare tokens first: the order is the same for all classes, and those in one class only need no partner.
    tokens = _exploded(classes)
    counted = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("k")), "token")
    place = F.row_number().over(W.partitionBy("id").orderBy("k", "token"))
    placed = counted.withColumn("place", place).where("k > 1")
    prefix = placed.join(classes.select("id", "n", "first"), "id").where("place <= first").select("id", "n", "token")
    # Linked sizes differ by a factor of 100 / PERCENT at most: they share one of two neighbouring bands.
    band = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int")
    prefix = materialize(prefix.withColumn("band", F.explode(F.array(band, band + 1))).drop("n"), "prefix")
    least = prefix.groupBy("token", "band").agg(F.min("id").alias("m"), F.count("*").alias("k")).where("k > 1").drop("k")
    pairs = prefix.join(least, ["token", "band"]).where("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b"))
    near = components(pairs.distinct(), "near")
    place = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct())
    place = place.join(place.groupBy("component").agg(F.count("*").alias("size")), "component")
    units = F.greatest(F.lit(1), F.ceil(F.lit(place.count() / UNIT))).cast("int")
    tiles = F.ceil(F.col("size") / UNIT).cast("int")
    tile = F.pmod(F.xxhash64("node"), tiles).cast("int")
    # a small neighbourhood goes to one shared unit; a large one to a unit for each pair of tiles that has its own
    pair = F.transform(
        F.sequence(F.lit(0), tiles - 1),
        lambda k: F.concat_ws("/", F.col("component"), F.least(k, tile), F.greatest(k, tile)),
    )
    shared = F.array(F.concat(F.lit("u"), F.pmod(F.xxhash64("component"), units)))
    place = place.select(F.col("node").alias("id"), F.explode(F.when(tiles > 1, pair).otherwise(shared)).alias("unit"))
    return (
        place.join(classes.select("id", "items"), "id").groupBy("unit").applyInArrow(_unit_links, "a long, b long")
    )


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    rows = materialize(document_sets(docs), "shingles")
    some = rows.groupBy("key").agg(
        F.min("doc_id").alias("id"), F.max("n").alias("n"), F.max("first").alias("first"), F.max("items").alias("items")
    )
    classes = materialize(some.where("id is not null"), "classes")
    found = components(links(classes.where("items is not null").select("id", "n", "first", "items")), "links")
    names = classes.select("key", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "key", F.coalesce("component", "id").alias("component_id")
    )
    return rows.join(names, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def op10_jaccard(docs: DataFrame) -> DataFrame:
    return grouped(docs.select("doc_id", "text"))
