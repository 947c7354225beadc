import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftgraph.llm import jaccard, sketch, substring
from weftgraph.llm.common import U64, mix64, text_array


def test_packed_columns():
    r = np.random.default_rng(0)
    for n in (0, 1, 500):
        a, b = r.integers(0, 1 << 63, n).astype(np.uint64), r.integers(0, 9, n).astype(np.uint8)
        x, y = sketch.unpacked(sketch.packed(a, b), np.uint64, np.uint8)
        assert (a == x).all() and (b == y).all()


def test_a_full_slice_loses_nothing_and_passes_few_unique_hashes(spark):
    def hashed(batch):
        return mix64(np.array([int(x) for t in batch.column("text").to_pylist() for x in (t or "").split()], U64))

    # as many hashes as a slice is made for at any size, in one slice, over many documents
    per, n = 4096, sketch.SLICE // 4096
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda k: (F.col("id") * per + k).cast("string"))).alias("text"))
    again = spark.createDataFrame([(1000, " ".join(map(str, range(0, per * n, 97)))), (1001, None), (1002, "")], "doc_id long, text string")
    docs, shift = sketch.numbered(rows.unionByName(again).repartition(3))
    found = sketch.repeated(docs, hashed, 1)
    kept = set()
    for r in found.collect():
        kept |= set(np.cumsum(sketch.unpacked(bytes(r.hashes), U64)[0]).tolist())
    every = sketch._keys(mix64(np.arange(per * n, dtype=U64)), 1)
    passed = np.isin(every, np.array(sorted(kept), U64))
    assert passed[::97].all()
    assert passed[np.arange(per * n) % 97 > 0].mean() < 0.05


def test_slices_follow_the_number_of_hashes():
    assert sketch.slices_for(0) == 16 and sketch.slices_for(10**12) == -(-(10**12) // sketch.SLICE)


def test_groups_shrink_with_the_longest_text(spark):
    short = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    assert sketch.numbered(short)[1] == 10
    assert sketch.numbered(short.unionByName(spark.createDataFrame([(2, "x" * (1 << 20))], "doc_id long, text string")))[1] == 8
    assert sketch.numbered(short.limit(0))[1] == 10


def test_equal_windows_have_equal_anchors_that_count_twice():
    r = np.random.default_rng(1)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([*(f"w{x}" for x in r.integers(0, 10**6, 50)), *passage, *(f"w{x}" for x in r.integers(0, 10**6, 50))]) for _ in range(2)] + ["la " * 300]
    w = substring.Windows(*text_array(pa.array(texts)), 35)
    seen, n = np.unique(w.counted, return_counts=True)
    anchors = {}
    for d, s, a in zip(w.doc.tolist(), w.start.tolist(), w.anchor.tolist()):
        anchors[d, s] = a
    assert all(anchors[0, 50 + i] == anchors[1, 50 + i] for i in range(26))
    count = dict(zip(seen.tolist(), n.tolist()))
    assert all(count[anchors[0, 50 + i]] >= 2 for i in range(26)) and all(count[anchors[2, i]] >= 2 for i in range(200))


def test_sets_that_link_share_enough_of_their_counted_prefixes():
    r = np.random.default_rng(2)
    for _ in range(400):
        n = int(r.integers(1, 200))
        x = np.unique(r.integers(0, 1 << 62, n))
        y = np.unique(np.concatenate((r.choice(x, max(1, int(len(x) * r.uniform(0.8, 1))), replace=False), r.integers(0, 1 << 62, int(r.integers(0, max(1, len(x) // 5 + 1)))))))
        both = len(np.intersect1d(x, y))
        if 100 * both >= jaccard.PERCENT * (len(x) + len(y) - both):
            (p, need), (q, other) = jaccard.counted_prefix(len(x)), jaccard.counted_prefix(len(y))
            assert len(np.intersect1d(x[:p], y[:q])) >= max(need, other)
