import tracemalloc

import numpy as np
import pyarrow as pa

from weftgraph.llm import quality


def passes(spark, monkeypatch, docs):
    """The two passes of measured() over texts, as executors run them: the counts that go to buckets, and descriptions."""
    found = []
    kind = type(docs)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: found.append(f) or plain(self, f, *a, **b))
    quality.measured(docs)
    monkeypatch.undo()
    return found[-2:]


def test_a_chunk_is_not_sorted_at_once(spark, monkeypatch):
    r = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(20_000)])
    text = lambda: " ".join(words[(20_000 * r.random(200) ** 3).astype(int)])
    docs = spark.createDataFrame([(i, text(), "en") for i in range(300)], "doc_id long, text string, lang string")
    rows = [pa.record_batch({"doc_id": pa.array(range(500), pa.int64()), "lang": ["en"] * 500, "text": [text() for _ in range(500)], "part": pa.array([0] * 500, pa.int32())}) for _ in range(20)]
    for run in passes(spark, monkeypatch, docs):
        most = []
        for upto in (4, 4, 20):  # the first leaves tables that stay
            tracemalloc.start()
            for _ in run(iter(rows[:upto])):
                pass
            most.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        token = (most[2] - most[1]) / (16 * 500 * 200)
        assert token < 30, f"{run.__name__}: {token:.0f} bytes a token"
