"""The pipeline stage by stage against plain Python, each on what the stage before it kept."""

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from weftgraph.llm import bpe, mixing, secrets, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(8), str(tmp_path_factory.mktemp("sf"))
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(240):
        text = " ".join(word() for _ in range(60)) + (" vile rotten scum filth" if i % 6 == 0 else "")
        rows.append((i, text + (" token = 24be64439e3e49cf46b2d7c9" if i % 7 == 0 else ""), "en", f"s{i % 3}", len(text)))
    rows += [(300 + k, rows[k][1], "en", "s1", 9) for k in range(1, 20, 3)]
    rows += [(400 + k, rows[k][1].replace(" ", " zz ", 1), "en", "s2", 9) for k in range(2, 20, 3)]
    rows += [(500, None, "en", None, 0), (501, "", None, "s0", 0), rows[4], rows[4]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    keep = lambda df: corpus_pipeline.materialize(df, "t")
    one = keep(stages["toxicity"](spark, docs, folder))
    scores = toxicity.scored(docs, spark.read.parquet(f"{folder}/labels.parquet"), column="s")
    assert Counter(r.doc_id for r in one.collect()) == Counter(r.doc_id for r in scores.where("s < 0.7").collect()) and one.columns == columns
    assert one.where("doc_id % 6 = 0 and doc_id < 240").count() <= 2 and one.count() >= 200

    two = keep(stages["near_duplicates"](spark, one, folder))
    before, after = [r for r in one.collect()], [r for r in two.collect()]
    kept = Counter(r.doc_id for r in after)
    sets = [(r.doc_id, shingles(r.text)) for r in before]
    for i, (a, x) in enumerate(sets):
        others = [b for j, (b, y) in enumerate(sets) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
        assert sum(kept[b] for b in set(others)) == 1 if x else kept[a] == 1
    assert two.columns == columns

    three = keep(stages["secrets"](spark, two, folder))
    want = Counter((r.doc_id, r.text and secrets.redact(r.text, secrets.find_secrets(r.text)[1])) for r in after)
    got = three.collect()
    assert Counter((r.doc_id, r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert not any("24be64439e" in (r.text or "") for r in got) and any("[SECRET]" in (r.text or "") for r in got)

    four = keep(stages["mix"](spark, three, folder))
    times = Counter(r.doc_id for r in four.collect())
    size, sizes, taken = {r.doc_id: len((r.text or "").split()) for r in got}, defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += size[r.doc_id]
        taken[r.source] += size[r.doc_id] * times[r.doc_id]
        assert times[r.doc_id] <= 2 and (size[r.doc_id] or times[r.doc_id] == 1)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([sizes[s] for s in order], [5, 2, 1, 5][: len(order)], 1.5, 2)
    assert four.columns == columns and all(abs(taken[s] - g) < 0.15 * g + 70 for s, g in zip(order, goal))

    five = stages["bpe"](spark, four, folder)
    encoder = bpe.Encoder(json.load(open(bpe.default_vocabulary())))
    want = Counter((r.doc_id, x) for r in four.collect() for x in encoder.encode([r.text]))
    assert Counter((r.doc_id, np.array(r.ids, "<u4").tobytes()) for r in five.collect()) == want


def test_run_is_the_stages_in_order(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mix", "bpe"]
    assert out.count() > 150 and set(out.columns) == {"doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"}
    again = corpus_pipeline.run(spark, folder)
    key = lambda df: sorted((r.doc_id, r.decoded_sha256) for r in df.select("doc_id", "decoded_sha256").collect())
    assert key(out) == key(again)


def test_empty_documents(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
