import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftgraph.llm import quality
from weftgraph.llm.common import span_hashes, text_array, word_spans


def salad(spark):
    """300 texts in which each word has six successors, and the last ten of them with their words shuffled (1290 to 1299)."""
    r, ws = random.Random(5), [f"w{a}{b}" for a in "abcdefghijklmnop" for b in "klmnopqrst"]
    follow, rows = {w: r.sample(ws, 6) for w in ws}, []
    for i in range(300):
        text = [r.choice(ws)]
        while len(text) < 150:
            text.append(r.choice(follow[text[-1]]))
        rows.append((i, " ".join(text), "en"))
    rows += [(1000 + i, " ".join(r.sample(t.split(), 150)), "en") for i, t, _ in rows[-10:]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_word_order_counts(spark):
    kept = {r.doc_id: r.kept for r in quality.op3_quality(salad(spark)).collect()}
    assert len(kept) == 310 and all(kept[i] for i in range(300))
    assert not any(kept[i] for i in range(1290, 1300))


def test_the_number_of_buckets_changes_nothing_but_discounts(spark, monkeypatch):
    few = {r.doc_id: r.log_perplexity for r in quality.measured(salad(spark)).collect()}
    monkeypatch.setattr(quality, "BUCKET_BYTES", 4_000)
    many = {r.doc_id: r.log_perplexity for r in quality.measured(salad(spark)).collect()}
    assert few.keys() == many.keys() and max(abs(few[i] - many[i]) for i in few) < 0.1


def test_rows_of_any_kind_come_back_once(spark):
    rows = [(None, None, None), (None, "a b c", None), (7, "", "en"), (7, "x y z\nx y", "zh"), (7, "x y z\nx y", "zh"), (8, "漢字 漢字漢", "zh"), (9, " \n\t ", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = quality.op3_quality(df)
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 7, 7, 7, 8, 9]
    assert out.where(F.isnull("perplexity") | F.isnan("perplexity")).count() == 0


def test_log_perplexity_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["漢字", "é", "x" * 70]
    texts = [" \n".join(r.choices(words, [40, 20, 9] + [1] * 40, k=r.randrange(0, 60))) for _ in range(300)]
    texts += texts[:9] + ["", None, " "]
    langs = [("en", "fr", None)[i % 3] for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string").repartition(3, "doc_id")
    got = {x.doc_id: x.log_perplexity for x in quality.measured(df).collect()}
    models, split = quality.statistics(df, 12)
    assert max(split.values()) > 1, "some words are common enough to be split over buckets"
    tokens, counts = [], ({}, {})
    for t, x in zip(texts, langs):
        data = np.frombuffer((t or "").encode(), np.uint8)
        k = quality.Tokens(data, np.array([0, len(data)]), [(x, 0, 1)])
        spelled = [data[a:b].tobytes() for a, b in zip(k.starts, k.ends)]
        tokens.append((int(k.half[0]), list(zip(map(int, k.history), map(int, k.word), spelled))))
        for h, w, _ in tokens[-1][1]:
            c = counts[tokens[-1][0]]
            c[h, w] = c.get((h, w), 0) + 1

    def bucket(h, w):
        return ((h & 0xFFFFFFFF) + (w & 0xFFFF) % split.get(h - (1 << 64) * (h >> 63), 1)) % 12

    discounts = [{b: quality._discounts(np.array([n for (h, w), n in c.items() if bucket(h, w) == b])) for b in range(12)} for c in counts]
    cut = lambda side, h, w: discounts[side][bucket(h, w)][min(counts[side][h, w], 3) - 1]
    totals = [defaultdict(int), defaultdict(int)]
    saved = [defaultdict(float), defaultdict(float)]
    for side in (0, 1):
        for (h, w), n in counts[side].items():
            totals[side][h] += n
            saved[side][h] += cut(side, h, w)

    def logs(model, data):
        code = [data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2)]
        return model.logs(np.array(code, np.uint32))

    for i, ((half, pairs), t, x) in enumerate(zip(tokens, texts, langs)):
        data, other = (t or "").encode(), 1 - half
        whole = logs(models[x], b"\0\0" + data + b"\0")
        want = sum(v for b, v in zip(data + b"\0", whole) if b in b" \t\n\r\x0b\x0c\0")
        for h, w, spelled in pairs:
            p = np.exp(logs(models[x], b"  " + spelled).sum())
            if totals[other][h]:
                n = counts[other].get((h, w), 0)
                p = ((n - cut(other, h, w) if n else 0) + saved[other][h] * p) / totals[other][h]
            want += np.log(p)
        most = 0.5 / quality.STEPS * len(pairs) + 1e-6  # spellings travel in steps
        assert abs(got[i] * (len(data) + 1) + want) <= most, (i, got[i], want)
    copies = [tokens[i][0] == tokens[300 + i][0] for i in range(9)]
    assert all(copies)


def test_words_and_codes_against_plain_python():
    r = random.Random(8)
    texts = ["".join(r.choice(" \n\tabé漢字€\x00\u0416") for _ in range(r.randrange(0, 30))) for _ in range(400)]
    data = [t.encode() for t in texts]
    flat, cuts = text_array(pa.array([None if i % 50 == 0 else t for i, t in enumerate(texts)]))
    data = [b"" if i % 50 == 0 else t for i, t in enumerate(data)]
    assert flat.tobytes() == b"".join(data) and np.diff(cuts).tolist() == list(map(len, data))
    starts, ends, sizes = word_spans(flat, cuts)
    want = [t.split() for t in data]
    assert [flat[a:b].tobytes() for a, b in zip(starts, ends)] == [w for t in want for w in t] and sizes.tolist() == list(map(len, want))
    hashes = span_hashes(flat, starts, ends)
    assert len(set(hashes.tolist())) == len({w for t in want for w in t}) == len(set(zip(hashes.tolist(), (flat[a:b].tobytes() for a, b in zip(starts, ends)))))
    starts, ends, _ = word_spans(flat, cuts, apart=True)
    apart = re.compile(rb"[\xe3-\xed][\x80-\xbf]{2}|[^ \t-\r\xe3-\xed]+")
    assert [flat[a:b].tobytes() for a, b in zip(starts, ends)] == [w for t in data for w in apart.findall(t)]
    code, last = quality._codes(flat, cuts)
    for t, a, b, e in zip(data, cuts, cuts[1:], last):
        s = b"\0\0" + t + b"\0"
        assert [*code[a:b].tolist(), int(e)] == [s[i] << 16 | s[i + 1] << 8 | s[i + 2] for i in range(len(s) - 2)]
