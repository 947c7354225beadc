"""Toxicity: class-conditional Kneser-Ney models over the characters of words.

Two models of order ORDER, one of toxic and one of ordinary labelled texts, share all lower orders: a history that a
class has not seen backs off to continuation counts of both classes together, so rare expressions count alike for both
and only real differences tell.  A word's evidence is the difference of its log-likelihoods; a text's features are the
length-normalised difference and its parts from strong evidence.  A logistic curve turns them into a score.

Counts and curve come from all labelled rows outside the held-out third.  The rows fall into two halves, by a hash of the
id.  Each half's features are taken by the other half's counts, so that the curve is fitted on rows that the counts have
not seen; then the counts of both halves together score the documents.

Tasks send the n-grams of their rows' distinct words to buckets, by the two bytes before the last one.  All histories of
two bytes or more are whole in their bucket, which therefore evaluates its n-grams alone; only the probabilities of byte
pairs, from the distinct byte triples, are computed by the driver.  The driver holds no counts: it gathers each distinct
n-gram with its evidence (about five bytes packed) and broadcasts them.  The curve's sums are exact in fixed point, so the
order of rows doesn't matter.

Cases: null and empty texts score the model's constant; null ids are scored; repeated rows repeat; unless each half has
words of both classes every score is 0.0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import U64, materialize, mix64, rows_per_batch, sequence_starts, text_bytes
from .sketch import packed, unpacked

ORDER, THRESHOLD = 7, 0.7
DISCOUNT = 0.75
#: Buckets of n-grams; words whose counts a task holds; bytes of words cut into n-grams at once; steps of a nat of evidence.
BUCKETS, HELD, TOGETHER, STEPS = 256, 500_000, 1 << 22, 1024
#: Steps of one in the curve's sums.
FIXED = float(1 << 24)
#: A word's evidence counts as strong beyond these.
STRONG = (1.5, 3.0)
ALPHABET = 256


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word, its end included: the word's number, and the code of the ORDER bytes that end there.
    Bytes before a word's start are one and the same mark.  257 ** ORDER < 2 ** 64, so codes are exact."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(U64) + U64(1)
    place = np.arange(len(data)) - np.repeat(sequence_starts(sizes)[:-1], sizes)
    code = data.copy()
    for n in range(1, min(ORDER, len(data))):
        part = data[:-n] * U64(257**n)
        part[place[n:] < n] = 0
        code[n:] += part
    return np.repeat(np.arange(len(words)), sizes), code


def _counted(counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams of the words and how often each comes."""
    words, times = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
    upto = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    cuts = [0, *(np.flatnonzero(np.diff(upto // TOGETHER)) + 1).tolist(), len(words)]
    grams, n = [], []
    for a, b in zip(cuts, cuts[1:]):
        word, code = _grams(words[a:b])
        gram, inverse = np.unique(code, return_inverse=True)
        grams.append(gram)
        n.append(np.bincount(inverse, times[a:b][word]))
    return _summed(grams, n)


def _summed(grams: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    gram, inverse = np.unique(np.concatenate([*grams, np.empty(0, U64)]), return_inverse=True)
    return gram, np.bincount(inverse, np.concatenate([*n, np.empty(0)]), len(gram)).astype(np.int64)


def _sent(codes: np.ndarray) -> bytes:
    return packed(np.diff(codes, prepend=U64(0)))


def _codes(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, U64)[0])


def gram_counts(texts: DataFrame) -> DataFrame:
    """texts: kind (twice the half, and the class), text.  One row a bucket: grams, and counts of each of the four kinds;
    kinds: which of them it has, as bits; triples0, triples1: the distinct byte triples at the n-grams' ends, by half."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in range(4)]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, counts in enumerate(held):
                if not counts:
                    continue
                gram, n = _counted(counts)
                counts.clear()
                bucket = (mix64(gram // U64(257) % U64(257**2)) % U64(BUCKETS)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                some, cuts = np.unique(bucket[order], return_index=True)
                parts = np.split(order, cuts[1:])
                columns = (some.tolist(), [kind] * len(some), [_sent(gram[p]) for p in parts], [packed(n[p]) for p in parts])
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "kind", "grams", "n"])

        for batch in batches:
            for kind, text in zip(batch.column("kind").to_pylist(), text_bytes(batch.column("text"))):
                held[kind].update(text.split())
            if sum(map(len, held)) > HELD:
                yield from flush()
        yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        grams = [_codes(x) for x in table.column("grams").to_pylist()]
        n = [unpacked(x, np.int64)[0] for x in table.column("n").to_pylist()]
        every = np.unique(np.concatenate(grams))
        counts = np.zeros((4, len(every)), np.int64)
        for kind, g, k in zip(kinds, grams, n):
            counts[kind, np.searchsorted(every, g)] += k
        triples = [np.unique(every[counts[2 * h : 2 * h + 2].any(0)] % U64(257**3)) for h in (0, 1)]
        bits = sum(1 << k for k in range(4) if counts[k].any())
        return pa.table({"grams": [_sent(every)], "counts": [packed(*counts)], "kinds": pa.array([bits], pa.int32()), **{f"triples{h}": [_sent(x)] for h, x in enumerate(triples)}})

    sent = texts.mapInArrow(send, "bucket long, kind long, grams binary, n binary")
    return sent.groupBy("bucket").applyInArrow(merge, "grams binary, counts binary, kinds int, triples0 binary, triples1 binary")


def _lookup(keys: np.ndarray, values: np.ndarray, query: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(query))
    at = np.minimum(np.searchsorted(keys, query), len(keys) - 1)
    return np.where(keys[at] == query, values[at], 0.0)


def _smoothed(keys: np.ndarray, n: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of sorted n-grams with counts n; back: those of the order below.  Codes hold the last
    byte in the lowest digit."""
    _, inverse = np.unique(keys // U64(257), return_inverse=True)
    total, kinds = np.bincount(inverse, n)[inverse], np.bincount(inverse)[inverse]
    return np.maximum(n - DISCOUNT, 0) / total + DISCOUNT * kinds / total * back


def _continued(below: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of an order at the ends of those one byte longer, and the number of different bytes before each."""
    return np.unique(below % U64(257**order), return_counts=True)


def pair_probabilities(triples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs and the shared probability of each one's last byte, from the distinct byte triples."""
    pairs, n2 = _continued(triples, 2)
    ones, n1 = _continued(pairs, 1)
    p1 = _smoothed(ones, n1, np.full(len(ones), 1 / (ALPHABET + 1)))
    return pairs, _smoothed(pairs, n2, _lookup(ones, p1, pairs % U64(257)))


def evidence_of(gram: np.ndarray, plain: np.ndarray, toxic: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and their evidence: of each n-gram that a class has seen, and, at its history's code times 257 (no
    byte's digit is 0), of every other byte after that history.

    gram: all n-grams of the labelled texts that end in some byte pairs.  Both classes multiply what they give to unseen
    n-grams by the same shared probability, which cancels, so the lower orders are needed here only.
    """
    if not len(gram):
        return np.empty(0, U64), np.empty(0)
    tables, below = [], gram
    for order in range(ORDER - 1, 2, -1):
        tables.append(_continued(below, order))
        below = tables[-1][0]
    (keys, p), order = pairs, 2
    for suffix, left in tables[::-1]:
        p = _smoothed(suffix, left, _lookup(keys, p, suffix % U64(257**order)))
        keys, order = suffix, order + 1
    back = _lookup(keys, p, gram % U64(257**order))
    past, inverse = np.unique(gram // U64(257), return_inverse=True)
    logs, rest = [], []
    for n in (toxic, plain):
        total = np.bincount(inverse, n)
        t1 = np.maximum(total, 1)
        share = np.where(total > 0, DISCOUNT * np.bincount(inverse, n > 0) / t1, 1.0)
        logs.append(np.log(np.maximum(n - DISCOUNT, 0) / t1[inverse] + share[inverse] * back))
        rest.append(np.log(share))
    codes = np.concatenate((gram, past * U64(257)))
    order = np.argsort(codes)
    return codes[order], np.concatenate((logs[0] - logs[1], rest[0] - rest[1]))[order]


class Evidence:
    """Sorted codes as in evidence_of() and, by model, their evidence in STEPS of a nat."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.codes, self.values = codes, values

    def of(self, gram: np.ndarray, model: int) -> np.ndarray:
        """Evidence of n-grams; those unseen have their history's, or none."""
        if not len(self.codes):
            return np.zeros(len(gram))
        kinds, inverse = np.unique(gram, return_inverse=True)
        at = np.minimum(np.searchsorted(self.codes, kinds), len(self.codes) - 1)
        rest = np.flatnonzero(self.codes[at] != kinds)
        past = kinds[rest] // U64(257) * U64(257)
        at[rest] = np.minimum(np.searchsorted(self.codes, past), len(self.codes) - 1)
        value = self.values[model][at] / STEPS
        value[rest[self.codes[at[rest]] != past]] = 0.0
        return value[inverse]

    def words(self, words: list[bytes], model: int) -> np.ndarray:
        """Log-likelihood of each word under the toxic model less that under the ordinary one."""
        if not words:
            return np.empty(0)
        word, gram = _grams(words)
        return np.bincount(word, self.of(gram, model), len(words))


def bucket_evidence(gram: np.ndarray, counts: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's codes and their evidence by the counts of the first half, of the second and of both."""
    models = []
    for model, kinds in enumerate(([0, 1], [2, 3], [0, 1, 2, 3])):
        plain, toxic = counts[kinds[::2]].sum(0), counts[kinds[1::2]].sum(0)
        own = np.flatnonzero(plain + toxic)
        codes, value = evidence_of(gram[own], plain[own], toxic[own], pairs[model])
        steps = np.clip(np.rint(value * STEPS), -32767, 32767).astype(np.int16)
        models.append(Evidence(codes, steps[None]))
    codes = models[2].codes
    return codes, np.stack([np.rint(m.of(codes, 0) * STEPS).astype(np.int16) for m in models])


def models(texts: DataFrame) -> Evidence | None:
    """The three models of texts (kind, text), or None unless each half has words of both classes."""
    merged = materialize(gram_counts(texts), "toxicity-counts")
    sets = merged.select("kinds", "triples0", "triples1").toArrow()
    if np.bitwise_or.reduce(sets.column("kinds").to_numpy(), initial=0) != 15:
        return None
    triples = [np.unique(np.concatenate([_codes(x) for x in sets.column(c).to_pylist()])) for c in ("triples0", "triples1")]
    pairs = [pair_probabilities(x) for x in (*triples, np.union1d(*triples))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, counts in zip(batch.column("grams").to_pylist(), batch.column("counts").to_pylist()):
                codes, values = bucket_evidence(_codes(grams), np.stack(unpacked(counts, *[np.int64] * 4)), pairs)
                yield pa.RecordBatch.from_arrays([pa.array([_sent(codes)]), pa.array([packed(*values)])], ["codes", "evidence"])

    got = merged.mapInArrow(run, "codes binary, evidence binary").toArrow()
    codes = np.concatenate([_codes(x) for x in got.column("codes").to_pylist()])
    values = np.concatenate([np.stack(unpacked(x, *[np.int16] * 3)) for x in got.column("evidence").to_pylist()], axis=1)
    order = np.argsort(codes)
    return Evidence(codes[order], values[:, order])


class Scorer:
    """Features of texts; words' evidence is kept per task and dropped when it grows beyond its bound."""

    LIMIT = 400_000

    def __init__(self, evidence: Evidence, model: int):
        self.evidence, self.model, self.known = evidence, model, {}

    def features(self, texts: list[bytes]) -> np.ndarray:
        words = [t.split() for t in texts]
        if len(self.known) > self.LIMIT:
            self.known.clear()
        new = list({w for x in words for w in x}.difference(self.known))
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.known.update(zip(part, self.evidence.words(part, self.model).tolist()))
        out = np.zeros((len(texts), 2 + 2 * len(STRONG)))
        for i, x in enumerate(words):
            if x:
                e = np.fromiter(map(self.known.__getitem__, x), float, len(x))
                out[i, 0] = e.mean()
                out[i, 1] = np.log1p(len(x))
                for k, least in enumerate(STRONG):
                    strong = e[e > least].sum()
                    out[i, 2 + 2 * k] = strong / len(x)
                    out[i, 3 + 2 * k] = np.log1p(strong)
        return out


NAMES = [f"f{i}" for i in range(2 + 2 * len(STRONG))]


def _sums(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all rows (y and NAMES) of the columns that of(x, y) makes, in fixed point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            x = np.c_[tuple(batch.column(c).to_numpy() for c in NAMES)]
            total = total + np.rint(of(x, batch.column("y").to_numpy().astype(float)) * FIXED).astype(np.int64).sum(0)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["s"])

    return np.array([sum(x) for x in zip(*rows.mapInArrow(run, "s array<long>").toArrow().column("s").to_pylist())], float) / FIXED


def _curve(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standardised features, the constant last, and the scores."""
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    return z, 1 / (1 + np.exp(-np.clip(sum(z[:, i] * w[i] for i in range(len(w))), -30, 30)))


def fit_logistic(rows: DataFrame, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method on standardised features of all rows; returns mean, scale and weights (constant last)."""
    k = len(NAMES)
    first = _sums(rows, lambda x, y: np.c_[np.ones(len(x)), x])
    mean = first[1:] / first[0]
    spread = np.sqrt(_sums(rows, lambda x, y: (x - mean) ** 2) / first[0])
    scale = np.where(spread > 1e-6, spread, np.inf)  # what doesn't vary doesn't count
    w = np.zeros(k + 1)
    for _ in range(50):

        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z, p = _curve(x, mean, scale, w)
            return np.c_[z * (p - y)[:, None], (z[:, :, None] * z[:, None, :]).reshape(len(z), -1) * (p * (1 - p))[:, None]]

        got = _sums(rows, of)
        step = np.linalg.solve(got[k + 1 :].reshape(k + 1, k + 1) + ridge * np.eye(k + 1), got[: k + 1] + ridge * np.r_[w[:-1], 0])
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame) -> tuple | None:
    """Models and curve from all labelled rows outside the held-out third."""
    marks = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("i").isNotNull() & ~held_out(F.col("i")))
    half = F.pmod(F.xxhash64("i", F.lit("toxicity")), F.lit(2))
    texts = materialize(
        docs.select("doc_id", "text").join(marks.hint("shuffle_hash"), F.col("doc_id") == F.col("i")).select("text", (2 * half + F.col("y")).alias("kind")),
        "toxicity",
    )
    if (found := models(texts)) is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(shared.value, 1), Scorer(shared.value, 0)]  # by the other half's counts
        for batch in batches:
            kind, text = batch.column("kind").to_numpy(), text_bytes(batch.column("text"))
            x = np.zeros((len(text), len(NAMES)))
            for half, scorer in enumerate(scorers):
                own = np.flatnonzero(kind >> 1 == half)
                x[own] = scorer.features([text[i] for i in own.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array((kind & 1).astype(np.int32)), *map(pa.array, x.T)], ["y", *NAMES])

    rows = texts.mapInArrow(run, "y int, " + ", ".join(f"{c} double" for c in NAMES))
    return shared, fit_logistic(materialize(rows, "toxicity-features"))


def scored(docs: DataFrame, labels: DataFrame, column: str = "toxic_score") -> DataFrame:
    """docs with one more column, the score from 0 to 1; its name must be new."""
    spark = docs.sparkSession
    rows_per_batch(spark, 2000)
    model = fit(docs, labels)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            scorer = Scorer(model[0].value, 2)
        for batch in batches:
            if model:
                x = scorer.features(text_bytes(batch.column("text")))
                score = _curve(x, *model[1])[1]
            else:
                score = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = scored(docs.select("doc_id", "text"), labels)
    return s.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
