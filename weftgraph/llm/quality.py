"""Quality rules: n-gram perplexity bands by language, and base counts.

A modified Kneser-Ney model of word pairs is counted in Spark over every document, one model a language, in buckets of
sorted pair hashes whose number grows with the corpus; nothing of it is gathered or broadcast.  The corpus falls into two
halves, by the smallest pair hash of a text, so that copies and most near copies are in one half, and a document is scored
by the counts of the other half: neither itself nor its copies vouch for it.  Words not seen after the word before are
spelled by a byte trigram model (24-bit codes, 2^24 entries a language at most), which also scores white space.

1. Each task sends the distinct pairs of CHUNK_BYTES of text and their counts to the buckets of the words before.  A word
   whose pairs would fill a bucket is split over several by the word behind it.
2. A bucket answers each chunk with the other half's counts of its pairs and of the words before.
3. The texts are read once more; each chunk sends what its documents need beside the answers, meets them and adds up.

A document is kept if it passes the base rules, its log-perplexity by bytes alone lies inside its language's band (the
median, less `lower` and plus `upper` spreads) and that by word pairs is not above its own median by more than `upper`
spreads; it has no lower bound, as passages that many texts quote are well predicted.  Medians and spreads are exact
percentiles of all documents of the language that pass the base rules, on values rounded to 0.001.  A document's own
length widens its band, since the mean over few bytes scatters more.

Steps 1 and 3 must see the same batches, as scans of files do; counts that disagree raise an error.

Cases: null or empty text has no words and fails; null lang is a language of its own; null ids and repeated rows are
rows like any other; a language with one document has a band around it; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import SPACE, U64, materialize, mix64, rows_per_batch, sequence_starts, span_hashes, text_array, windows_hash, word_spans
from .sketch import packed, unpacked

#: Spreads below and above the median that are still kept, the least spread, and the scatter of a mean over n bytes.
LOWER, UPPER, LEAST_SPREAD, SCATTER = 6.0, 4.5, 0.02, 0.7
#: Bytes of text that a bucket of word pairs stands for, and bytes of text whose pairs are sent together, about.
BUCKET_BYTES, CHUNK_BYTES = 32 << 20, 32 << 20
#: Tokens of a chunk that are sorted at once, about.
SORTED = 1 << 18
#: Bits of a word's hash beside those of the word before it, and how many of them tell words after an uncommon one apart;
#: a word is common if it comes more than 1/COMMON of a bucket's words; steps of a nat in which a pair's spelling travels.
WORD_BITS, FEW_BITS, COMMON, STEPS = 28, 20, 64, 1
FACTOR = 0x9E3779B97F4A7C15
_CHARACTER = np.array([(b & 0xC0) != 0x80 for b in range(256)]) & ~SPACE
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _codes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trigram code of each byte after the two before it in its text (0 before the start); codes of the texts' ends."""
    code = data.astype(np.uint32)
    heads = cuts[:-1]
    own = np.diff(cuts)
    for back in (1, 2):
        part = np.zeros(len(data), np.uint32)
        part[back:] = data[:-back].astype(np.uint32) << np.uint32(8 * back)
        for k in range(back):
            part[heads[own > k] + k] = 0
        code |= part
    ends = np.zeros(len(own), np.uint32)
    some = np.flatnonzero(own)
    ends[some] = code[cuts[1:][some] - 1] << np.uint32(8) & np.uint32(0xFFFFFF)
    return code, ends


def _spelling_codes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The trigram codes of the words' bytes as if two blanks came before each word; other bytes keep theirs."""
    code = code.copy()
    code[starts] = code[starts] & 0xFF | 0x202000
    second = starts[ends - starts > 1] + 1
    code[second] = code[second] & 0xFFFF | 0x200000
    return code


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, by Chen and Goodman's estimate."""
    n1, n2, n3, n4 = (max(1, int((n == k).sum())) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0.05, [0.95, 1.9, 2.8])


class TrigramModel:
    """Sorted trigram codes with log-probabilities, and the dense lower orders to back off to."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        order, self.n_bytes = np.argsort(gram), int(n.sum())
        self.gram, n = gram[order].astype(np.uint32), n[order].astype(float)
        pairs = np.unique(self.gram & 0xFFFF, return_counts=True)
        continued = np.zeros(65536)
        continued[pairs[0]] = pairs[1]
        ends = np.bincount(np.flatnonzero(continued) & 0xFF, minlength=256).astype(float)
        p1 = 0.9 * ends / max(1.0, ends.sum()) + 0.1 / 256
        self.p2 = self._smooth(np.arange(65536), continued, np.arange(65536) >> 8, 256, np.tile(p1, 256))[0]
        history = (self.gram >> 8).astype(np.int64)
        p3, self.back = self._smooth(self.gram, n, history, 65536, self.p2[self.gram & 0xFFFF])
        self.log3 = np.log(p3)

    @staticmethod
    def _smooth(gram, n, history, histories, below) -> tuple[np.ndarray, np.ndarray]:
        """Interpolated probabilities of the n-grams, and each history's weight of the order below."""
        d = _discounts(n[n > 0])
        total = np.bincount(history, n, histories)
        cut = d[np.clip(n, 1, 3).astype(int) - 1] * (n > 0)
        saved = np.bincount(history, np.minimum(cut, n), histories)
        back = np.where(total > 0, saved / np.maximum(total, 1e-9), 1.0)
        return np.maximum(n - cut, 0) / np.maximum(total, 1e-9)[history] + back[history] * below, back

    def logs(self, code: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.gram, code), len(self.gram) - 1)
        seen = self.gram[at] == code
        return np.where(seen, self.log3[at], np.log(self.back[code >> 8] * self.p2[code & 0xFFFF]))


class Distinct:
    """Distinct 24-bit codes and the number of each code among them, by tables in place of sorting."""

    def __init__(self):
        self.seen, self.number = np.zeros(1 << 24, bool), np.empty(1 << 24, np.int32)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.seen[codes] = True
        touched = np.zeros(1 << 12, bool)
        touched[codes >> 12] = True
        blocks = np.flatnonzero(touched)  # most of the table is never touched
        at = np.flatnonzero(self.seen.reshape(1 << 12, 1 << 12)[blocks])
        kinds = blocks[at >> 12] << 12 | at & 0xFFF
        self.seen[kinds] = False
        self.number[kinds] = np.arange(len(kinds), dtype=np.int32)
        return kinds.astype(np.uint32), self.number[codes]


def _by_lang(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, list[tuple[str | None, int, int]]]:
    """The batch in the order of its languages, and each language with its first and last row."""
    langs = batch.column("lang").to_pylist()
    order = sorted(range(len(langs)), key=lambda i: (langs[i] is not None, langs[i] or ""))
    names = [langs[i] for i in order]
    cuts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
    return batch.take(pa.array(order, pa.int64())), [(names[i], i, j) for i, j in zip(cuts, [*cuts[1:], len(names)])]


def _lang_hash(lang: str | None) -> int:
    return xxhash.xxh3_64_intdigest(b"" if lang is None else b"=" + lang.encode())


def statistics(docs: DataFrame, buckets: int = 1) -> tuple[dict[str | None, TrigramModel], dict[int, int]]:
    """One byte model a language, from counts over all documents; and the common histories, COMMON a bucket at most, with
    the number of buckets to split each over, so that none fills more than about half a bucket."""
    docs = docs.select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct()
        for batch in batches:
            batch, langs = _by_lang(batch)
            data, cuts = text_array(batch.column("text"))
            code, ends = _codes(data, cuts)
            starts, stops, sizes = word_spans(data, cuts, apart=True)
            word, upto = span_hashes(data, starts, stops), sequence_starts(sizes)
            for lang, a, b in langs:
                gram, inverse = distinct.of(np.concatenate((code[cuts[a] : cuts[b]], ends[a:b])))
                rows = [(False, gram.astype(np.int64), np.bincount(inverse))]
                w = np.sort(word[upto[a] : upto[b]])
                first = np.flatnonzero(_changes(w))
                n = np.diff(np.append(first, len(w)))
                many = np.flatnonzero(n >= len(w) / (2 * COMMON * buckets))
                before, n = np.append(w[first[many]], U64(0)), np.append(n[many], b - a)
                rows.append((True, mix64(before ^ U64(_lang_hash(lang))).view(np.int64), n))
                for kind, gram, n in rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()), pa.array([kind] * len(gram)), pa.array(gram), pa.array(n.astype(np.int64))],
                        ["lang", "word", "gram", "n"],
                    )

    found = materialize(docs.mapInArrow(run, "lang string, word boolean, gram long, n long").groupBy("lang", "word", "gram").agg(F.sum("n").alias("n")), "quality-counts")
    grams = found.where("not word").toArrow()
    gram, n = grams.column("gram").to_numpy().astype(np.uint32), grams.column("n").to_numpy()
    number = grams.column("lang").combine_chunks().dictionary_encode()
    index = number.indices.fill_null(-1).to_numpy()
    names = [*number.dictionary.to_pylist(), None]
    models = {names[i]: TrigramModel(gram[index == i], n[index == i]) for i in np.unique(index).tolist()}
    share = max(1.0, sum(m.n_bytes for m in models.values()) / 6.5 / buckets)  # words of a bucket, about
    heavy = found.where(F.col("word") & (F.col("n") > share / COMMON)).withColumn("parts", F.least(F.lit(buckets), F.ceil(2 * F.col("n") / share)))
    return models, {r.gram: int(r.parts) for r in heavy.select("gram", "parts").collect()}


def fit(docs: DataFrame) -> dict[str | None, TrigramModel]:
    """One byte model a language, from counts over all documents."""
    return statistics(docs)[0]


def _equal_neighbours(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with equal hashes in one text, next to each other in the order of the hashes."""
    key = mix64(hashes ^ mix64(doc.astype(U64)))
    order = np.argsort(key)
    again = np.flatnonzero(~_changes(key[order]))
    return order[again - 1], order[again]


def base_counts(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_words, n_dup_lines, n_repeat_words of each text."""
    starts, ends, sizes = word_spans(data, cuts)
    lines, doc = np.zeros(len(sizes), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    word = span_hashes(data, starts, ends)
    inside = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.empty(0, np.int64)
    a, b = _equal_neighbours(doc[inside], windows_hash(word, 3, FACTOR)[inside])
    a, b = inside[a], inside[b]
    same = (word[a] == word[b]) & (word[a + 1] == word[b + 1]) & (word[a + 2] == word[b + 2])
    covered = np.zeros(len(word), bool)
    for at in (a[same], b[same]):
        for k in range(3):
            covered[at + k] = True
    repeats = np.diff(np.concatenate(([0], np.cumsum(covered)))[sequence_starts(sizes)])
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate((cuts, breaks + 1)))
    a, b = edges[:-1], edges[1:].copy()
    b[np.isin(b - 1, breaks)] -= 1
    full = np.searchsorted(starts, a) < np.searchsorted(starts, b)  # lines with a word
    a, b = a[full], b[full]
    doc = np.searchsorted(cuts, a, "right") - 1
    for i in np.unique(doc[_equal_neighbours(doc, span_hashes(data, a, b))[1]]).tolist():
        some = [x for x in data[cuts[i] : cuts[i + 1]].tobytes().split(b"\n") if x.strip()]
        lines[i] = len(some) - len(set(some))
    return sizes, lines, repeats


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys differs from the one before; the first place counts."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


class Tokens:
    """The tokens of one batch of texts, in the order of languages, as hashes, and which half each text belongs to."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, langs: list[tuple[str | None, int, int]]):
        self.starts, self.ends, self.sizes = word_spans(data, cuts, apart=True)
        self.word = span_hashes(data, self.starts, self.ends)
        first = sequence_starts(self.sizes)[:-1]
        some = np.flatnonzero(self.sizes)
        before = np.concatenate((np.zeros(min(1, len(self.word)), U64), self.word[:-1]))
        before[first[some]] = 0
        self.row = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        names = np.concatenate([np.full(b - a, _lang_hash(lang), U64) for lang, a, b in langs])
        self.history = mix64(before ^ names[self.row])
        self.half = np.zeros(len(self.sizes), np.int64)
        if len(some):
            least = np.minimum.reduceat(mix64(before * U64(FACTOR) + self.word), first[some])
            self.half[some] = (mix64(least) & U64(1)).astype(np.int64)


class Keys:
    """A batch's tokens as buckets hold them: their keys in the order of halves and buckets, the text and the steps of
    spelling of each, and which heavy histories each half has."""

    def __init__(self, tokens: Tokens, heavy: tuple[np.ndarray, np.ndarray], buckets: int, steps: np.ndarray | None = None):
        names, split = heavy
        side, word = tokens.half[tokens.row], tokens.word
        bucket, bits = tokens.history & U64(0xFFFFFFFF), np.full(len(word), 64 - FEW_BITS, np.uint8)
        self.half, self.heavy = tokens.half, np.zeros((2, len(names)), bool)
        if len(names):
            at = np.minimum(np.searchsorted(names, tokens.history), len(names) - 1)
            hot = np.flatnonzero(names[at] == tokens.history)
            at = at[hot]
            bucket[hot] += (word[hot] & U64(0xFFFF)) % split[at]
            bits[hot] = 64 - WORD_BITS
            self.heavy[side[hot], at] = True
        bucket = (bucket % U64(buckets)).astype(np.int64) + side * buckets
        bucket = bucket.astype(np.uint16) if 2 * buckets <= 1 << 16 else bucket
        order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[order]  # those of the second half follow those of the first
        self.key = (tokens.history >> U64(32) << U64(WORD_BITS) | word >> bits)[order]
        self.row = tokens.row[order]
        self.steps = None if steps is None else steps[order]


class Pairs:
    """Word pairs in the order in which buckets hold them, each once; the first `real` keys are occurrences."""

    def __init__(self, key: np.ndarray, bucket: np.ndarray, real: int):
        order = np.argsort(key)
        order = order[np.argsort(bucket[order], kind="stable")]
        key, bucket, real = key[order], bucket[order], order < real
        first = np.flatnonzero(_changes(key, bucket))
        self.places = order[real]  # occurrences by pair
        self.times = np.add.reduceat(real, first, dtype=np.uint32)
        self.example = order[first]  # an occurrence of each pair, or beyond all of them
        self.key, self.bucket = key[first], bucket[first]
        self.new = _changes(self.key >> U64(WORD_BITS), self.bucket)
        self.buckets = np.flatnonzero(_changes(self.bucket))

    def by_bucket(self) -> Iterator[tuple[int, slice]]:
        for a, b in zip(self.buckets.tolist(), [*self.buckets[1:].tolist(), len(self.key)]):
            yield int(self.bucket[a]), slice(a, b)


def stretches(held: list[Keys], half: int, heavy: tuple[np.ndarray, np.ndarray], buckets: int) -> Iterator[tuple[Pairs, list[tuple[Keys, slice]]]]:
    """The pairs of one half, some neighbouring buckets at a time, of about SORTED tokens, and where these tokens are held;
    a heavy history asks all of its buckets."""
    names, split = heavy
    here = np.flatnonzero(np.any([k.heavy[half] for k in held], axis=0) & (split > 1))
    more = np.repeat(names[here], split[here].astype(np.int64))
    more_at = np.concatenate([*(np.arange(int(k)) for k in split[here]), np.empty(0, np.int64)]).astype(np.int64)
    more_at = ((more & U64(0xFFFFFFFF)).astype(np.int64) + more_at) % buckets
    more = more >> U64(32) << U64(WORD_BITS)
    own = [slice(*np.searchsorted(k.bucket, [half * buckets, (half + 1) * buckets]).tolist()) for k in held]
    n = np.bincount(more_at, minlength=buckets)
    for k, s in zip(held, own):
        n += np.bincount(k.bucket[s].astype(np.int64) - half * buckets, minlength=buckets)
    edges = np.flatnonzero(_changes((np.cumsum(n) - n) // SORTED)).tolist()
    for low, high in zip(edges, [*edges[1:], buckets]):
        where = [(k, slice(*np.searchsorted(k.bucket, [half * buckets + low, half * buckets + high]).tolist())) for k in held]
        asked = (more_at >= low) & (more_at < high)
        key = np.concatenate([*(k.key[s] for k, s in where), more[asked]])
        if len(key):
            bucket = np.concatenate([*(k.bucket[s] - k.bucket.dtype.type(half * buckets) for k, s in where), more_at[asked].astype(held[0].bucket.dtype)])
            yield Pairs(key, bucket, len(key) - int(asked.sum())), where


def _chunks(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[int, list]]:
    """read(batch) of enough batches for CHUNK_BYTES of text, under a number that the same scan gives again."""
    held, size, number, part = [], 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        held.append(read(batch))
        size += batch.column("text").nbytes
        if size >= CHUNK_BYTES:
            yield part << 32 | number << 1, held
            held, size, number = [], 0, number + 1
    if held:
        yield part << 32 | number << 1, held


def answers(halves: list[list[np.ndarray]], times: list[list[np.ndarray]]) -> list[list[tuple]]:
    """For the sorted keys of each blob of each half: the other half's counts of these pairs; of each history in turn
    its count and what its pairs leave to spelling, in the leading 16 bits of a float; and the discounts."""
    flat = [k for half in halves for k in half]
    keys, inverse = np.unique(np.concatenate(flat), return_inverse=True)
    cuts = sequence_starts(np.fromiter(map(len, flat), np.int64, len(flat)))
    history = np.cumsum(_changes(keys >> U64(WORD_BITS))) - 1
    out, at = [], 0
    counts = []
    for half, n in zip(halves, times):
        own = inverse[cuts[at] : cuts[at + len(half)]]
        counts.append(np.bincount(own, np.concatenate([*n, np.empty(0)]), len(keys)).astype(np.int64))
        at += len(half)
    at = 0
    for half, n in zip(halves, counts[::-1]):
        discounts, mine = _discounts(n[n > 0]), []
        saved = np.bincount(history, np.where(n > 0, discounts[np.clip(n, 1, 3) - 1], 0)).astype(np.float32)
        table = [np.bincount(history, n).astype(np.uint32), ((saved.view(np.uint32) + np.uint32(1 << 15)) >> np.uint32(16)).astype(np.uint16)]
        for k in range(at, at + len(half)):
            i = inverse[cuts[k] : cuts[k + 1]]
            h = history[i]
            h = h[_changes(h)] if len(h) else h
            mine.append((n[i].astype(np.uint32), [x[h] for x in table], discounts))
        out.append(mine)
        at += len(half)
    return out


def gains(count, total, saved, discounts, history, spelled) -> np.ndarray:
    """Log-probability of each pair above that of its spelling.

    count: of each pair; history: its place in total and saved, what its pairs leave to spelling; discounts: of counts 1,
    2 and 3 or more.
    """
    cut = np.where(count > 0, discounts[np.clip(count, 1, 3) - 1], 0.0)
    t = np.maximum(total[history], 1)
    with np.errstate(divide="ignore"):
        seen, back = np.log(np.maximum(count - cut, 0) / t), np.log(saved[history] / t)
    return np.where(total[history] > 0, np.logaddexp(seen - spelled, back), 0.0)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, log_perplexity by word pairs and log_spelling by bytes of every document."""
    spark = docs.sparkSession
    rows_per_batch(spark, 500)
    docs = docs.select(F.col("doc_id").cast("long"), "lang", "text", F.spark_partition_id().alias("part"))
    buckets = max(12, (docs.select(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    fitted, split = statistics(docs, buckets)
    names = np.array(sorted(x & (1 << 64) - 1 for x in split), U64)
    parts = np.array([split[int(x.astype(np.int64))] for x in names], U64)
    models, heavy = spark.sparkContext.broadcast(fitted), spark.sparkContext.broadcast((names, parts))
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes"]
    arrow = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), *((c, pa.binary()) for c in "abcd")])
    sent = "chunk long, bucket long, a binary, b binary, c binary, d binary"
    row_type = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in counted), ("log_perplexity", pa.float64()), ("log_spelling", pa.float64())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(batch: pa.RecordBatch) -> Keys:
            batch, langs = _by_lang(batch)
            return Keys(Tokens(*text_array(batch.column("text")), langs), heavy.value, buckets)

        for chunk, held in _chunks(batches, read):
            for half in (0, 1):
                for p, _ in stretches(held, half, heavy.value, buckets):
                    yield table([(chunk | half, b, packed(np.diff(p.key[s], prepend=U64(0)), p.times[s]), None, None, None) for b, s in p.by_bucket()])
            held.clear()  # before the next chunk is read

    def answer(group: pa.Table) -> pa.Table:
        chunks, bucket = group.column("chunk").to_pylist(), group.column("bucket")[0].as_py()
        halves, times, who = ([], []), ([], []), ([], [])
        for chunk, blob in zip(chunks, group.column("a").to_pylist()):
            key, n = unpacked(blob, U64, np.uint32)
            halves[chunk & 1].append(np.cumsum(key))
            times[chunk & 1].append(n)
            who[chunk & 1].append(chunk)
        rows = []
        for mine, found in zip(who, answers(list(halves), list(times))):
            rows += [(c, bucket, packed(n), packed(*kinds), d.tobytes(), None) for c, (n, kinds, d) in zip(mine, found)]
        return pa.Table.from_batches([table(rows)])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct()

        def read(batch: pa.RecordBatch) -> tuple[Keys, pa.RecordBatch]:
            batch, langs = _by_lang(batch)
            data, cuts = text_array(batch.column("text"))
            tokens, n = Tokens(data, cuts, langs), len(cuts) - 1
            sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[cuts])
            upto, (code, ends) = sequence_starts(tokens.sizes), _codes(data, cuts)
            respelled = _spelling_codes(code, tokens.starts, tokens.ends)
            between, spelling, spelled = np.zeros(n), np.zeros(n), np.zeros(len(tokens.word), np.float32)
            for lang, a, b in langs:
                kinds, inverse = distinct.of(np.concatenate((code[cuts[a] : cuts[b]], ends[a:b])))
                logs = models.value[lang].logs(kinds)[inverse]
                ending = logs[cuts[b] - cuts[a] :]
                own = cuts[a : b + 1] - cuts[a]
                logs = logs[: own[-1]]
                total = np.concatenate(([0.0], np.cumsum(logs)))
                spelling[a:b] = -(np.diff(total[own]) + ending) / (np.diff(own) + 1)
                total = np.concatenate(([0.0], np.cumsum(np.where(SPACE[data[cuts[a] : cuts[b]]], logs, 0.0))))
                between[a:b] = np.diff(total[own]) + ending  # bytes of words are scored as words
                kinds, inverse = distinct.of(respelled[cuts[a] : cuts[b]])
                total = np.concatenate(([0.0], np.cumsum(models.value[lang].logs(kinds)[inverse])))
                mine = slice(upto[a], upto[b])
                spelled[mine] = total[tokens.ends[mine] - cuts[a]] - total[tokens.starts[mine] - cuts[a]]
            between += np.bincount(tokens.row, spelled, n)
            words, lines, repeats = base_counts(data, cuts)
            columns = (batch.column("doc_id"), batch.column("lang"), words, sums(_CHARACTER[data]), sums(_SYMBOL[data]), lines, repeats, np.diff(cuts), between, spelling)
            found = pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, row_type)], schema=row_type)
            return Keys(tokens, heavy.value, buckets, np.clip(np.rint(-spelled * STEPS), 0, 255).astype(np.uint8)), found

        for chunk, held in _chunks(batches, read):
            docs = pa.Table.from_batches([x[1] for x in held]).combine_chunks()
            held[:] = [x[0] for x in held]
            halves, base = np.concatenate([k.half for k in held]), sequence_starts(np.array([len(k.half) for k in held]))
            for half in (0, 1):
                mine = np.flatnonzero(halves == half)
                if not len(mine):
                    continue
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, row_type, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(docs.take(pa.array(mine)))
                number, found = np.cumsum(halves == half, dtype=np.uint32) - np.uint32(1), []  # number: of a text in its half
                at = {id(k): number[a:] for k, a in zip(held, base.tolist())}
                for p, where in stretches(held, half, heavy.value, buckets):
                    place = np.concatenate([at[id(k)][k.row[s]] for k, s in where])
                    steps = np.concatenate([*(k.steps[s] for k, s in where), np.zeros(1, np.uint8)])
                    found.append((p.times, p.new.astype(np.uint8), steps[np.minimum(p.example, len(place))], place[p.places], p.key[p.new] >> U64(WORD_BITS)))
                if not found:
                    yield table([(chunk | half, -1, None, None, sink.getvalue().to_pybytes(), None)])
                    continue
                times, new, spelled, place, names = (np.concatenate(x) for x in zip(*found))
                del found
                # histories that lie in several buckets, by their places among all histories of the chunk
                kinds, which, n = np.unique(names, return_inverse=True, return_counts=True)
                several = np.flatnonzero(n[which] > 1) if len(heavy.value[0]) else np.empty(0, np.int64)
                yield table([(chunk | half, -1, packed(times, new, spelled), packed(place), sink.getvalue().to_pybytes(),
                              packed(several.astype(np.uint32), which[several].astype(np.uint32)))])
                del times, new, spelled, place, names, kinds, which, n, several
            held.clear()  # before the next chunk is read
            del docs

    def gather(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["bucket", "a", "b", "c", "d"]).to_pylist(), key=lambda r: r["bucket"])
        docs, found = rows[0], rows[1:]
        if docs["bucket"] != -1 or bool(found) != bool(docs["a"]):
            raise RuntimeError("two scans of the documents gave different batches; write them as a table first")
        out = pa.ipc.open_stream(docs["c"]).read_all()
        logs = out["log_perplexity"].to_numpy().copy()
        if found:
            times, new, spelled = unpacked(docs["a"], np.uint32, np.uint8, np.uint8)
            place, (several, which) = unpacked(docs["b"], np.uint32)[0], unpacked(docs["d"], np.uint32, np.uint32)
            counts = [unpacked(r["a"], np.uint32)[0] for r in found]
            kinds = [unpacked(r["b"], np.uint32, np.uint16) for r in found]
            cuts = [np.frombuffer(r["c"], float) for r in found]
            if sum(map(len, counts)) != len(times) or sum(len(x[0]) for x in kinds) != int(new.sum()):
                raise RuntimeError("two scans of the documents gave different batches; write them as a table first")
            total = np.concatenate([x[0] for x in kinds]).astype(float)
            saved = (np.concatenate([x[1] for x in kinds]).astype(np.uint32) << np.uint32(16)).view(np.float32).astype(float)
            if len(several):
                for x in (total, saved):
                    x[several] = np.bincount(which, x[several])[which]
            history, at, gain = np.cumsum(new, dtype=np.int32) - 1, 0, np.empty(len(times))
            for n, d in zip(counts, cuts):
                s = slice(at, at := at + len(n))
                gain[s] = gains(n.astype(np.int64), total, saved, d, history[s], spelled[s] / -STEPS)
            logs += np.bincount(place, np.repeat(gain, times), len(logs))
        logs = -logs / (out["n_bytes"].to_numpy() + 1)
        return out.set_column(out.schema.get_field_index("log_perplexity"), "log_perplexity", pa.array(logs))

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    answered = docs.mapInArrow(count, sent).groupBy("bucket").applyInArrow(answer, sent)
    rows = answered.unionByName(docs.mapInArrow(describe, sent)).groupBy("chunk").applyInArrow(
        gather, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in counted) + ", log_perplexity double, log_spelling double"
    )
    return rows.withColumn("base_failed", failed)


def judged(docs: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """measured() with each document's band and verdict."""
    rows = materialize(measured(docs), "quality")
    p = lambda c: F.percentile(F.round(c, 3), [0.16, 0.5, 0.84])
    spread = lambda q: F.greatest((F.col(q)[2] - F.col(q)[0]) / 2, F.lit(LEAST_SPREAD))
    bands = (
        rows.where("not base_failed").groupBy("lang").agg(p("log_perplexity").alias("q"), p("log_spelling").alias("s"))
        .select(F.col("lang").alias("l"), F.col("q")[1].alias("middle"), spread("q").alias("spread"),
                F.col("s")[1].alias("spelling_middle"), spread("s").alias("spelling_spread"))
    )
    slack = lambda c: F.sqrt(F.col(c) ** 2 + F.lit(SCATTER**2) / F.greatest(F.col("n_bytes"), F.lit(1)))
    rows = rows.join(F.broadcast(bands), F.col("lang").eqNullSafe(F.col("l")), "left")  # one row a language
    inside = F.col("log_spelling").between(F.col("spelling_middle") - lower * slack("spelling_spread"), F.col("spelling_middle") + upper * slack("spelling_spread"))
    inside = inside & (F.col("log_perplexity") <= F.col("middle") + upper * slack("spread"))
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op3_quality(docs: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "lang", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.exp("log_perplexity").alias("perplexity"),
    )
