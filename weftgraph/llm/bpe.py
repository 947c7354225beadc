"""BPE encoding and decoding with a pair occurrence index.

The distinct words that a partition's batch has not seen before become one array of symbols.  An index maps each
mergeable pair, by its rank, to all its positions in that array.  Active ranks are applied in ascending order, each to
all its positions at once, and the merged symbols' neighbours enter the lists of the pairs that they form.  Words share
no pair, so this gives each word the merges that encoding it alone gives.

The vocabulary file (its path is a parameter) is read on the driver and broadcast: its size is fixed by the tokenizer.

Cases: null text is empty and gives no ids; texts may hold the special tokens' strings, which become their ids; rows
are independent, so repeated rows repeat; an empty table gives no rows; other columns are ignored (op6) or kept
(encode_documents).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rows_per_batch

#: Distinct words kept per task, and the words of texts that are encoded together.
CACHE, TOGETHER = 800_000, 500_000
# The contractions of the tokenizer's own pattern.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Unicode White_Space.
SPACES = "\t-\r \x85\xa0  -     　"


@lru_cache(1)
def _pattern() -> re.Pattern:
    """The tokenizer's split, with letters and numbers as ranges so that the standard engine's bitmaps serve."""
    import regex  # knows a newer Unicode than the standard library

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))

    def ranges(name: str) -> str:
        out = []
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out += [(a, b)] if not a < 0xD800 <= b else [(a, 0xD7FF), (0xE000, b)]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

    letters, numbers = ranges("L"), ranges("N")
    return re.compile(f"[{letters}]+|{CONTRACTIONS}|[{numbers}]|[^{SPACES}{letters}{numbers}]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else 256 onwards."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class PairIndex:
    """Vocabulary and merges as sorted arrays; encode() builds and drains one pair occurrence index."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        joined = [a + b for a, b in merges]
        codes = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.rank = codes[order], order
        self.left, self.right = codes >> 32, codes & 0xFFFFFFFF
        self.made = np.array([vocab[x] for x in joined], np.int64)
        self.inner = np.array([vocab[x] for x in byte_symbols()], np.int64)
        self.last = np.array([vocab[x + end] for x in byte_symbols()], np.int64)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def ranks(self, codes: np.ndarray) -> np.ndarray:
        """Rank of each pair code, -1 where it never merges."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.rank[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        nxt = np.arange(1, len(sym) + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, len(sym) - 1)
        prv[ends[:-1]] = -1
        positions: dict[int, list[np.ndarray]] = defaultdict(list)

        def enter(at: np.ndarray) -> list[int]:
            """Put the pairs that start at these positions into the index; returns their ranks."""
            rank = self.ranks(sym[at] << 32 | sym[nxt[at]])
            good = rank >= 0
            at, rank = at[good], rank[good]
            if not len(at):
                return []
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            found = rank[np.concatenate(([0], cuts))].tolist()
            for r, part in zip(found, np.split(at, cuts)):
                positions[r].append(part)
            return found

        heap = enter(np.flatnonzero(nxt >= 0))
        while heap:
            r = heapq.heappop(heap)
            if r not in positions:
                continue
            parts = positions.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at) > 1:  # of overlapping pairs the left one merges
                free, keep = -1, []
                for p, q in zip(np.sort(at).tolist(), nxt[np.sort(at)].tolist()):
                    if p != free:
                        keep.append(p)
                        free = q
                    else:
                        free = -1
                at = np.array(keep)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone], nxt[at] = self.made[r], -1, after
            inside = after >= 0
            prv[after[inside]] = at[inside]
            before = prv[at]
            for x in enter(np.unique(np.concatenate((at[inside], before[before >= 0])))):
                heapq.heappush(heap, x)
        alive = sym >= 0
        counts = np.concatenate(([0], np.cumsum(alive)))[ends]
        stream = sym[alive].astype("<u4").tobytes()
        return [stream[4 * i : 4 * j] for i, j in zip([0, *counts[:-1].tolist()], counts.tolist())]


class Encoder:
    def __init__(self, spec: dict):
        self.index, self.pattern, self.known = PairIndex(spec), _pattern(), {}

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() minds a word's end
        return self.pattern.findall(text.lower())

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, as bytes; texts go through the index together, as many as TOGETHER words."""
        group, n = [], 0
        for text in texts:
            parts = self.index.cut.split(text) if text and self.index.cut and "<|" in text else [text or ""]
            group.append([[p] if i % 2 else self.words(p) for i, p in enumerate(parts)])
            n += sum(map(len, group[-1]))
            if n > TOGETHER:
                yield from self._ids(group)
                group, n = [], 0
        yield from self._ids(group)

    def _ids(self, group: list[list[list[str]]]) -> Iterator[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        new = set()
        for parts in group:
            for words in parts[::2]:
                new.update(words)
        new.difference_update(self.known)
        if new:
            self.known.update(zip(new, self.index.encode([w.encode() for w in new])))
        ids = self.known.__getitem__
        for parts in group:
            yield b"".join(
                b"".join(map(ids, p)) if not i % 2 else self.index.special[p[0]].to_bytes(4, "little") for i, p in enumerate(parts)
            )

    def decode(self, ids: bytes) -> str:
        """The tokens joined by spaces: what a tokenizer without a decoder does."""
        return " ".join(map(self.index.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _spec(spark, path: str | None):
    with open(path or default_vocabulary()) as f:
        return spark.sparkContext.broadcast(json.load(f))


def op6_bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    rows_per_batch(spark, 2000)
    spec = _spec(spark, path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec.value)
        for batch in batches:
            n, ids, decoded = [], [], []
            for x in encoder.encode(batch.column("text").to_pylist()):
                n.append(len(x) // 4)
                ids.append(hashlib.sha256(x).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(x).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, lang, source, n_tokens, the ids themselves, and the digest of the text that they decode to."""
    spark = docs.sparkSession
    rows_per_batch(spark, 2000)
    spec = _spec(spark, path)
    schema = "doc_id long, lang string, source string, n_tokens long, ids array<int>, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec.value)
        for batch in batches:
            parts = [np.frombuffer(x, "<i4") for x in encoder.encode(batch.column("text").to_pylist())]
            decoded = [hashlib.sha256(encoder.decode(x.tobytes()).encode()).hexdigest() for x in parts]
            n = [len(x) for x in parts]
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "lang", "source")), pa.array(n, pa.int64()), ids, pa.array(decoded, pa.string())],
                ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"],
            )

    return docs.select(docs["doc_id"].cast("long"), "lang", "source", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded text of rows with ids."""
    spec = _spec(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec.value)
        for batch in batches:
            texts = [encoder.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded["doc_id"].cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
