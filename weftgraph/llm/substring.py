"""Substring dedup: a count-min prefilter, then exact groups of the windows that it estimates repeated.

Pass 1: the anchor of a window of `width` words is the leftmost smallest hash of the ANCHOR-word strings in it, so equal
windows have equal anchors, at different places.  Groups of documents count their anchors (one in about a dozen words) in
sketches that merge by adding, slice by slice (sketch.py).  Counts only ever overestimate, so windows whose anchor counts
below 2 are unique: none that repeats is lost.
Pass 2: windows estimated repeated are grouped exactly, by 96 bits of two independent hashes; windows that repeat inside
one group of documents are decided there and sent once, so none grows beyond the number of groups.
Pass 3: the marks meet their documents again, in groups of neighbouring rows, and covered words go.

Rows are told apart by their place in the scan, so docs must be a scan of files or a table that materialize() wrote.

Cases: null text has no words; texts shorter than the window lose nothing; repeated rows are documents of their own and
lose all their windows; null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, expand, rows_per_batch, sequence_starts, span_hashes, text_array, text_bytes, windows_hash, word_spans
from .sketch import GROUP_ROWS, grouped_texts, may_repeat, numbered, repeated, slices_for, texts_of

WIDTH, ANCHOR = 35, 12
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def leftmost_least(values: np.ndarray, n: int) -> np.ndarray:
    """For every n neighbouring values, the place of the first smallest."""
    best, size = np.arange(len(values)), 1
    while size < n:
        step = min(size, n - size)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[a] <= values[b], a, b)
        size += step
    return best


class Windows:
    """All windows of some texts: the text's number, the first word's number in its text and in all, and the anchor."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, width: int):
        starts, ends, sizes = word_spans(data, cuts)
        self.word = span_hashes(data, starts, ends)
        n, anchor = np.maximum(sizes - width + 1, 0), min(ANCHOR, width)
        first = sequence_starts(sizes)[:-1]
        self.at = expand(first, n)
        self.doc = np.repeat(np.arange(len(sizes)), n)
        self.start = self.at - first[self.doc]
        if len(self.at):
            grams = windows_hash(self.word, anchor, FACTORS[0])
            place = leftmost_least(grams, width - anchor + 1)[self.at]
            self.anchor = grams[place]
            self.counted = self.anchor[np.flatnonzero(np.diff(place, prepend=-1))]
        else:
            self.anchor = self.counted = np.empty(0, U64)


def repeated_windows(docs: DataFrame, texts: DataFrame, width: int, shift: int) -> DataFrame:
    """group, rids, starts: the windows (document's rid, first word) whose word sequence starts elsewhere too.

    docs: numbered(); texts: grouped_texts(docs); rids and starts are packed arrays.
    """
    windows = max(1, (docs.select(F.sum(F.octet_length("text"))).first()[0] or 0) // 6)  # about; it only sizes things
    slices, buckets = slices_for(windows // 12), max(16, windows // 1_000_000)
    found = repeated(docs, lambda batch: Windows(*text_array(batch.column("text")), width).counted, slices)

    def candidates(texts: pa.Table, found: pa.Table) -> pa.Table:
        batch = texts_of(texts)
        w = Windows(*text_array(batch.column("text")), width)
        at = np.flatnonzero(may_repeat(w.anchor, slices, found))
        rows, rid = [], batch.column("rid").to_numpy()
        if len(at):
            h, g = (windows_hash(w.word, width, f)[w.at[at]] for f in FACTORS)
            doc, start = w.doc[at], w.start[at]
            g, rid = g & U64(0xFFFFFFFF), rid[doc]
            by = np.lexsort((g, h))
            h, g, rid, start = h[by], g[by], rid[by], start[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(h))) > 1  # decided here; the key goes on, once, for other batches
            sure = np.repeat(many, np.diff(np.append(first, len(h))))
            key, low, bucket = h[first], g[first].astype(np.uint32), (h[first] % U64(buckets)).astype(np.int64)
            base = rid.min()
            order = np.argsort(bucket, kind="stable")
            key, low, many, bucket, first = key[order], low[order], many[order], bucket[order], first[order]
            some, cuts = np.unique(bucket, return_index=True)
            known = np.flatnonzero(sure)
            for k, (b, i, j) in enumerate(zip(some.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(bucket)])):
                part, own = slice(i, j), known[k :: len(some)]  # decided windows only pass through: dealt evenly
                f = first[part]
                rows.append((b, int(base), key[part].tobytes(), low[part].tobytes(), many[part].tobytes(),
                             (rid[f] - base).astype(np.uint32).tobytes(), start[f].astype(np.uint32).tobytes(),
                             (rid[own] - base).astype(np.uint32).tobytes(), start[own].astype(np.uint32).tobytes()))
        kinds = (pa.int64(), pa.int64()) + (pa.binary(),) * 7
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, kinds)], names)

    names = ["bucket", "base", "key", "low", "many", "rid", "start", "sure_rid", "sure_start"]

    def decide(table: pa.Table) -> pa.Table:
        def column(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

        key, low, many = column("key", U64), column("low", np.uint32), column("many", bool)
        sizes = lambda name, w: np.fromiter((len(x) // w for x in table.column(name).to_pylist()), np.int64, len(table))
        base = table.column("base").to_numpy()
        rid = column("rid", np.uint32) + np.repeat(base, sizes("rid", 4))
        start = column("start", np.uint32)
        by = np.lexsort((low, key))
        new = np.ones(len(key), bool)
        new[1:] = (key[by][1:] != key[by][:-1]) | (low[by][1:] != low[by][:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(key)))
        alone = np.repeat(count < 2, count)
        yes = by[~alone]
        yes = yes[~many[yes]]  # those were decided in their batch
        rid = np.concatenate((rid[yes], column("sure_rid", np.uint32) + np.repeat(base, sizes("sure_rid", 4))))
        start = np.concatenate((start[yes], column("sure_start", np.uint32)))
        by = np.lexsort((start, rid))
        rid, start = rid[by], start[by]
        group = rid >> shift
        cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)) if len(group) else [0]
        rows = [(int(group[a]), rid[a:b].tobytes(), start[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("group", "rids", "starts"), columns, (pa.int64(), pa.binary(), pa.binary()))})

    schema = "bucket long, base long, key binary, low binary, many binary, rid binary, start binary, sure_rid binary, sure_start binary"
    sent = texts.groupBy("group").cogroup(found.groupBy("group")).applyInArrow(candidates, schema)
    return sent.groupBy("bucket").applyInArrow(decide, "group long, rids binary, starts binary")


def _cover(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n words windows from these starts cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every document, joined by spaces."""
    rows_per_batch(docs.sparkSession, GROUP_ROWS)
    docs, shift = numbered(docs)
    texts = grouped_texts(docs)
    marks = repeated_windows(docs, texts, width, shift)

    def clean(texts: pa.Table, marks: pa.Table) -> pa.Table:
        docs = texts_of(texts)
        rid = np.frombuffer(b"".join(marks.column("rids").to_pylist()), np.int64)
        start = np.frombuffer(b"".join(marks.column("starts").to_pylist()), np.uint32).astype(np.int64)
        by = np.argsort(rid, kind="stable")
        rid, start = rid[by], start[by]
        out = []
        for doc_id, own, text in zip(docs.column("doc_id").to_pylist(), docs.column("rid").to_pylist(), text_bytes(docs.column("text"))):
            words = text.split()
            a, b = np.searchsorted(rid, [own, own + 1])
            kept = words
            if a < b:
                kept = [w for w, gone in zip(words, _cover(len(words), start[a:b], width).tolist()) if not gone]
            out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "n_words", "n_removed", "kept"), list(zip(*out)) or [()] * 4, kinds)})

    return texts.groupBy("group").cogroup(marks.groupBy("group")).applyInArrow(
        clean, "doc_id long, n_words long, n_removed long, kept string"
    )


def op9_substring(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
