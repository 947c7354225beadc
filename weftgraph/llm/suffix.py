"""Suffix-array dedup of repeated byte strings, by Lyndon grouping.

Which texts share a 100-byte string is found in two steps.

1. Anchors.  The smallest hash of the 24-byte strings inside a window is the window's anchor: equal windows have equal
   anchors.  Neighbouring windows with one anchor form a stretch, of about 140 bytes.  A count-min sketch of anchors, in
   slices (sketch.py), drops stretches whose anchor occurs once in the corpus; none that could hold a repeated window is
   lost.  The others are dealt out by anchor, so equal windows meet in one bucket; equal stretches of a group of
   neighbouring documents are sent once.  Stretches of an anchor that HEAVY or more have, such as a common line's, are
   cut into CUTS pieces by how far the anchor lies behind a window's start, and dealt out by what all windows of a piece
   share (91 bytes of 100): equal windows still meet, and only strings as long as that can fill a bucket.
2. Suffix array.  A bucket's distinct stretches form one text, but for those whose anchor no other one has (such as a
   passage of which there are only whole copies): unless they hold it twice, none of their windows is repeated.  Its suffixes are grouped by their Lyndon prefixes,
   using next-smaller pointers (the mirror image of previous-smaller ones); the groups' order is the order of the
   prefixes.  Then one scan from the smallest suffix on emits each group in order: a suffix follows its group's
   start by the rank of the suffix behind its Lyndon prefix, which is always emitted earlier.  Nothing is renamed.
   Neighbours in the array that agree in 100 bytes are repeats; all but the earliest lose the bytes they cover.

Cases: null text is empty; texts under 100 bytes lose nothing; rows with one doc_id are documents of their own, in the
order of the scan; a null id comes before all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import U64, expand, rows_per_batch, sequence_starts, text_bytes, windows_hash
from .sketch import GROUP_ROWS, grouped_texts, may_repeat, numbered, repeated, slices_for, texts_of
from .substring import FACTORS

LENGTH, ANCHOR = 100, 24
#: Windows of one stretch at most; bytes of input for each bucket; bytes that are hashed together.
STRETCH, BUCKET, TOGETHER = 512, 2_000_000, 1 << 20
#: Stretches that make an anchor heavy (about a quarter of a bucket); pieces that its stretches are cut into.
HEAVY, CUTS = 4_096, 8


def stretches(texts: list[bytes], length: int = LENGTH) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_stretches() of the texts, some at a time: the arrays over bytes stay small."""
    parts, first, start, upto = [], 0, 0, 0
    for i, text in enumerate([*texts, None]):
        upto += len(text or b"")
        if text is None or upto - start >= TOGETHER:
            last = i if text is None else i + 1
            raw, doc, at, size, anchor, again = _stretches(texts[first:last], length)
            parts.append((doc + first, at + start, size, anchor, again))
            first, start = last, upto
    return b"".join(texts), *map(np.concatenate, zip(*parts))


def _stretches(texts: list[bytes], length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts and, of each stretch: its text's number, offset in the joined texts, bytes, anchor, and whether
    its windows hold the anchor at more than one place, so that they may repeat each other."""
    raw = b"".join(texts)
    cuts = sequence_starts(np.fromiter(map(len, texts), np.int64, len(texts)))
    none = np.empty(0, np.int64)
    hashes = least = windows_hash(np.frombuffer(raw, np.uint8).astype(U64) + U64(1), ANCHOR, FACTORS[0])
    size, wide = 1, length - ANCHOR + 1
    if len(raw) < length:
        return raw, none, none, none, np.empty(0, U64), np.empty(0, bool)
    while 2 * size <= wide:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if rest := wide - size:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    doc = np.repeat(np.arange(len(texts)), np.diff(cuts))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + length <= cuts[1:][doc])
    least, doc = least[at], doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(at)))
    run = np.arange(len(at)) - np.repeat(first, sizes)
    # a window that starts at its anchor is its stretch's last, unless the anchor comes again
    again = hashes[at] == least
    again[np.append(first[1:], len(at))[: len(first)] - 1] = False
    again = np.repeat(np.logical_or.reduceat(again, first) if len(first) else again, sizes)
    first = np.flatnonzero(run % STRETCH == 0)
    sizes = np.diff(np.append(first, len(at))) + length - 1
    return raw, doc[first], at[first], sizes, least[first], again[first]


def _anchors(texts: list[bytes], length: int) -> np.ndarray:
    """What the sketch counts: each stretch's anchor, twice if its windows may repeat each other."""
    *_, anchor, again = stretches(texts, length)
    return np.concatenate((anchor, anchor[again]))


def cut_heavy(pieces: list[bytes], anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of stretches with heavy anchors: the stretch's number, offset in it, bytes, and key to deal by.

    A window's reach, from its start to its leftmost anchor, falls into one of CUTS ranges; neighbouring windows with one
    range and anchor are a piece, or more of them with one key.  The key covers the bytes that all windows of such a range
    hold, so it depends on nothing but a window's bytes.
    """
    parts, begin, held = [], 0, 0
    for i, piece in enumerate(pieces):
        held += len(piece)
        if held >= TOGETHER or i + 1 == len(pieces):
            own, *rest = _cut_heavy(pieces[begin : i + 1], anchor[begin : i + 1], length)
            parts.append((own + begin, *rest))
            begin, held = i + 1, 0
    return tuple(map(np.concatenate, zip(*parts)))


def _cut_heavy(pieces: list[bytes], anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, cuts = b"".join(pieces), sequence_starts(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    sizes = np.diff(cuts)
    hashes = windows_hash(np.frombuffer(raw, np.uint8).astype(U64) + U64(1), ANCHOR, FACTORS[0])
    places = np.flatnonzero(hashes == np.repeat(anchor, sizes)[: len(hashes)])
    own, at = np.repeat(np.arange(len(pieces)), sizes - length + 1), expand(cuts[:-1], sizes - length + 1)
    place = places[np.searchsorted(places, at)]
    wide = length - ANCHOR + 1
    part = (place - at) * CUTS // wide
    first = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    place, part = place[first], part[first]
    low, high = -(-part * wide // CUTS), -(-(part + 1) * wide // CUTS) - 1  # the range's least and greatest reach
    key = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((place - low).tolist(), (place - high + length).tolist())], U64)
    new = np.ones(len(first), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[first[1:]] != own[first[:-1]])
    first, key = first[new], key[new]
    size = np.diff(np.append(first, len(at))) + length - 1
    return own[first], at[first] - cuts[own[first]], size, key


def lyndon_groups(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text: bytes above 0, with a 0 behind each string.  The positions that hold no 0; each one's next smaller suffix;
    each one's group, as the number of positions in smaller groups.

    key: the eight bytes from each position on, as one big-endian number; text is padded for it.
    """
    places = np.flatnonzero(text)
    n = len(text)

    def smaller(c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Whether suffix c is smaller than suffix i, c being behind i in one string: it meets its 0 first."""
        a, b = key[c], key[i]
        out, tie = a < b, np.flatnonzero(a == b)
        step = 8
        while len(tie):
            a, b = key[c[tie] + step], key[i[tie] + step]
            out[tie] = a < b
            tie = tie[a == b]
            step += 8
        return out

    following = np.full(n, -1, np.int64)
    i, c = places, places + 1
    less = smaller(c, i)
    following[i[less]] = c[less]
    i, c = i[~less], c[~less]
    while len(i):  # the next candidate is the next smaller suffix of the one that was not smaller
        jump = following[c]
        ready = np.flatnonzero(jump >= 0)
        less = smaller(jump[ready], i[ready])
        c[ready] = jump[ready]
        done = ready[less]
        following[i[done]] = c[done]
        rest = np.ones(len(i), bool)
        rest[done] = False
        i, c = i[rest], c[rest]

    length = following[places] - places
    mask = (~U64(0)) << (U64(8) * U64(8 - np.minimum(length, 8)).astype(U64))
    mask[length >= 8] = ~U64(0)
    part = key[places] & mask
    order = np.argsort(part)
    part = part[order]
    new = np.ones(len(order), bool)
    new[1:] = part[1:] != part[:-1]
    depth, at = 8, np.arange(len(order))
    while True:  # prefixes that agree so far, of which one goes on, are told apart by their next eight bytes
        number = np.cumsum(new[at]) - 1
        again = (np.bincount(number, length[order[at]] > depth) > 0) & (np.bincount(number) > 1)
        at = at[again[number]] if len(at) else at
        if not len(at):
            break
        own, number = order[at], np.cumsum(new[at])
        left = np.clip(length[own] - depth, 0, 8)
        mask = np.where(left >= 8, ~U64(0), ~((~U64(0)) >> (U64(8) * (left % 8).astype(U64))))
        mask[left == 0] = 0
        part = key[np.minimum(places[own] + depth, n)] & mask
        by = np.lexsort((part, number))
        order[at], part = own[by], part[by]
        new[at[1:]] |= part[1:] != part[:-1]
        depth += 8
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(order)))
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(first, sizes)
    return places, following[places], group


def suffix_array(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and keys as in lyndon_groups(), and the positions of its suffixes in order."""
    raw = np.frombuffer(b"\0".join(x.translate(_UP) for x in strings) + bytes(24), np.uint8)
    n = len(raw) - 23
    text, key = raw[:n], np.ndarray((n + 16,), ">u8", raw, 0, (1,)).astype(U64)
    places, following, group = lyndon_groups(text, key)
    # whoever ends its Lyndon prefix at an emitted suffix takes the next slot of its group, in the order of those
    # suffixes; all suffixes of the array's finished front serve at once
    m = len(places)
    by = np.argsort(following, kind="stable")
    heads = np.searchsorted(following[by], np.arange(n + 1))
    low, high = heads[places], heads[places + 1]
    slot, out = np.arange(m), np.full(m, -1)

    def emit(found: np.ndarray) -> None:
        if len(found) == 1:
            g = group[found[0]]
            out[slot[g]] = found[0]
            slot[g] += 1
            return
        found = found[np.argsort(group[found], kind="stable")]
        g = group[found]
        new = np.empty(len(g) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(g[1:], g[:-1], out=new[1:-1])
        cuts = np.flatnonzero(new)
        first, sizes = cuts[:-1], cuts[1:] - cuts[:-1]
        out[slot[g] + np.arange(len(g)) - np.repeat(first, sizes)] = found
        slot[g[first]] += sizes

    if m:
        emit(by[text[following[by]] == 0])  # behind these lies a 0, which is smaller than all else
    front = 0
    while front < m:
        step, end = 64, front
        while end < m:
            gap = np.flatnonzero(out[end : end + step] < 0)
            if len(gap):
                end += int(gap[0])
                break
            end, step = min(m, end + step), 2 * step
        new = out[front:end]
        found = by[expand(low[new], high[new] - low[new])]
        if len(found):
            emit(found)
        front = end
    return text, key, places[out]


#: UTF-8 has no byte 255, so that all bytes can go up by one to leave 0 for the ends.
_UP = bytes([*range(1, 256), 255])


def repeated_in(strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that occur at least twice in the strings: string number, offset, and a number for each distinct window."""
    text, key, order = suffix_array(strings)
    starts = sequence_starts(np.fromiter(map(len, strings), np.int64, len(strings)) + 1)
    string = np.repeat(np.arange(len(strings)), np.diff(starts))[: len(text)]
    own = string[order]
    whole = order + length < starts[own + 1]
    order, own = order[whole], own[whole]
    same = np.arange(len(order) - 1)
    for step in [*range(0, length - 7, 8), length - 8]:
        same = same[key[order[same] + step] == key[order[same + 1] + step]]
    link = np.zeros(len(order) + 1, bool)
    link[same + 1] = True  # equal to the one before
    some = np.flatnonzero(link[:-1] | link[1:])
    return own[some], order[some] - starts[own[some]], np.cumsum(~link[:-1])[some]


def tags(anchor: np.ndarray, again: np.ndarray) -> np.ndarray:
    """31 bits of each stretch's anchor, or of the key of a piece, above whether its windows may repeat each other."""
    return (anchor >> U64(33) << U64(1)).astype(np.uint32) | again


def may_share(tag: np.ndarray) -> np.ndarray:
    """Which of some distinct stretches may hold a window twice, or one that another of them holds."""
    _, inverse, n = np.unique(tag >> 1, return_inverse=True, return_counts=True)
    return (n[inverse] > 1) | (tag & 1 == 1)


def dealt(docs: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """bucket and packed columns: the distinct stretches of each group whose windows may repeat, dealt out to buckets.

    docs: numbered(); texts: grouped_texts(docs).
    """
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    slices, buckets = slices_for(total // 40), max(16, total // BUCKET)
    found = repeated(docs, lambda batch: _anchors(text_bytes(batch.column("text")), length), slices, HEAVY)
    kinds = {"bucket": "long", **dict.fromkeys(("digest", "size", "tag", "bytes", "id", "rid", "start", "sure_rid", "sure_start", "sure_size"), "binary")}

    def candidates(joined: pa.Table, found: pa.Table) -> pa.Table:
        batch, rows = texts_of(joined), []
        texts = text_bytes(batch.column("text"))
        raw, doc, at, size, anchor, again = stretches(texts, length)
        keep = np.flatnonzero(may_repeat(anchor, slices, found))
        if len(keep):
            doc, at, size, anchor, again = doc[keep], at[keep], size[keep], anchor[keep], again[keep]
            heavy = may_repeat(anchor, slices, found, "heavy")
            if heavy.any():
                h, light = np.flatnonzero(heavy), ~heavy
                own, offset, n, key = cut_heavy([raw[a : a + s] for a, s in zip(at[h].tolist(), size[h].tolist())], anchor[h], length)
                doc, at = np.append(doc[light], doc[h][own]), np.append(at[light], at[h][own] + offset)
                size, anchor, again = np.append(size[light], n), np.append(anchor[light], key), np.append(again[light], again[h][own])
            ids = batch.column("doc_id").fill_null(-(2**63)).to_numpy()[doc]
            rid = batch.column("rid").to_numpy()[doc]
            start = at - sequence_starts(np.fromiter(map(len, texts), np.int64, len(texts)))[doc]
            pieces = [raw[a : a + s] for a, s in zip(at.tolist(), size.tolist())]
            digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), U64).reshape(-1, 2)
            order = np.lexsort((start, rid, ids, digest[:, 1], digest[:, 0]))
            d = digest[order]
            new = np.ones(len(order), bool)
            new[1:] = (d[1:] != d[:-1]).any(1)
            first, sure = order[new], order[~new]  # later equal stretches of a group are decided
            bucket = (anchor[first] % U64(buckets)).astype(np.int64)
            tag = tags(anchor, again)
            by = np.argsort(bucket, kind="stable")
            first, bucket = first[by], bucket[by]
            some, cuts = np.unique(bucket, return_index=True)
            for k, (b, f) in enumerate(zip(some.tolist(), np.split(first, cuts[1:]))):
                s = sure[k :: len(some)]  # decided ones only pass through: dealt evenly
                rows.append((b, digest[f].tobytes(), size[f].astype(np.uint32).tobytes(), tag[f].tobytes(), b"".join([pieces[i] for i in f.tolist()]),
                             ids[f].tobytes(), rid[f].tobytes(), start[f].tobytes(), rid[s].tobytes(), start[s].tobytes(), size[s].astype(np.uint32).tobytes()))
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.table([pa.array(c, pa.int64() if k == "long" else pa.binary()) for c, k in zip(columns, kinds.values())], list(kinds))

    return texts.groupBy("group").cogroup(found.groupBy("group")).applyInArrow(candidates, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def repeated_bytes(docs: DataFrame, texts: DataFrame, length: int, shift: int) -> DataFrame:
    """group, rids, starts, sizes: byte ranges of documents (by rid) that strings starting earlier cover; packed.

    docs: numbered(); texts: grouped_texts(docs).
    """

    def decide(table: pa.Table) -> pa.Table:
        def column(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

        digest, size = column("digest", U64).reshape(-1, 2), column("size", np.uint32).astype(np.int64)
        ids, rid, start = (column(c, np.int64) for c in ("id", "rid", "start"))
        offset, data = sequence_starts(size), b"".join(table.column("bytes").to_pylist())
        order = np.lexsort((start, rid, ids, digest[:, 1], digest[:, 0]))
        d = digest[order]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]).any(1)
        first, later = order[new], order[~new]
        marks = [(rid[later], start[later], size[later]), tuple(column(f"sure_{c}", k).astype(np.int64) for c, k in (("rid", np.int64), ("start", np.int64), ("size", np.uint32)))]
        first = first[may_share(column("tag", np.uint32)[first])]
        if len(first):
            own, at, window = repeated_in([data[offset[i] : offset[i] + size[i]] for i in first.tolist()], length)
            own = first[own]
            at = start[own] + at
            order = np.lexsort((at, rid[own], ids[own], window))
            own, at, window = own[order], at[order], window[order]
            again = np.flatnonzero(np.diff(window, prepend=-1) == 0)  # all but the earliest
            r, a = rid[own[again]], at[again]
            by = np.lexsort((a, r))
            r, a = r[by], a[by]
            head = np.ones(len(r), bool)
            head[1:] = (r[1:] != r[:-1]) | (a[1:] > a[:-1] + length)
            h = np.flatnonzero(head)
            last = np.append(h[1:], len(r)) - 1 if len(h) else h
            marks.append((r[h], a[h], a[last] + length - a[h]))
        r, a, s = (np.concatenate([m[k] for m in marks]) for k in range(3))
        by = np.argsort(r, kind="stable")
        r, a, s = r[by], a[by], s[by]
        group = r >> shift
        cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)) if len(group) else [0]
        rows = [(int(group[x]), r[x:y].tobytes(), a[x:y].tobytes(), s[x:y].tobytes()) for x, y in zip(cuts, cuts[1:])]
        columns = list(zip(*rows)) or [()] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("group", "rids", "starts", "sizes"), columns, (pa.int64(),) + (pa.binary(),) * 3)})

    return dealt(docs, texts, length).groupBy("bucket").applyInArrow(decide, "group long, rids binary, starts binary, sizes binary")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes of every document."""
    rows_per_batch(docs.sparkSession, GROUP_ROWS)
    docs, shift = numbered(docs)
    texts = grouped_texts(docs)
    marks = repeated_bytes(docs, texts, length, shift)

    def clean(texts: pa.Table, marks: pa.Table) -> pa.Table:
        docs = texts_of(texts)
        rid, start, size = (np.frombuffer(b"".join(marks.column(c).to_pylist()), np.int64) for c in ("rids", "starts", "sizes"))
        by = np.argsort(rid, kind="stable")
        rid, start, size = rid[by], start[by], size[by]
        out = []
        for doc_id, own, text in zip(docs.column("doc_id").to_pylist(), docs.column("rid").to_pylist(), text_bytes(docs.column("text"))):
            a, b = np.searchsorted(rid, [own, own + 1])
            removed = spans = 0
            kept = text
            if a < b:
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, start[a:b], 1)
                np.add.at(edge, start[a:b] + size[a:b], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((doc_id, len(text), removed, spans, kept))
        names, kinds = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept"), (pa.int64(),) * 4 + (pa.binary(),)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, list(zip(*out)) or [()] * 5, kinds)})

    return texts.groupBy("group").cogroup(marks.groupBy("group")).applyInArrow(
        clean, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def op1_suffix_array(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
