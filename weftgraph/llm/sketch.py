"""A count-min sketch in slices, of which no task ever holds more than one.

Chunks of documents send the hashes that they count to slices, each hash once with its count there.  A slice merges these
partial sketches into DEPTH rows of 2 ** CELL_BITS cells and sends back to each chunk those of its hashes whose cells all
count two or more, and apart from them those that count `heavy` or more: every chunk gets one answer for one hash.  Cells only ever overestimate, so a hash that does not come back is unique in the
corpus.  The number of slices follows the number of hashes, so that a row has about eight cells a hash at every size, and
nothing is broadcast or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import U64

CELL_BITS, DEPTH, SLICE = 22, 2, 1 << 19
#: Bytes of text that one group of neighbouring rows may hold if all were as long as the longest; rows in a group.
GROUP_BYTES, GROUP_ROWS = 256 << 20, 1 << 10
SENT = "slice long, group long, hashes binary, times binary"


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(1).compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns))


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    data, sizes, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), [np.dtype(k).itemsize for k in kinds], [], 0
    n = len(data) // sum(sizes)
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with rid, the row's place in the scan, and group, of neighbouring rows: the same in every pass over the same
    files.  group is rid without its last bits, whose number comes back too: a group has GROUP_ROWS rows, fewer where
    texts are so long that it could pass GROUP_BYTES."""
    longest = max(1, docs.select(F.max(F.octet_length("text"))).first()[0] or 1)
    bits = max(0, min(GROUP_ROWS.bit_length() - 1, (GROUP_BYTES // longest).bit_length() - 1))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("rid"))
    return rows.withColumn("group", F.shiftright("rid", bits)), bits


def grouped_texts(docs: DataFrame) -> DataFrame:
    """group, docs: the rows of numbered() that lie in one group and batch, as one compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("group").to_numpy()
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            rows = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)]):
                sink = pa.BufferOutputStream()
                part = batch.select(["doc_id", "rid", "text"]).slice(a, b - a)
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                rows.append((int(group[a]), sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["group", "docs"])

    return docs.mapInArrow(run, "group long, docs binary")


def texts_of(table: pa.Table) -> pa.RecordBatch:
    """doc_id, rid and text of a group, in the order of the scan."""
    parts = [pa.ipc.open_stream(x).read_all() for x in table.column("docs").to_pylist()]
    return pa.concat_tables(parts).sort_by("rid").combine_chunks().to_batches()[0] if parts else pa.RecordBatch.from_arrays(
        [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], ["doc_id", "rid", "text"]
    )


def slices_for(hashes: int) -> int:
    return max(16, -(-hashes // SLICE))


def _keys(h: np.ndarray, slices: int) -> np.ndarray:
    """A hash's slice above its cells, one for each row of the sketch."""
    return h % U64(slices) << U64(DEPTH * CELL_BITS) | h >> U64(64 - DEPTH * CELL_BITS)


def repeated(docs: DataFrame, hashed, slices: int, heavy: int = 1 << 62) -> DataFrame:
    """group, hashes, heavy: which of the hashes that hashed(batch) counts in a group of numbered() may be repeated, and
    which of them may count `heavy` or more."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("group").to_numpy()
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)]):
                keys, n = np.unique(_keys(hashed(batch.slice(a, b - a)), slices), return_counts=True)
                if not len(keys):
                    continue
                which = (keys >> U64(DEPTH * CELL_BITS)).astype(np.int64)
                at = np.flatnonzero(np.diff(which, prepend=-1))
                rows = []
                for x, y in zip(at.tolist(), [*at[1:].tolist(), len(keys)]):
                    rows.append((int(which[x]), int(group[a]), packed(np.diff(keys[x:y], prepend=U64(0))), packed(np.minimum(n[x:y], 65_535).astype(np.uint16))))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["slice", "group", "hashes", "times"])

    def merge(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x, U64)[0]) for x in table.column("hashes").to_pylist()]
        times = np.concatenate([unpacked(x, np.uint16)[0] for x in table.column("times").to_pylist()])
        every, least = np.concatenate(keys), np.inf
        for row in range(DEPTH):
            cell = (every >> U64(row * CELL_BITS) & U64((1 << CELL_BITS) - 1)).astype(np.int64)
            least = np.minimum(least, np.bincount(cell, times, 1 << CELL_BITS)[cell])
        out, at = [], 0
        for group, k in zip(table.column("group").to_pylist(), keys):
            n = least[at : at + len(k)]
            at += len(k)
            if (n >= 2).any():
                out.append((group, *(packed(np.diff(k[n >= x], prepend=U64(0))) for x in (2, heavy))))
        columns = list(zip(*out)) or [()] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("group", "hashes", "heavy"), columns, (pa.int64(), pa.binary(), pa.binary()))})

    columns = docs.select("doc_id", "rid", "group", "text")
    return columns.mapInArrow(send, SENT).groupBy("slice").applyInArrow(merge, "group long, hashes binary, heavy binary")


def may_repeat(h: np.ndarray, slices: int, found: pa.Table, column: str = "hashes") -> np.ndarray:
    """Which hashes of a group came back from repeated(), in one of its columns."""
    keys = np.sort(np.concatenate([*(np.cumsum(unpacked(x, U64)[0]) for x in found.column(column).to_pylist()), np.empty(0, U64)]))
    if not len(keys):
        return np.zeros(len(h), bool)
    own = _keys(h, slices)
    return keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own
