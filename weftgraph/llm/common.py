"""What the operators of this package share: shared-folder tables, Arrow passes, exact hashing of words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words of a text: runs of anything but ASCII white space.  bytes.split() cuts at the same characters.
WORD = r"[^ \t-\r]+"
U64 = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  Where that is unset, a local session gets one of its
    own; on a cluster it is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_written: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this driver, once the results that read them are written."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut in the lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weft/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_per_batch(spark: SparkSession, n: int) -> None:
    """Arrow batches of at most n rows, so that a worker holds few whole texts at a time."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= n:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the texts' offsets in it, the end included; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    cuts = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]], cuts - cuts[0]


SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\x0b\x0c\r")] = True


def word_spans(data: np.ndarray, cuts: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, which never cross texts, and the number of words of each text.

    apart: characters of scripts written without spaces (three bytes, the first from E3 to ED) stand alone.
    """
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(cuts) - 1, np.int64)
    blank = SPACE[data]
    begin = ~blank
    begin[1:] &= blank[:-1]
    heads = cuts[:-1][np.diff(cuts) > 0]
    begin[heads] = ~blank[heads]
    if apart:
        lead = (data >= 0xE3) & (data <= 0xED)
        begin |= lead
        begin[3:] |= lead[:-3] & ~blank[3:]
    stop = np.empty(len(data), bool)
    stop[:-1] = ~blank[:-1] & (blank[1:] | begin[1:])
    stop[-1] = not blank[-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.diff(np.searchsorted(starts, cuts))


_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hashes' base, and of its inverse, modulo 2^64; tables of one block's length are kept."""
    if n not in _powers:
        made = tuple(np.concatenate((np.ones(1, U64), np.cumprod(np.full(n - 1, x, U64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        if n > 1 << 20:
            return made
        _powers[n] = made
    return _powers[n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes: polynomials (mod 2^64, scrambled) from running sums, block by block.  Spans
    are in order and do not overlap."""
    out, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        first = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, first + (1 << 20), "right")))
        size = int(ends[upto - 1]) - first
        power, inverse = _power_table(max(1 << 20, size))
        total = np.zeros(size + 1, U64)
        np.cumsum((data[first : first + size].astype(U64) + U64(1)) * power[:size], out=total[1:])
        a, b = starts[at:upto] - first, ends[at:upto] - first
        out[at:upto] = (total[b] - total[a]) * inverse[a]
        at = upto
    return mix64(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHashes(dict):
    """64-bit hash of each word, computed once per word and task; emptied when it grows beyond its bound."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def windows_hash(words: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Polynomial hashes (mod 2^64, scrambled) of all n-item windows, by doubling: O(log n) passes over the array.

    Window hashes of concatenated documents also cover windows that cross a border; callers drop those.
    """
    if len(words) < n:
        return np.empty(0, U64)
    size, part, done, out = 1, words, 0, None
    power = factor  # factor ** size
    while True:
        if n & size:
            if out is None:
                out, done = part, size
            else:  # the bits seen so far lie to the right of this part
                m = len(words) - done - size + 1
                out = part[:m] * U64(pow(factor, done, 1 << 64)) + out[size : size + m]
                done += size
        if done == n:
            return mix64(out[: len(words) - n + 1])
        m = len(words) - 2 * size + 1
        part = part[:m] * U64(power) + part[size : size + m]
        size, power = 2 * size, power * power % (1 << 64)


def sequence_starts(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs with these lengths, the end included."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of [start, start + length) for each pair, concatenated."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
