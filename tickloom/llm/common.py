"""Shared helpers: the cluster's shared folder, and vectorised hashing of text held in Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
CHUNK = 1 << 20  # bytes of text handled at once by the vectorised helpers


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    A local session that has none (tests) gets a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tickloom-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job in a folder of its own in the shared folder; what a later table replaces is dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, shared_path(spark, name), {}

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again: lineage ends there and lost executors lose nothing."""
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this job that nothing will read again."""
        sc = self.spark.sparkContext
        for df in tables:
            path = sc._jvm.org.apache.hadoop.fs.Path(self.paths[id(df)][0])
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions inside the block; it is put back after."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def parts(spark: SparkSession, least: int = 1) -> int:
    """The number of shuffle partitions the session is sized for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = U64(0x9E3779B97F4A7C15)
BYTE_CODES = mix((np.arange(256, dtype=U64) + U64(1)) * BASE)
_powers = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK + 1)
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(n, BASE, U64), np.full(n, inverse, U64)
        up[0] = down[0] = U64(1)
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, not copied unless it has nulls; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes; a longer row comes alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = end


def word_class(extra: bytes = b"") -> np.ndarray:
    """Which bytes belong to words: ASCII letters and digits, all bytes of non-ASCII characters, and ``extra``."""
    table = np.zeros(256, bool)
    for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[low:high] = True
    table[list(extra)] = True
    return table


WORD_BYTES = word_class()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several rows, and where each row's words start among them.

    ``offsets`` are the rows' byte offsets in ``data``. A word longer than CHUNK bytes counts as
    several words.
    """
    hashes, starts = [], [0]
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        if high - low > CHUNK:  # rare long rows go in slices, so that memory stays bounded
            count = 0
            while low < high:
                cut = min(low + CHUNK, high)
                if cut < high and (gaps := np.flatnonzero(~WORD_BYTES[data[low:cut]])).size:
                    cut = low + int(gaps[-1]) + 1
                hashes.append(_word_hashes(data[low:cut], np.array([0, cut - low]))[0])
                count += len(hashes[-1])
                low = cut
            starts.append(starts[-1] + count)
        else:
            break
    done = len(starts) - 1
    if done < len(offsets) - 1:
        if done or offsets[-1] - offsets[done] > 2 * CHUNK:
            for low, high in row_chunks(offsets[done:]):
                some, where = (word_hashes if high - low == 1 else _word_hashes)(data[offsets[done + low] : offsets[done + high]], offsets[done + low : done + high + 1] - offsets[done + low])
                hashes.append(some)
                starts += [starts[-1] + int(x) for x in where[1:]]
        else:
            some, where = _word_hashes(data, offsets)
            return some, where
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), np.array(starts)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    word = np.zeros(n + 1, bool)
    word[:n] = WORD_BYTES[data]
    before, after = np.zeros(n, bool), word[1:].copy()
    before[1:] = word[: n - 1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(word[:n] & ~before)
    ends = np.flatnonzero(word[:n] & ~after) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_CODES[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` words of each row, and where each row's windows start.

    A row with fewer words has one window, of all its words; a row without words has none.
    """
    counts = np.diff(starts)
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    out = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(starts[:-1] - out[:-1], n) + np.arange(out[-1])
    last = np.repeat(starts[1:], n)
    value = np.zeros(out[-1], U64)
    padded = np.concatenate([words, np.zeros(size, U64)])
    for i in range(size):
        there = at + i
        value = value * BASE + np.where(there < last, padded[there], U64(0))
    return mix(value), out
