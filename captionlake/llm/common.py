"""Shared pieces: whole-batch byte arrays, word boundaries, hashes, and work tables in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a Python worker; one longer text is handled alone.
SLICE_BYTES = 1 << 20

_M64 = (1 << 64) - 1
BASE1, BASE2, BASE3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}

# ---------------------------------------------------------------- work tables


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a folder of our own only where it is unset (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="captionlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """The work tables of one call. A table goes when its last reader has run (drop) or when the result is written (release)."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write once to the shared folder and read back: cuts lineage, survives lost executors, and slow Python runs once."""
        path = f"{shared_folder(self.spark)}/captionlake-{name}-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[path] = out
        return out

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            del self.paths[path]
            self._delete(path)

    def release(self) -> None:
        """Only for callers that have already written what they returned."""
        for path in list(self.paths):
            del self.paths[path]
            self._delete(path)


def renamed(df: DataFrame) -> DataFrame:
    """df with its columns called _0, _1 and so on: what is joined to it can't clash with them, whatever they are called."""
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))])


def renamed_column(df: DataFrame, name: str) -> Column:
    """Column `name` of df, as renamed(df) calls it."""
    return F.col(f"_{df.columns.index(name)}")


#: Rows of a few numbers that may be broadcast: about 15 MB. More of them go through a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch between Spark and Python: texts are long, and several batches are in memory at once.
BATCH_BYTES = 4 << 20


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most `most` rows; pass a written table of narrow rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, unless the session sets a size of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in {k for k, _ in spark.sparkContext.getConf().getAll()}:
        spark.conf.set(name, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """With the id it names a row's content: repeated rows share it and get the same result, null ids stay apart by text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


# ------------------------------------------------------------- Arrow batches


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets from 0) of a string column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offs) or offs[-1] == offs[0]:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", most: int = SLICE_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about `most` bytes of text, so that memory follows the longest text, not the batch.

    keep: the caller uses what the worker has held(); else that goes first.
    """
    if not keep:
        _held.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = string_bytes(batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offs, offs[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
    if sum(x.nbytes for x in _powers.values()) > 16 << 20:
        _powers.clear()  # a very long text has passed
    _trim()


_held: list[tuple[object, object]] = []


def held(key, make):
    """make(), kept for all tasks of a Python worker until one asks for another key: a worker holds one large table at a time."""
    if not _held or _held[0][0] != key:
        _held.clear()
        _trim()
        _held.append((key, make()))
    return _held[0][1]


def _trim() -> None:
    """Give back memory that is free."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def runs_of(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with one value in column `key`, across batches."""
    held: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(key).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])).tolist() + [batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and ids[a] != value:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            value = ids[a]
    if held:
        yield held


# --------------------------------------------------------------- word arrays


def powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2**64 for i < n, kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every run of bytes other than 0x20 and 0x09-0x0D; words never cross documents."""
    n = len(data)
    if not n:
        e = np.empty(0, dtype=np.int64)
        return e, e, e
    solid = ~_SPACE[data]
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0] = after[-1] = False
    before[1:], after[:-1] = solid[:-1], solid[1:]
    edges = offs[(offs > 0) & (offs < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(offs, starts, "right") - 1


class Prefix:
    """Polynomial prefix sums mod 2**64 over a row of numbers: the hash of any range in O(1)."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        self.base = base
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values.astype(np.uint64) * powers(base, len(values)), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, dtype=np.uint64)
        x = (self.sums[ends] - self.sums[starts]) * powers(inverse(self.base), len(self.sums))[starts]
        return mix(x + (ends - starts).astype(np.uint64) * np.uint64(BASE3))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Prefix(data.astype(np.uint64) + np.uint64(1), BASE1).hashes(starts, ends)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Memo(dict):
    """Values of compute(key), filled as keys come up. Two generations of at most `most` keys bound the memory and keep what
    is in use; keys over 64 characters are not kept."""

    def __init__(self, most: int = 150_000) -> None:
        self.most, self.old = most, {}

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.compute(key)
            if len(key) > 64:
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out
