"""Helpers shared by the operators: words by the byte, slices of bounded size, the shared folder.

Words are found and hashed with numpy over the UTF-8 bytes of an Arrow column, so no
Python object is made per word.  Two word rules are used by the operators: runs of
letters, digits and bytes over 0x7F (``ALNUM``), and runs of anything but white space
(``SPACED``); A-Z is lower-cased in both.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 4 << 20
#: Separators of the two word rules, as Java and Python patterns.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_SPACED = r"[\x20\x09-\x0D]+"

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _table(separator) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[[b for b in range(256) if separator(int(t[b]))]] = 0
    return t


#: byte -> lower-cased byte, 0 for separators (a NUL inside a SPACED word becomes 1)
ALNUM = _table(lambda b: not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128))
SPACED = _table(lambda b: b == 32 or 9 <= b <= 13)
SPACED[0] = 1


def words(text: Column, separators: str = NOT_ALNUM) -> Column:
    """The words of a text as an array, without Python; A-Z is lower-cased. Null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), separators), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does that alone where every character is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for base in (_FACTOR, _INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            both.append(np.multiply.accumulate(t))
        _powers[:] = both
    return _powers[0], _powers[1]


def release_memory() -> None:
    """Give the memory of finished numpy and Arrow work back to the system; the driver lives on after training."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(lower-cased bytes, start of each word, its end, offsets of the rows into the words)."""
    lower = table[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = lower != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:]
    end = np.zeros(len(data) + 1, bool)
    end[1:] = inside[:-1] & (~inside[1:] | edge[1:])
    first = np.flatnonzero(start)
    return lower, first, np.flatnonzero(end), np.searchsorted(first, offsets)


def hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes."""
    power, inverse = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``most`` bytes at the most (one row at least)."""
    if not batch.num_rows:
        return
    _, offsets = column_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where no folder is named, a local master gets one of its own; a cluster is refused.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it again: columnar and compressed."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
