"""Helpers shared by the corpus operators: tables, shared storage, hashing of Arrow text."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and all run on one machine."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="oddsloom-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while :func:`stored` writes whole texts or sets of shingles that pass through Python.
BATCH_ROWS = "1000"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, which cuts its lineage.

    ``wide``: rows are long, so tasks hand fewer of them to Python at once.
    """
    spark = df.sparkSession
    path, usual = scratch(spark, name), spark.conf.get(_ROWS)
    if wide:
        spark.conf.set(_ROWS, BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ROWS, usual)
    return spark.read.schema(df.schema).parquet(path)


def body(column: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the n + 1 offsets of its values; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def tidied(batches: Iterator) -> Iterator:
    """The batches of a task; after each, memory that it no longer uses goes back to the system.

    Python workers live on for the tasks of other stages, and would hold on to the most they ever used.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if trim is not None:  # glibc only
            trim(0)


def slices(at: np.ndarray, most: int):
    """Row ranges [a, b) of at most ``most`` bytes each, or one row where a row is longer."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finalizer of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Hashes of the words that this worker met, and the most it remembers.
_WORDS: dict[bytes, int] = {}
_WORDS_HELD = 1 << 19


def coded(data: np.ndarray, size: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte strings among those that adjoin in ``data``, as they first come, and the place of each."""
    if not len(size):
        return [], np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    found = spans.dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)


def coded_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte strings among spans of bytes, as they first come, and the place of each span's."""
    if not len(start):
        return [], np.zeros(0, np.int64)
    if (start[1:] == end[:-1]).all():
        return coded(raw[start[0] : end[-1]], end - start)
    size = end - start
    return coded(raw[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())], size)


def word_hashes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit BLAKE2 hash of each word of those that adjoin in ``data``: no construction of words with one hash is known."""
    words, place = coded(data, size)
    if len(_WORDS) > _WORDS_HELD:
        _WORDS.clear()
    out = np.empty(len(words), np.uint64)
    for i, word in enumerate(words):
        known = _WORDS.get(word)
        if known is None:
            known = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            if len(word) < 64:
                _WORDS[word] = known
        out[i] = known
    return out[place]
