"""Shared helpers: zero-copy text access in Arrow batches and bounded slicing of them."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the numpy kernels; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20


#: Rows of an Arrow batch at most: texts are long, and a batch is in memory on both sides of a Python worker.
BATCH_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have BATCH_ROWS rows at most."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    rows = int(conf.get(name, "10000"))
    if not 0 < rows <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column, modulus: int):
    """crc32 of the id's decimal text, modulo: how the contracts split rows into folds."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def flat_utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the n+1 offsets of the texts in it; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most `most` bytes together (one row at least)."""
    _, offsets = flat_utf8(batch.column(batch.schema.get_field_index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
PLACE_VALUES = _RNG.integers(1, 1 << 63, 1 << 16, np.uint64) | np.uint64(1)


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ np.uint64(int(seed) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(flat: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes that are no separators, within one text), the words' first bytes and
    ends, and each text's offsets in the words. separator: by byte. flat: already folded."""
    word = ~separator[flat]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(flat))]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(offsets), np.int64)
    place = np.arange(len(flat), dtype=np.int64)[word] - np.repeat(starts, ends - starts)
    values = BYTE_VALUES[flat[word]] * (PLACE_VALUES[place & 0xFFFF] + (place >> 16).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    lengths = ends - starts
    sums = np.add.reduceat(values, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return mixed(sums + lengths.astype(np.uint64)), starts, ends, np.searchsorted(starts, offsets)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]] along axis 0; an empty segment gives 0."""
    total = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        total[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=total.dtype)
    return total


_HELD: dict = {}


def trim() -> None:
    """Gives memory that is free back to the system; Python workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def held_by_worker(kind: str, key: Hashable, make: Callable):
    """make(), kept by this Python worker until another table is asked for: a worker holds one operator's table at a time."""
    if _HELD.get("of") != (kind, key):
        forget()
        _HELD.update(of=(kind, key), table=make())
    return _HELD["table"]


def forget() -> None:
    """Drops the table that this worker holds."""
    _HELD.clear()
    trim()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all run in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: tables written by one machine could not be read by others")
        named = f"file://{tempfile.gettempdir()}/tallyweir-checkpoints"
        spark.sparkContext.setCheckpointDir(named)
    return named


_WRITTEN: list[tuple[SparkSession, str, str]] = []
_SCOPES: list[list[tuple[SparkSession, str, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are cut inside, and not kept, are deleted at the end."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for written in _SCOPES.pop():
            _WRITTEN.remove(written)
            _delete(*written)


def cut(df: DataFrame, name: str, by: str | None = None, keep: bool = False) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again: ends its lineage, and survives lost executors.

    by: a column that the table is bucketed by, so that joins on it do not shuffle the table again. The table stays until its
    scratch ends, or, outside of one and with `keep`, until the driver's Python ends, as results may still read it.
    """
    spark = df.sparkSession
    unique = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{unique}"
    if not _WRITTEN:
        atexit.register(_clean)
    named = unique.replace("-", "_") if by else ""
    _WRITTEN.append((spark, path, named))
    if _SCOPES and not keep:
        _SCOPES[-1].append(_WRITTEN[-1])
    if by:
        buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark's own limit
        df.write.option("path", path).bucketBy(buckets, by).saveAsTable(named)
        return spark.table(named)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str, named: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped: its tables stay
        return
    if named:
        spark.sql(f"DROP TABLE IF EXISTS {named}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for written in _WRITTEN:
        _delete(*written)
    _WRITTEN.clear()
