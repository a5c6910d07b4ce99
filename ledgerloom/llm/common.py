"""Helpers shared by the operators: staging, key columns and Arrow text buffers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: a word is a run of bytes other than ASCII white space
SLICE = 1 << 20  # text bytes that a task works on at once
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STAGED: list[str] = []  # folders written by this driver


def drop_staged(spark: SparkSession) -> None:
    """Remove the tables that ``staged`` wrote; results that read them must have been written before."""
    while STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back: later jobs
    reuse the rows, and a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def shrink() -> None:
    """Give memory that is no longer used back to the system: Spark keeps its Python workers for later tasks, and what they
    hold on to counts against their executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash_id(*cols: Column | str, seed: int) -> Column:
    """A seeded 64-bit hash; nulls count as a value of their own."""
    return F.xxhash64(F.lit(seed), *cols)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and UTF-8 bytes of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``most`` text bytes, so that temporary arrays
    stay small; a longer text makes a slice of its own."""
    offsets, _ = utf8(batch.column(batch.schema.get_field_index(text)))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) byte of every word; words end at row borders."""
    inside = ~SPACE[data]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[first] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[first[1:] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift multiply), vectorised."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse, as far as needed so far


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [lo, hi): a polynomial over prefix sums, made independent of
    the place by the inverse power, then mixed with the length."""
    n = len(data)
    power, inverse = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=prefix[1:])
    return mix((prefix[hi] - prefix[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _packed(batches: Iterator[pa.RecordBatch], most: int, dress, part_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    pid, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def packet() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for part in held:
                writer.write_batch(part)
        return pa.RecordBatch.from_arrays([pa.array([(pid << 32) + made], pa.int64()), pa.array([size], pa.int64()),
                                           pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "size", "payload"])

    for batch in batches:
        for part in slices(batch, "text", part_bytes):
            held.append(dress(part) if dress else part)
            size += part.nbytes
            if size >= most:
                yield packet()
                made, held, size = made + 1, [], 0
    if held:
        yield packet()


def packets(df: DataFrame, name: str, most: int = 32 << 20, dress=None, part_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``df`` (it has a column ``text``) in blocks of about ``most`` bytes, each a compressed Arrow
    stream, written once: ``block`` (a stable number), ``size`` (bytes), ``payload``.  Blocks follow the scan, so
    no text is shuffled to make them.  Inside, rows lie in parts of about ``part_bytes``; ``dress`` may add
    columns to each part."""
    return staged(df.mapInArrow(partial(_packed, most=most, dress=dress, part_bytes=part_bytes), "block long, size long, payload binary"), name)


def opened(payload: pa.Scalar | bytes) -> Iterator[pa.RecordBatch]:
    """The parts of a packet, each of a few MB of text or one longer row."""
    yield from pa.ipc.open_stream(payload.as_buffer() if isinstance(payload, pa.Scalar) else payload)
