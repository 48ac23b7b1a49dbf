"""Helpers shared by the corpus operators: table access, cut points, Arrow text views."""

from __future__ import annotations

import ctypes
import functools
import inspect
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir

#: Bytes of text that one block holds; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it has fewer partitions than there are: small tables of one file only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't swell a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing will read again: what came of them must have been written."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except AttributeError:  # another C library
        return lambda _: 0


def release() -> None:
    """Give freed memory back, for workers stay when their task has ended."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(f):
    """A worker's function of one or two arguments that gives freed memory back when it ends."""

    def of(*args):
        try:
            return f(*args)
        finally:
            release()

    if inspect.isgeneratorfunction(f):

        def run(batches):
            try:
                yield from f(batches)
            finally:
                release()

    elif len(inspect.signature(f).parameters) == 2:

        def run(a, b):
            return of(a, b)

    else:

        def run(a):
            return of(a)

    return functools.wraps(f)(run)


def text_view(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one buffer, and len + 1 offsets into it; null reads as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binaries data[offsets[i]:offsets[i+1]], without a copy of the bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def byte_list(arr: pa.Array) -> list[bytes]:
    """The binaries of an array as a list, by slices of its buffer."""
    data, off = text_view(arr)
    raw, off = data.tobytes(), off.tolist()
    return [raw[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]


def text_blocks(batches, column: str, limit: int = BLOCK_BYTES):
    """Regroup record batches into tables of about ``limit`` bytes of ``column``."""
    held, size = [], 0
    for b in batches:
        _, off = text_view(b.column(column))
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(off, off[at] + (limit - size), "right")) - 1
            if end <= at:
                if held:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                    continue
                end = at + 1
            end = min(end, b.num_rows)
            held.append(b.slice(at, end - at))
            size += int(off[end] - off[at])
            at = end
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def resource(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
