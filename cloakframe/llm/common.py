"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4_000_000


def give_back() -> None:
    """Returns memory that this worker holds without using it: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` over a partition's batches, with unused memory given back before and after."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about ``limit`` text bytes, one row at least."""
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lens):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(lens) > start:
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


#: 64-bit names that two texts may share before something else must be wrong: at 10^12 texts some 30,000 are expected.
MOST_SHARED = 1_000_000


def text_key(rows: DataFrame, text: str = "text") -> Column:
    """A LONG that names a text (not null): equal for equal texts, different for different ones as far as 128 bits of hash tell.

    Names that two texts share are looked for first, and such texts get another name; only those names come to the driver.
    """
    first, second = F.xxhash64(text), F.xxhash64(F.lit("second"), F.octet_length(text), F.reverse(text))
    named = rows.select(first.alias("a"), second.alias("b")).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    shared = [r.a for r in named.where("low <> high").select("a").limit(MOST_SHARED).collect()]
    if len(shared) == MOST_SHARED:
        raise RuntimeError("too many texts share a 64-bit name")
    return F.when(first.isin(shared), F.xxhash64(first, second)).otherwise(first) if shared else first


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays side by side, compressed."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(data, "<i8", n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out
