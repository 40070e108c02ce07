"""Shared column expressions and small Arrow helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import cut, shared_dir  # noqa: F401  used by the operators from here

try:  # glibc only
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _TRIM = None

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what stands between words once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def prefix(df: DataFrame) -> str:
    """A beginning that no column of df has, whatever the case, for names of an operator's own."""
    name = "_x"
    while any(c.lower().startswith(name) for c in df.columns):
        name += "x"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def blocks(texts: pa.Array, most: int = 1 << 21) -> Iterator[pa.Array]:
    """Zero-copy runs of consecutive texts of about `most` bytes (one text at least)."""
    if len(texts) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield texts.slice(i, j - i)
        i = j


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text array and n+1 offsets into them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Zero-copy runs of consecutive rows whose texts sum to about `most` bytes."""
    i = 0
    for part in blocks(batch.column(text), most):
        yield batch.slice(i, len(part))
        i += len(part)


def batch_bytes(spark: SparkSession, size: str) -> None:
    """Sets how large an Arrow batch of texts may be (Spark's setting; its default is 64 MB).

    What the JVM buffers and a Python worker holds is a few times that, for every task that runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: the executor's limit holds for all its workers."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def give_back(spark: SparkSession) -> None:
    """Lets every executor's JVM return heap that it has grown to and no longer needs, which is for Python workers then.

    A job of one task for each core, without input; an executor that it misses keeps its heap, and nothing else depends on it.
    """
    spark.range(0, n := spark.sparkContext.defaultParallelism, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("x")).write.format("noop").mode("overwrite").save()


def thin(df: DataFrame, h: str, most: int, by: str | None = None) -> DataFrame:
    """df without the rows whose 64-bit hash `h` is surely not among the `most` smallest distinct ones (of each value of `by`).

    Keeps about twice as many, however large df is; the caller picks the exact ones from these few.
    """
    count = F.approx_count_distinct(h).alias("n")
    bound = lambda n: min(2**63 - 1, -(2**63) + int(2**64 * (2 * most + 100) / max(n, 1)))
    if by is None:
        return df.where(F.col(h) <= bound(df.agg(count).first().n))
    each = df.groupBy(by).agg(count).collect()  # one row per label
    if not each:
        return df
    kept = F.lit(False)
    for r in each:
        kept = kept | ((F.col(by) == r[by]) & (F.col(h) <= bound(r.n)))
    return df.where(kept)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet into the shared folder and read back: computed once, and the lineage ends there."""
    folder = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
