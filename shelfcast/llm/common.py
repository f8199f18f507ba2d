"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import scratch_folder

#: Where null keys stand in an order.
NULL_KEY = -(1 << 63)

#: Rows of an ordered partition, at most, as long as keys are spread evenly.
ROWS_PER_PART = 20_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write the rows below the shared checkpoint folder and read them from there: lineage ends
    here, no executor holds the only copy, and later readers prune columns."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = "8m"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While a job runs, its Arrow batches are bounded by bytes: rows hold whole texts, and both
    sides keep a batch in memory. The session's own setting returns afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def held_out(key: Column) -> Column:
    """True if crc32 of the key as text leaves 0 on division by 5; a null key is never learned from,
    so it counts as held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def binary(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def raw_text(text: Column) -> Column:
    """The text's UTF-8 bytes, null as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def long_or_null(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where null) and the null mask of an integer column."""
    return (
        column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
        column.is_null().to_numpy(zero_copy_only=False),
    )


def shuffle_width(spark: SparkSession, rows: int, per_part: int = ROWS_PER_PART) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_part), 1)


class KeyRanges:
    """Consecutive ranges of an integer key, about equally full.

    Only the cut points (one number for each partition) and the smallest key of each range come to
    the driver. Cut points are fixed before rows move, so a repeated task deals its rows alike.
    """

    def __init__(self, df: DataFrame, key: str, parts: int | None = None):
        keys = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("k"))
        rows = keys.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        self.parts = parts or shuffle_width(df.sparkSession, rows)
        marks = [i / self.parts for i in range(1, self.parts)]
        cuts = []
        if marks and rows:
            cuts = keys.agg(F.percentile_approx("k", marks, 20 * self.parts).alias("c")).first()["c"]
        self.all_cuts = np.sort(np.array(cuts or [], dtype=np.int64))
        self.cuts = np.unique(self.all_cuts)
        self.rows = rows

    def of(self, keys: np.ndarray, null: np.ndarray) -> np.ndarray:
        """The range of each key; null keys come first."""
        return np.where(null, 0, np.searchsorted(self.cuts, keys, side="right")).astype(np.int32)

    def spread(self, keys: np.ndarray, null: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The range of each row, for readers that need no order among rows of one key: a key that
        several cut points fall on has so many ranges, among which the salt chooses."""
        keys = np.where(null, NULL_KEY, keys)
        low, high = (np.searchsorted(self.all_cuts, keys, side=s) for s in ("left", "right"))
        ways = np.maximum(high - low, 1)
        mixed = salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        chosen = ((mixed >> np.uint64(33)) % ways.astype(np.uint64)).astype(np.int64)
        return np.where(high > low, low + 1 + chosen, low).astype(np.int32)


def release() -> None:
    """Return what a task has freed to the system: workers are reused, and would keep the peak of
    every earlier stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `limit` bytes of the given column (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield b.slice(lo, hi - lo)
    release()


def kept_rows(docs: DataFrame, text: str, accept: Callable[[list[bytes | None]], Sequence[bool]]) -> DataFrame:
    """The rows whose text, as UTF-8 bytes or None, is accepted; all columns pass as they are.
    `accept` sees the texts of a piece at once."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, at, 2 << 20):
            yield b.filter(pa.array(accept(binary(b.column(at))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
