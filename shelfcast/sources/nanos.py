"""Parquet files with nanosecond timestamps, which Spark reads but doesn't write.

Tasks write them with Arrow, each its own file under a name given by its partition: first to a
temporary name, then renamed, so a repeated task leaves one whole file. The folder must be one that
all tasks see as a path.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame


def local_path(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"not a mounted folder: {path}")
    return parts.path


def write_nanos(df: DataFrame, path: str, columns: list[str]) -> int:
    """Write the rows with the given BIGINT columns as timestamp[ns]; returns the number of rows."""
    folder = local_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        own = f"{folder}/.{uuid.uuid4().hex}.tmp"
        writer, rows = None, 0
        for b in batches:
            table = pa.Table.from_batches([b])
            for c in columns:
                at = table.schema.get_field_index(c)
                table = table.set_column(at, c, table.column(c).cast(pa.timestamp("ns")))
            writer = writer or pq.ParquetWriter(own, table.schema, version="2.6")
            writer.write_table(table)
            rows += b.num_rows
        if writer:
            writer.close()
            os.replace(own, f"{folder}/part-{TaskContext.get().partitionId():05d}.parquet")
        yield pa.RecordBatch.from_pydict({"n": [rows]})

    return df.mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
