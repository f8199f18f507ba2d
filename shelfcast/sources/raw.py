"""Raw zone and report files."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.dates import as_date
from shelfcast.sources.layers import Layer, with_year_month
from shelfcast.sources.schemas import PARTITIONS

# Name parts of settings that are never written out.
SECRET_PARTS = ("secret", "password", "token", "key")


def write_raw(layer: Layer, df: DataFrame, table: str, mode: str = "overwrite") -> None:
    """Hive-partitioned Parquet; Spark names every part file afresh, so appends never collide."""
    if table == "prices" and "year" not in df.columns:
        df = df.withColumn("year", F.year(as_date("week_start")))
    if table == "sales":
        df = with_year_month(df)
    layer.write(df, table, mode, PARTITIONS[table])


def table_sizes(layer: Layer, tables: tuple[str, ...] | list[str]) -> DataFrame:
    """Rows and bytes per table. Bytes count each data file once, row counts come from the scan."""
    parts = []
    for table in tables:
        files = (
            layer.read(table)
            .select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
            .groupBy("f")
            .agg(F.count("*").alias("n"), F.max("b").alias("b"))
        )
        parts.append(
            files.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                F.coalesce(F.sum("b"), F.lit(0)).alias("byte_size"),
            ).select(
                F.lit(table).alias("table_name"),
                "row_count",
                "byte_size",
                F.lit(layer.path(table)).alias("uri"),
                F.lit(",".join(PARTITIONS.get(table, []))).alias("partition_cols"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def redact(config: dict[str, Any]) -> dict[str, Any]:
    hidden = "***REDACTED***"
    return {k: hidden if any(s in k.lower() for s in SECRET_PARTS) else v for k, v in config.items()}


def write_manifest(
    layer: Layer, tables: tuple[str, ...] | list[str], config: dict[str, Any], seed: int = 42
) -> dict[str, Any]:
    """Describe a raw-zone run in one JSON file below `_manifests` (a few table rows only)."""
    run_id = uuid.uuid4().hex
    stats = {row["table_name"]: row for row in table_sizes(layer, tables).collect()}
    manifest = {
        "run_id": run_id,
        "generated_at": datetime.now(UTC).isoformat(),
        "seed": seed,
        "config": redact(config),
        "tables": {
            name: {
                "row_count": row["row_count"],
                "byte_size": row["byte_size"],
                "uri": row["uri"],
                "partition_cols": [c for c in row["partition_cols"].split(",") if c],
            }
            for name, row in stats.items()
        },
    }
    text = json.dumps(manifest, sort_keys=True, default=str)
    uri = f"{layer.root.rstrip('/')}/_manifests/{run_id}"
    layer.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(uri)
    return {**manifest, "manifest_uri": uri}


def count_tables(layer: Layer, tables: tuple[str, ...] | list[str]) -> DataFrame:
    """Row count per table, one union of footer-only counts."""
    out = None
    for table in tables:
        part = layer.read(table).agg(F.count("*").alias("rows"))
        part = part.select(F.lit(table).alias("table_name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A headed CSV report. Small results come out as one file, since AQE merges small partitions;
    a large one (such as per-series KPIs) stays spread over its tasks."""
    df.write.mode("overwrite").option("header", True).csv(path)


def hash_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """N rows in hash order of their keys: the same rows on every run."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """N rows by a seeded draw, all rows if fewer. The draw hashes keys with the seed, so a task
    that runs again after an executor loss draws the same rows (`rand` would depend on row order)."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
