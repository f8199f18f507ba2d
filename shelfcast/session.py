"""Session helpers: local sessions for tests and benches, and durable scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    # HotSpot does not compile methods above 8000 bytes: wide feature projections run faster
    # outside one fused method
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session; a cluster job passes its own session to every function instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfcast")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_folder(spark: SparkSession) -> str | None:
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder. Only a local session, whose tasks
    all run here, gets one below /tmp where none is set."""
    root = _shared_folder(spark)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/shelfcast-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write the rows below the scratch folder as Parquet and read them from there: lineage ends
    here, and later readers prune columns and know the size."""
    path = f"{scratch_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freeze(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder once and read them from there afterwards.

    Used where later steps must see one fixed row-to-partition assignment even if executors are
    lost and tasks run again.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(spark))
    return df.checkpoint(eager=True)
