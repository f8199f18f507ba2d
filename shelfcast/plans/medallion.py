"""Bronze, Silver and Gold builds over path-backed layers."""

from __future__ import annotations

import time
import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators import audit, quality
from shelfcast.operators import features as gold
from shelfcast.operators.clean import counted_clean
from shelfcast.sources.layers import (
    Layer,
    check_identifier,
    load_statistics,
    scan_raw,
    sql_table,
    stamp_load,
    stamp_silver,
    with_year_month,
)
from shelfcast.sources.schemas import PARTITIONS, SERIES_DAY, TABLES

GOLD_TABLES = (
    "stg_sales_daily",
    "features_lag",
    "features_rolling",
    "features_price",
    "features_promo",
    "features_calendar",
    "features_seasonal",
    "features_master",
)


#: Tables that hold the keys and one feature family.
PARTS = {
    "features_lag": gold.LAG_COLUMNS,
    "features_rolling": gold.ROLLING_COLUMNS,
    "features_price": gold.PRICE_COLUMNS,
    "features_promo": gold.PROMO_COLUMNS,
    "features_seasonal": gold.SEASONAL_COLUMNS,
}


def _check(table: str, known: tuple[str, ...], mode: str) -> None:
    if table not in known:
        raise ValueError(f"unknown table: {table}")
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be overwrite or append")


class Bronze:
    """Raw Parquet to Bronze with load lineage. Tables commit one by one."""

    def __init__(self, raw_root: str, layer: Layer, schema: str = "default") -> None:
        self.raw_root, self.layer, self.schema = raw_root, layer, check_identifier(schema)

    def ingest(
        self, table: str, mode: str = "overwrite", run_id: str | None = None, register: bool = False
    ) -> dict[str, Any]:
        _check(table, TABLES, mode)
        started, run_id = time.monotonic(), run_id or uuid.uuid4().hex
        stamped = stamp_load(scan_raw(self.layer.spark, self.raw_root, table), run_id)
        self.layer.write(stamped, table, mode, PARTITIONS[table])
        registered = self.layer.register(self.schema, table) if register else False
        only = run_id if mode == "append" else None
        stats = load_statistics(self.layer.read(table), only).first()
        return {
            "rows_written": stats["rows_written"],
            "source_files": stats["source_files"],
            "bronze_location": self.layer.path(table),
            "ingest_run_id": run_id,
            "duration_seconds": round(time.monotonic() - started, 3),
            "registered": registered,
        }

    def ingest_all(self, mode: str = "overwrite", register: bool = False) -> dict[str, dict[str, Any]]:
        run_id = uuid.uuid4().hex
        return {t: self.ingest(t, mode, run_id, register) for t in TABLES}


class Silver:
    """Bronze to Silver: clean, stamp, write. The writing job counts the metrics."""

    def __init__(self, bronze: Layer, layer: Layer) -> None:
        self.bronze, self.layer = bronze, layer

    def build(self, table: str, mode: str = "overwrite", run_id: str | None = None) -> dict[str, Any]:
        _check(table, TABLES, mode)
        started, run_id = time.monotonic(), run_id or uuid.uuid4().hex
        source = self.bronze.read(table)
        cleaned = counted_clean(source, table)
        self.layer.write(stamp_silver(cleaned.frame, source, run_id), table, mode, PARTITIONS[table])
        return {
            **cleaned.metrics(),
            "bronze_location": self.bronze.path(table),
            "silver_location": self.layer.path(table),
            "silver_run_id": run_id,
            "duration_seconds": round(time.monotonic() - started, 3),
        }

    def build_all(self, mode: str = "overwrite", check: bool = False) -> dict[str, dict[str, Any]]:
        run_id = uuid.uuid4().hex
        out = {t: self.build(t, mode, run_id) for t in TABLES}
        if check:
            quality.require(self.checks())
        return out

    def checks(self) -> DataFrame:
        return quality.suite({t: self.layer.read(t) for t in TABLES})


class Gold:
    """Silver to Gold feature tables.

    Each table is built from Silver and the Gold tables before it. `templates` may replace a table
    by a SQL text over the views silver_* and gold_* ({SILVER_ROOT} and {GOLD_ROOT} are filled in).
    """

    def __init__(self, silver: Layer, layer: Layer, templates: dict[str, str] | None = None) -> None:
        self.silver, self.layer, self.templates = silver, layer, templates or {}

    def frame(self, table: str) -> DataFrame:
        if table in self.templates:
            self.silver.views("silver", TABLES)
            self.layer.views("gold", GOLD_TABLES)
            return sql_table(
                self.layer.spark,
                self.templates[table],
                SILVER_ROOT=self.silver.root,
                GOLD_ROOT=self.layer.root,
            )
        if table == "stg_sales_daily":
            return gold.staged_sales(self.silver.read("sales"))
        if table == "features_calendar":
            return gold.calendar_features(self.silver.read("calendar"))
        if table == "features_promo":
            priced = self.layer.read("features_price")
            return gold.add_promo(priced).select(*SERIES_DAY, *gold.PROMO_COLUMNS)
        staged = self.layer.read("stg_sales_daily")
        if table == "features_lag":
            return gold.add_lags(staged).select(*SERIES_DAY, *gold.LAG_COLUMNS)
        if table == "features_rolling":
            return gold.add_rolling(staged).select(*SERIES_DAY, *gold.ROLLING_COLUMNS)
        if table == "features_seasonal":
            return gold.add_seasonal(staged).select(*SERIES_DAY, *gold.SEASONAL_COLUMNS)
        prices = self.silver.read("prices")
        if table == "features_price":
            return gold.add_prices(staged, prices).select(*SERIES_DAY, *gold.PRICE_COLUMNS)
        return gold.features_master(staged, prices, self.silver.read("calendar"))

    def _part(self, table: str) -> DataFrame:
        """A feature table as columns of the master built just before."""
        return self.layer.read("features_master").select(*SERIES_DAY, *PARTS[table])

    def build(
        self, table: str, mode: str = "overwrite", run_id: str | None = None, from_master: bool = False
    ) -> dict[str, Any]:
        _check(table, GOLD_TABLES, mode)
        started, run_id = time.monotonic(), run_id or uuid.uuid4().hex
        frame = self._part(table) if from_master else self.frame(table)
        out = with_year_month(frame).withColumn("_gold_run_id", F.lit(run_id))
        dated = "year" in out.columns and "month" in out.columns
        self.layer.write(out, table, mode, ["year", "month"] if dated else None)
        return {
            "rows_written": self.layer.read(table).count(),
            "gold_location": self.layer.path(table),
            "gold_run_id": run_id,
            "duration_seconds": round(time.monotonic() - started, 3),
        }

    def build_all(self, mode: str = "overwrite", check: bool = False) -> dict[str, dict[str, Any]]:
        """All tables. Windows run once, for the master; the feature tables are columns of it, but for
        those that have a template."""
        run_id, made = uuid.uuid4().hex, {}
        parts = [t for t in PARTS if t not in self.templates and mode == "overwrite"]
        for table in sorted(GOLD_TABLES, key=lambda t: t in parts):
            made[table] = self.build(table, mode, run_id, from_master=table in parts)
        out = {t: made[t] for t in GOLD_TABLES}
        if check:
            audit.require_clean_audit(self.audit())
        return out

    def audit(self, sample_size: int = 1000) -> DataFrame:
        read = self.layer.read
        return audit.audit_master(
            read("features_master"), read("stg_sales_daily"), read("features_price"), sample_size
        )
