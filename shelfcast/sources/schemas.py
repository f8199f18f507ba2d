"""Table schemas, natural keys and partition columns of the retail layers."""

from __future__ import annotations

from pyspark.sql import types as T

TABLES = ("stores", "products", "calendar", "prices", "sales")

# Column names and types of the five business tables.
COLUMNS = {
    "stores": "store_id string, region string, state string, store_type string, open_date date, sqft long",
    "products": "sku_id string, category string, subcategory string, base_price double, "
    "is_perishable boolean, pack_size long",
    "calendar": "date long, dow int, week long, month int, quarter int, year int, "
    "is_weekend boolean, is_us_holiday boolean",
    "prices": "store_id string, sku_id string, week_start long, price double, is_promo boolean, year int",
    "sales": "store_id string, sku_id string, date long, units_sold long, revenue double, year int, month int",
}
# Natural keys.
KEYS = {
    "stores": ["store_id"],
    "products": ["sku_id"],
    "calendar": ["date"],
    "prices": ["store_id", "sku_id", "week_start"],
    "sales": ["store_id", "sku_id", "date"],
}
# Partition columns.
PARTITIONS = {"stores": [], "products": [], "calendar": [], "prices": ["year"], "sales": ["year", "month"]}
# Child column -> parent table.
REFERENCES = [
    ("sales", "store_id", "stores"),
    ("sales", "sku_id", "products"),
    ("sales", "date", "calendar"),
    ("prices", "store_id", "stores"),
    ("prices", "sku_id", "products"),
]
LOAD_COLUMNS = ("_ingested_at", "_source_path", "_ingest_run_id")
SERIES = ["store_id", "sku_id"]
SERIES_DAY = ["store_id", "sku_id", "date"]


def schema_of(table: str) -> T.StructType:
    if table not in COLUMNS:
        raise ValueError(f"unknown table: {table}")
    return T.StructType.fromDDL(COLUMNS[table])
