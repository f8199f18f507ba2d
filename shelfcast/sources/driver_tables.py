"""Retail tables derived from the driver's lineitem, part, supplier, nation and region.

A store is a region, a SKU is a part brand; one series is a (region, brand) pair. Facts are
aggregated to (store, sku, day) before anything else touches them: the partial aggregate runs on
the map side, so later shuffles and windows see days, not order lines, however skewed those are.
Joins carry no hints: Spark broadcasts a dimension only when its size allows, and AQE splits a hot
part or supplier in a sort-merge join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.dates import DAY_NS, as_ns
from shelfcast.operators.profile import calendar as calendar_dimension
from shelfcast.session import saved
from shelfcast.sources.schemas import SERIES


class DriverTables:
    """Lazy retail frames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}
        self._daily: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        """A driver table; its footer is read once per instance."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def lines(self) -> DataFrame:
        """Order lines with store, SKU and exact integer amounts."""
        parts = self.table("part").select("p_partkey", sku_id(F.col("p_brand")).alias("sku_id"))
        items = self.table("lineitem").select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.to_date("l_shipdate").alias("d"),
            F.col("l_quantity").cast("long").alias("qty"),
            _hundredths("l_extendedprice").alias("cents"),
            _hundredths("l_discount").alias("disc_pct"),
        )
        suppliers = self.table("supplier").select("s_suppkey", "s_nationkey")
        nations = self.table("nation").select("n_nationkey", store_id(F.col("n_regionkey")).alias("store_id"))
        # Each dimension joins the lines directly: file sizes are known when the plan is made, the
        # size of a joined pair of dimensions is not, and would cost a shuffle of the lines.
        return (
            items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("l_orderkey", "l_linenumber", *SERIES, "d", "qty", "cents", "disc_pct")
        )

    def daily(self) -> DataFrame:
        """Exact integer sums per (store, SKU, day): the one aggregate over order lines from which
        both sales and prices follow."""
        if self._daily is None:
            self._daily = self.lines().groupBy(*SERIES, "d").agg(
                F.sum("qty").alias("qty"),
                F.sum("cents").alias("cents"),
                F.sum(F.col("cents") * (F.lit(100) - F.col("disc_pct"))).alias("net"),
                F.sum("disc_pct").alias("disc"),
                F.count("*").alias("n"),
            )
        return self._daily

    def settled(self) -> DriverTables:
        """The same tables with the daily aggregate written to the checkpoint folder, for queries
        that read sales or prices more than once: the order lines are then scanned once."""
        other = DriverTables(self.spark, self.folder)
        other._tables, other._daily = self._tables, saved(self.daily(), "daily")
        return other

    def sales(self) -> DataFrame:
        return self.daily().select(
            *SERIES,
            as_ns("d").alias("date"),
            F.col("qty").alias("units_sold"),
            (F.col("net").cast("double") / F.lit(10000.0)).alias("revenue"),
            F.year("d").alias("year"),
            F.month("d").alias("month"),
        )

    def prices(self) -> DataFrame:
        monday = F.to_date(F.date_trunc("week", "d"))
        weekly = self.daily().groupBy(*SERIES, monday.alias("w")).agg(
            F.sum("cents").alias("cents"),
            F.sum("qty").alias("qty"),
            F.sum("disc").alias("disc"),
            F.sum("n").alias("n"),
        )
        unit_cents = F.floor(F.col("cents").cast("double") / F.col("qty").cast("double"))
        return weekly.select(
            *SERIES,
            as_ns("w").alias("week_start"),
            (unit_cents.cast("double") / F.lit(100.0)).alias("price"),
            (F.col("disc") >= F.col("n") * 6).alias("is_promo"),
            F.year("w").alias("year"),
        )

    def stores(self) -> DataFrame:
        nation = self.table("nation").groupBy("n_regionkey").agg(F.min("n_name").alias("state"))
        region = self.table("region").join(nation, F.col("r_regionkey") == F.col("n_regionkey"), "left")
        key = F.col("r_regionkey")
        kind = F.when(key % 3 == 0, "A").when(key % 3 == 1, "B").otherwise("C")
        return region.select(
            store_id(key).alias("store_id"),
            F.col("r_name").alias("region"),
            "state",
            kind.alias("store_type"),
            F.date_add(F.lit("1990-01-01").cast("date"), key * 100).alias("open_date"),
            (key.cast("long") * 5000 + 10000).alias("sqft"),
        )

    def products(self) -> DataFrame:
        cents = _hundredths("p_retailprice")
        return (
            self.table("part")
            .withColumn("sku_id", sku_id(F.col("p_brand")))
            .groupBy("sku_id")
            .agg(
                F.min_by("p_type", "p_partkey").alias("category"),
                F.max_by("p_type", "p_partkey").alias("subcategory"),
                (F.floor(F.avg(cents)) / F.lit(100.0)).alias("base_price"),
                (F.min("p_size") < 2).alias("is_perishable"),
                F.min("p_size").cast("long").alias("pack_size"),
            )
        )

    def bounds(self) -> DataFrame:
        day = F.to_date("l_shipdate")
        return self.table("lineitem").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))

    def calendar(self) -> DataFrame:
        return calendar_dimension(self.bounds())

    def dirty_sales(self) -> DataFrame:
        """Line-level sales as they might arrive: text quantities, mixed case, negatives, repeats."""
        lines = self.lines().withColumn("copies", F.when(F.col("l_orderkey") % 200 == 3, 2).otherwise(1))
        order = F.col("l_orderkey")
        units = (
            F.when(order % 700 == 1, "n/a")
            .when(order % 500 == 0, (-F.col("qty") - 1).cast("string"))
            .otherwise(F.col("qty").cast("string"))
        )
        revenue = (F.col("cents") * (F.lit(100) - F.col("disc_pct"))).cast("double") / F.lit(10000.0)
        return lines.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
            F.when(order % 1000 == 7, F.upper("store_id")).otherwise(F.col("store_id")).alias("store_id"),
            F.when(order % 900 != 5, F.col("sku_id")).alias("sku_id"),
            as_ns("d").alias("date"),
            units.alias("units_sold"),
            revenue.alias("revenue"),
            F.year("d").alias("year"),
            F.month("d").alias("month"),
            F.timestamp_seconds(F.col("l_linenumber").cast("long")).alias("_ingested_at"),
        )

    def dirty_prices(self) -> DataFrame:
        """Weekly prices with gaps, mixed case, broken keys and repeats."""
        week = (F.col("week_start") / F.lit(7 * DAY_NS)).cast("long")
        sku = F.substring("sku_id", 5, 5).cast("int")
        mark = week * 31 + sku * 7
        return self.prices().withColumns(
            {
                "copy": F.explode(F.sequence(F.lit(1), F.when(mark % 50 == 3, 2).otherwise(1))),
            }
        ).select(
            F.when(mark % 90 == 7, F.upper("store_id")).otherwise(F.col("store_id")).alias("store_id"),
            "sku_id",
            F.when(mark % 83 != 1, F.col("week_start")).alias("week_start"),
            F.when(mark % 11 != 0, F.col("price")).alias("price"),
            "is_promo",
            "year",
        )

    def dirty_products(self) -> DataFrame:
        """Part rows as product rows: many per SKU, some without a category."""
        part = F.col("p_partkey")
        return self.table("part").select(
            sku_id(F.col("p_brand")).alias("sku_id"),
            F.when(part % 13 != 0, F.col("p_type")).alias("category"),
            F.col("p_name").alias("subcategory"),
            F.col("p_retailprice").cast("string").alias("base_price"),
            (F.col("p_size") < 10).alias("is_perishable"),
            F.when(part % 17 == 0, "?").otherwise(F.col("p_size").cast("string")).alias("pack_size"),
        )


def _hundredths(amount: str) -> Column:
    """Non-negative amount in whole hundredths; floor stays in primitive code, round would build a
    decimal per value."""
    return F.floor(F.col(amount) * 100 + 0.5)


def store_id(region_key: Column) -> Column:
    number = F.lpad((region_key + 1).cast("string"), 4, "0")
    return F.concat(F.lit("store_"), number)


def sku_id(brand: Column) -> Column:
    return F.concat(F.lit("sku_"), F.lpad(F.substring(brand, 7, 10), 5, "0"))
