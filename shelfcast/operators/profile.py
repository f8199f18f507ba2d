"""Panel construction and data profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.dates import DAY_NS, as_ns, week_start
from shelfcast.sources.schemas import SERIES, SERIES_DAY

# Fixed-date US federal holidays as (month, day).
FIXED_HOLIDAYS = ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))


def is_fixed_holiday(day: Column) -> Column:
    hits = [(F.month(day) == m) & (F.day(day) == d) for m, d in FIXED_HOLIDAYS]
    return reduce(lambda a, b: a | b, hits)


def calendar(bounds: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Calendar dimension for a one-row frame (first_day, last_day: DATE).

    `holidays` is a frame of DATE `day`; without it the fixed-date federal holidays apply.
    """
    days = bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("day"))
    if holidays is None:
        days = days.withColumn("is_us_holiday", is_fixed_holiday(F.col("day")))
    else:
        marked = holidays.select("day").distinct().withColumn("_hit", F.lit(True))
        days = days.join(marked, "day", "left").withColumn(
            "is_us_holiday", F.coalesce("_hit", F.lit(False))
        )
    return days.select(
        as_ns("day").alias("date"),
        F.weekday("day").alias("dow"),
        F.weekofyear("day").cast("long").alias("week"),
        F.month("day").alias("month"),
        F.quarter("day").alias("quarter"),
        F.year("day").alias("year"),
        (F.weekday("day") >= 5).alias("is_weekend"),
        "is_us_holiday",
    )


def panel_spine(series: DataFrame, first: Column, last: Column) -> DataFrame:
    """Every day between two epoch-ns dates for every series, with its Monday. Days are exploded
    from a sequence, so no join is involved."""
    days = F.explode(F.sequence(first, last, F.lit(DAY_NS)))
    return series.select(*SERIES).distinct().withColumn("date", days).withColumn(
        "week_start", week_start("date")
    )


def dense_sales(spine: DataFrame, sales: DataFrame) -> DataFrame:
    """The spine with units sold, 0 on days without a sale."""
    sold = sales.select(*SERIES_DAY, "units_sold")
    filled = F.coalesce("units_sold", F.lit(0)).cast("long")
    return spine.join(sold, SERIES_DAY, "left").withColumn("units_sold", filled)


def price_panel(
    panel: DataFrame, prices: DataFrame, products: DataFrame, low: float = 0.4, high: float = 1.6
) -> DataFrame:
    """Weekly price (base price where missing), promo flag, clipped price ratio and revenue."""
    weekly = prices.select(*SERIES, "week_start", "price", "is_promo")
    base = products.select("sku_id", "base_price")
    joined = panel.join(weekly, [*SERIES, "week_start"], "left").join(base, "sku_id", "left")
    price = F.coalesce("price", "base_price")
    ratio = price / F.nullif(F.col("base_price"), F.lit(0.0))
    return joined.withColumns(
        {
            "price": price,
            "is_promo": F.coalesce("is_promo", F.lit(False)),
            "price_ratio": F.least(F.greatest(ratio, F.lit(low)), F.lit(high)),
            "revenue": F.round(F.col("units_sold") * price, 2),
        }
    )


def promo_lift(sales: DataFrame, prices: DataFrame) -> DataFrame:
    """Mean units on and off promotion per series and their ratio; series seen in both only."""
    weekly = prices.select(*SERIES, "week_start", "is_promo")
    dated = sales.select(*SERIES, "units_sold", week_start("date").alias("week_start"))
    joined = dated.join(weekly, [*SERIES, "week_start"], "inner")
    on, off = F.when(F.col("is_promo"), F.col("units_sold")), F.when(~F.col("is_promo"), F.col("units_sold"))
    means = joined.groupBy(*SERIES).agg(F.avg(on).alias("promo_mean"), F.avg(off).alias("other_mean"))
    both = means.filter(F.col("promo_mean").isNotNull() & F.col("other_mean").isNotNull())
    return both.withColumn("lift", F.col("promo_mean") / F.nullif(F.col("other_mean"), F.lit(0.0)))


def mean_promo_lift(sales: DataFrame, prices: DataFrame) -> DataFrame:
    """Number of series seen on and off promotion and the mean of their lifts (null lifts, of series
    without units off promotion, count as series only)."""
    lifts = promo_lift(sales, prices)
    return lifts.agg(F.count("*").alias("n_series"), F.avg("lift").alias("mean_lift"))


def intermittent_share(sales: DataFrame, limit: float = 0.5) -> DataFrame:
    """Share of SKUs with more than `limit` of their rows at zero units."""
    zero = F.avg((F.col("units_sold") == 0).cast("double"))
    per_sku = sales.groupBy("sku_id").agg(zero.alias("zero_rate"))
    return per_sku.agg(
        F.count("*").alias("n_skus"),
        F.avg((F.col("zero_rate") > limit).cast("double")).alias("intermittent_share"),
    )


def dirtiness(sales: DataFrame, prices: DataFrame) -> DataFrame:
    """One row of rates: repeated rows, negative units, upper-case store ids, rows per key, null
    prices. Repeats collapse in two partial aggregates, so a hot key costs no more than others."""
    columns = ["store_id", "sku_id", "date", "units_sold", "revenue"]
    per_row = sales.groupBy(*columns).agg(F.count("*").alias("n"))
    negative, upper = F.col("units_sold") < 0, F.col("store_id").rlike("[A-Z]")

    def rows_where(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))

    per_key = per_row.groupBy(*SERIES_DAY).agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("distinct_rows"),
        rows_where(negative).alias("negative"),
        rows_where(upper).alias("upper"),
    )
    totals = per_key.agg(
        F.sum("rows").alias("rows"),
        F.sum("distinct_rows").alias("distinct_rows"),
        F.sum("negative").alias("negative"),
        F.sum("upper").alias("upper"),
        F.count("*").alias("keys"),
    )
    rows = F.nullif(F.col("rows"), F.lit(0))
    unpriced = prices.agg(F.avg(F.col("price").isNull().cast("double"))).scalar()
    return totals.select(
        F.col("rows").alias("n_rows"),
        ((F.col("rows") - F.col("distinct_rows")) / rows).alias("duplicate_rate"),
        (F.col("negative") / rows).alias("negative_rate"),
        (F.col("upper") / rows).alias("wrong_case_rate"),
        (F.col("rows") / F.nullif(F.col("keys"), F.lit(0))).alias("rows_per_key"),
        unpriced.alias("null_price_rate"),
    )


def holiday_frame(spark: SparkSession, days: list[str]) -> DataFrame:
    """A small user list of ISO dates as the holiday frame of `calendar`."""
    return spark.createDataFrame([(d,) for d in days], "day string").select(F.to_date("day").alias("day"))
