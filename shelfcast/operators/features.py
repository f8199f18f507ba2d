"""Gold feature engineering over a unique (store_id, sku_id, date) panel.

`add_*` functions append columns. All per-series windows share one partitioning, so the master
table needs one shuffle of sales and one of prices. A series has at most one row per day, which
bounds every window partition by the number of days on record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions.dates import DAY_NS, as_date
from shelfcast.operators.asof import asof_backward
from shelfcast.sources.schemas import SERIES, SERIES_DAY

# Lag offsets and rolling widths in rows.
LAGS = (1, 7, 14, 28, 365)
ROLLING = (7, 14, 28, 91)

LAG_COLUMNS = [f"lag_{n}_units" for n in LAGS]
ROLLING_COLUMNS = [f"rolling_{kind}_{n}" for n in ROLLING for kind in ("mean", "std", "zero_rate")]
PRICE_COLUMNS = [
    "price_week_start",
    "current_price",
    "price_4w_ago",
    "price_ratio_4w",
    "discount_depth",
    "is_on_promo",
]
PROMO_COLUMNS = ["days_since_promo_start", "days_until_promo_end", "promo_streak_length"]
CALENDAR_COLUMNS = [
    "dow",
    "week",
    "month",
    "quarter",
    "year",
    "is_weekend",
    "is_us_holiday",
    "dow_sin",
    "dow_cos",
    "month_sin",
    "month_cos",
    "day_of_year_sin",
    "day_of_year_cos",
    "days_since_last_holiday",
    "days_to_next_holiday",
]
SEASONAL_COLUMNS = ["same_day_last_year_units", "same_week_last_year_mean", "yoy_growth_ratio"]


def _by_day() -> Window:
    return Window.partitionBy(*SERIES).orderBy("date")


def staged_sales(sales: DataFrame) -> DataFrame:
    return sales.select(*SERIES_DAY, "units_sold", "revenue", "year", "month")


# The window all demand features share, as SQL text: one expression string per column keeps plan
# construction short.
_BY_DAY = "over (partition by store_id, sku_id order by date)"
_RUNNING = "over (partition by store_id, sku_id order by date rows between unbounded preceding and current row)"
_TOTALS = ("_n", "_dev", "_zero", "_sq")
# Whole numbers of 38 digits: products and sums of squares stay exact.
_WIDE = "decimal(38,0)"


def _lag_columns() -> list[str]:
    return [f"lag(units_sold, {n}) {_BY_DAY} as lag_{n}_units" for n in LAGS]


def add_lags(df: DataFrame) -> DataFrame:
    """Units sold n surviving rows earlier (row-based, not calendar-based)."""
    return df.selectExpr("*", *_lag_columns())


def _with_totals(df: DataFrame) -> DataFrame:
    """Running count, sum of the units less the series' first value, zero count, sum of squares.

    A moving frame is then the difference of two totals: constant work per row for any width,
    where a sliding frame would be summed again for each row. All totals are whole numbers, so
    differences are exact; squares are summed in 38 digits (units up to 1e17 in size; beyond that
    the sum raises).
    """
    based = df.selectExpr("*", f"first_value(units_sold) {_RUNNING} as _base")
    return based.selectExpr(
        "*",
        f"count(units_sold) {_RUNNING} as _n",
        f"sum(units_sold - _base) {_RUNNING} as _dev",
        f"count(case when units_sold = 0 then 1 end) {_RUNNING} as _zero",
        f"sum({_wide('units_sold - _base')} * {_wide('units_sold - _base')}) {_RUNNING} as _sq",
    )


def _wide(value: str) -> str:
    return f"cast(cast({value} as decimal(19,0)) as {_WIDE})"


def _frame(total: str, first: int, last: int) -> str:
    """Total over the rows `first` to `last` before the current one (first > last >= 1)."""

    none = f"cast(0 as {_WIDE})" if total == "_sq" else "0"

    def before(k: int) -> str:
        return f"coalesce(lag({total}, {k}) {_BY_DAY}, {none})"

    return f"({before(last)} - {before(first + 1)})"


def _rolling_frames() -> list[str]:
    return [f"{_frame(c, n, 1)} as {c}{n}" for n in ROLLING for c in _TOTALS]


def _deviation(n: int) -> str:
    """Sample deviation from exact sums: (n * squares - sum * sum) / (n * (n - 1)), by a double
    only at the end."""
    spread = f"cast(cast(_n{n} as {_WIDE}) * _sq{n} - {_wide(f'_dev{n}')} * {_wide(f'_dev{n}')} as double)"
    return f"case when _n{n} > 1 then sqrt({spread} / (cast(_n{n} as double) * (_n{n} - 1))) end"


def _mean(n: int | str) -> str:
    return f"(_dev{n} + _n{n} * _base) / _n{n}"


def _rolling_columns() -> list[str]:
    out = []
    for n in ROLLING:
        out += [
            f"case when _n{n} > 0 then {_mean(n)} end as rolling_mean_{n}",
            f"{_deviation(n)} as rolling_std_{n}",
            f"case when _n{n} > 0 then _zero{n} / _n{n} end as rolling_zero_rate_{n}",
        ]
    return out


def _seasonal_frames() -> list[str]:
    return [
        f"lag(units_sold, 365) {_BY_DAY} as same_day_last_year_units",
        f"lag(units_sold, 1) {_BY_DAY} as _yesterday",
        f"{_frame('_n', 371, 365)} as _ny",
        f"{_frame('_dev', 371, 365)} as _devy",
    ]


def _seasonal_columns() -> list[str]:
    return [
        "same_day_last_year_units",
        f"case when _ny > 0 then {_mean('y')} end as same_week_last_year_mean",
        f"case when _ny > 0 and {_mean('y')} <> 0 then _yesterday / ({_mean('y')}) end as yoy_growth_ratio",
    ]


def add_rolling(df: DataFrame) -> DataFrame:
    """Mean, sample deviation and share of zeros over the n rows before the current one."""
    framed = _with_totals(df).selectExpr(*df.columns, "_base", *_rolling_frames())
    return framed.selectExpr(*df.columns, *_rolling_columns())


def add_seasonal(df: DataFrame) -> DataFrame:
    """Prior-year anchors: the row 365 back and the mean of rows 371 to 365 back."""
    framed = _with_totals(df).selectExpr(*df.columns, "_base", *_seasonal_frames())
    return framed.selectExpr(*df.columns, *_seasonal_columns())


def add_demand_history(df: DataFrame) -> DataFrame:
    """Lags, rolling statistics and seasonal anchors from one set of running totals."""
    framed = _with_totals(df).selectExpr(
        *df.columns, "_base", *_lag_columns(), *_rolling_frames(), *_seasonal_frames()
    )
    return framed.selectExpr(*df.columns, *LAG_COLUMNS, *_rolling_columns(), *_seasonal_columns())


def price_versions(prices: DataFrame) -> DataFrame:
    """Weekly prices, each with the price exactly 28 days before its week (a one-value frame)."""
    gap = 28 * DAY_NS
    at_gap = Window.partitionBy(*SERIES).orderBy("week_start").rangeBetween(-gap, -gap)
    return prices.select(
        *SERIES, "week_start", "price", "is_promo", F.max("price").over(at_gap).alias("price_4w_ago")
    )


def add_prices(df: DataFrame, prices: DataFrame) -> DataFrame:
    """As-of price of each day, its anchor four weeks earlier, ratio and discount depth."""
    values = {
        "price_week_start": "week_start",
        "current_price": "price",
        "price_4w_ago": "price_4w_ago",
        "is_on_promo": "is_promo",
    }
    joined = asof_backward(df, price_versions(prices), SERIES, "date", "week_start", values)
    now, then = F.col("current_price"), F.col("price_4w_ago")
    return joined.withColumns(
        {
            "price_ratio_4w": now / F.nullif(then, F.lit(0.0)),
            "discount_depth": F.when(
                then != 0, F.greatest(F.lit(0.0), (then - now) / F.nullif(then, F.lit(0.0)))
            ),
        }
    )


def add_promo(df: DataFrame) -> DataFrame:
    """Gaps and islands over `is_on_promo`: days since the promotion began, days until it ends,
    streak in calendar days (0 off promotion)."""
    w = _by_day()
    on = F.coalesce("is_on_promo", F.lit(False))
    starts = on & ~F.coalesce(F.lag("is_on_promo").over(w), F.lit(False))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    blocks = df.withColumn("_start", starts.cast("int")).withColumn(
        "_block", F.sum("_start").over(running)
    )
    block = Window.partitionBy(*SERIES, "_block")
    promo_day = F.when(on, F.col("date"))
    bounded = blocks.withColumns(
        {"_first": F.min(promo_day).over(block), "_last": F.max(promo_day).over(block)}
    )

    def days(a: Column, b: Column) -> Column:
        return ((a - b) / F.lit(DAY_NS)).cast("int")

    since = days(F.col("date"), F.col("_first"))
    return bounded.withColumns(
        {
            "days_since_promo_start": F.when(on, since),
            "days_until_promo_end": F.when(on, days(F.col("_last"), F.col("date"))),
            "promo_streak_length": F.when(on, since + 1).otherwise(F.lit(0)),
        }
    ).drop("_start", "_block", "_first", "_last")


def calendar_features(calendar: DataFrame) -> DataFrame:
    """Cyclic encodings and distances to the nearest holidays within 370 days.

    The unpartitioned range window is over the calendar, one row per day.
    """
    reach = 370 * DAY_NS
    days = Window.orderBy("date")
    holiday = F.when(F.col("is_us_holiday"), F.col("date"))
    last = F.max(holiday).over(days.rangeBetween(-reach, 0))
    nxt = F.min(holiday).over(days.rangeBetween(0, reach))
    turn = F.lit(2.0) * F.pi()
    dow = turn * F.col("dow") / F.lit(7.0)
    month = turn * F.col("month") / F.lit(12.0)
    day = turn * F.dayofyear(as_date("date")) / F.lit(365.0)
    return calendar.select(
        "date",
        *CALENDAR_COLUMNS[:7],
        F.sin(dow).alias("dow_sin"),
        F.cos(dow).alias("dow_cos"),
        F.sin(month).alias("month_sin"),
        F.cos(month).alias("month_cos"),
        F.sin(day).alias("day_of_year_sin"),
        F.cos(day).alias("day_of_year_cos"),
        ((F.col("date") - last) / F.lit(DAY_NS)).cast("int").alias("days_since_last_holiday"),
        ((nxt - F.col("date")) / F.lit(DAY_NS)).cast("int").alias("days_to_next_holiday"),
    )


def features_master(sales: DataFrame, prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """All feature families in one pass: 49 columns per (store_id, sku_id, date).

    Spark broadcasts the calendar (one row per day) as long as its size check allows.
    """
    panel = sales.select(*SERIES_DAY, "units_sold", "revenue")
    # the as-of stream leaves every series in date order: the demand windows reuse that sort
    wide = add_promo(add_demand_history(add_prices(panel, prices)))
    days = calendar_features(calendar)
    return wide.join(days, "date", "left").select(
        *SERIES_DAY,
        F.col("units_sold").alias("label_units_sold"),
        "revenue",
        *LAG_COLUMNS,
        *ROLLING_COLUMNS,
        *PRICE_COLUMNS,
        *PROMO_COLUMNS,
        *CALENDAR_COLUMNS,
        *SEASONAL_COLUMNS,
    )
