from datetime import date

from helpers import DAY, day, ns, rows
from pyspark.sql import functions as F

from shelfcast.functions.dates import as_date, day_number, week_start
from shelfcast.operators import profile


def test_calendar(spark):
    bounds = spark.sql("select date'2024-12-24' first_day, date'2025-01-06' last_day")
    got = {r.date: r for r in profile.calendar(bounds).collect()}
    assert len(got) == 14
    xmas = got[ns("2024-12-25")]
    assert (xmas.dow, xmas.week, xmas.month, xmas.quarter, xmas.year) == (2, 52, 12, 4, 2024)
    assert xmas.is_us_holiday and not xmas.is_weekend
    assert got[ns("2025-01-05")].is_weekend and got[ns("2024-12-30")].week == 1
    own = profile.calendar(bounds, profile.holiday_frame(spark, ["2025-01-06"]))
    assert rows(own.filter("is_us_holiday").select("date")) == [(ns("2025-01-06"),)]


def test_dates(spark):
    values = [ns("1969-12-29"), ns("1970-01-01"), ns("2026-01-11"), ns("2026-01-12") + 5]
    df = spark.createDataFrame([(v,) for v in values], "d long")
    got = rows(df.select(day_number("d"), as_date("d"), week_start("d")))
    assert [g[0] for g in got] == [-3, 0, 20464, 20465]
    assert got[0][1] == date(1969, 12, 29) and got[3][1] == date(2026, 1, 12)
    assert [g[2] for g in got] == [ns("1969-12-29"), ns("1969-12-29"), ns("2026-01-05"), ns("2026-01-12")]


def test_panel_and_prices(spark):
    keys = "store_id string, sku_id string, "
    prices = spark.createDataFrame([("s", "a", day(0), 2.0, True)], keys + "week_start long, price double, is_promo boolean")
    products = spark.createDataFrame([("a", 4.0)], "sku_id string, base_price double")
    sales = spark.createDataFrame([("s", "a", day(1), 3), ("s", "a", day(8), 5)], keys + "date long, units_sold long")
    spine = profile.panel_spine(prices, F.lit(day(0)), F.lit(day(9)))
    panel = profile.dense_sales(spine, sales)
    assert panel.count() == 10 and panel.agg(F.sum("units_sold")).first()[0] == 8
    got = {r.date: r for r in profile.price_panel(panel, prices, products).collect()}
    assert (got[day(1)].price, got[day(1)].is_promo, got[day(1)].revenue, got[day(1)].price_ratio) == (2.0, True, 6.0, 0.5)
    assert (got[day(8)].price, got[day(8)].is_promo, got[day(8)].revenue, got[day(8)].price_ratio) == (4.0, False, 20.0, 1.0)
    assert got[day(9)].week_start == day(7)


def test_lift_share_and_dirt(spark):
    keys = "store_id string, sku_id string, "
    prices = spark.createDataFrame(
        [("s", "a", day(0), 1.0, True), ("s", "a", day(7), None, False)], keys + "week_start long, price double, is_promo boolean"
    )
    sales = spark.createDataFrame(
        [("s", "a", day(0), 6, 1.0), ("s", "a", day(1), 2, 1.0), ("s", "a", day(7), 2, 1.0), ("S", "b", day(7), -1, 1.0),
         ("s", "a", day(7), 2, 1.0), ("s", "c", day(7), 0, 1.0)],
        keys + "date long, units_sold long, revenue double",
    )
    assert rows(profile.promo_lift(sales, prices).select("sku_id", "lift")) == [("a", 2.0)]
    assert rows(profile.mean_promo_lift(sales, prices)) == [(1, 2.0)]
    assert rows(profile.intermittent_share(sales)) == [(3, 1 / 3)]
    dirt = profile.dirtiness(sales, prices).first()
    assert (dirt.n_rows, dirt.duplicate_rate, dirt.negative_rate, dirt.wrong_case_rate) == (6, 1 / 6, 1 / 6, 1 / 6)
    assert dirt.rows_per_key == 6 / 5 and dirt.null_price_rate == 0.5
    assert DAY == day(1) - day(0)
