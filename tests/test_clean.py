from datetime import datetime

from helpers import day, rows

from shelfcast.operators import clean

SALES = (
    "store_id string, sku_id string, date long, units_sold string, revenue double, year int, month int, "
    "_ingested_at timestamp"
)


def metrics(cleaned):
    return cleaned.metrics.first().asDict()


def test_sales_keep_earliest_lowercase_nonnegative(spark):
    early, late = datetime(2026, 1, 1), datetime(2026, 1, 2)
    data = [
        ("STORE_1", "a", day(0), "2", 4.0, 2025, 10, early),
        ("store_1", "a", day(0), "3", 6.0, 2025, 10, late),
        ("store_1", "a", day(1), "-1", 1.0, 2025, 10, early),
        ("store_1", "a", day(2), "many", 1.0, 2025, 10, early),
        ("store_1", None, day(3), "1", 1.0, 2025, 10, early),
    ]
    cleaned = clean.clean_sales(spark.createDataFrame(data, SALES))
    assert rows(cleaned.frame.select("store_id", "date", "units_sold")) == [("store_1", day(0), 2)]
    assert metrics(cleaned) == {
        "rows_in": 5,
        "rows_out": 1,
        "dupes_dropped": 1,
        "nulls_dropped": 2,
        "invalid_dropped": 1,
        "imputations_applied": 0,
    }


def test_sales_ties_fall_to_smallest_row(spark):
    at = datetime(2026, 1, 1)
    data = [("s", "a", day(0), str(u), float(u), 2025, 10, at) for u in (5, 3, 4)]
    assert rows(clean.clean_sales(spark.createDataFrame(data, SALES)).frame.select("units_sold")) == [(3,)]


def test_prices_carry_forward(spark):
    ddl = "store_id string, sku_id string, week_start long, price double, is_promo boolean, year int"
    data = [
        ("S", "a", 1, None, False, 2025),
        ("s", "a", 2, 9.99, True, 2025),
        ("s", "a", 3, None, False, 2025),
        ("s", "a", 3, None, True, 2025),
        ("s", "b", None, 1.0, False, 2025),
        ("s", "b", 5, None, False, 2025),
    ]
    cleaned = clean.clean_prices(spark.createDataFrame(data, ddl))
    got = sorted(rows(cleaned.frame.select("week_start", "price", "is_promo")))
    assert got == [(2, 9.99, True), (3, 9.99, False)]
    assert metrics(cleaned) == {
        "rows_in": 6,
        "rows_out": 2,
        "dupes_dropped": 1,
        "nulls_dropped": 3,
        "invalid_dropped": 0,
        "imputations_applied": 2,
    }


def test_price_without_any_price_in_series_is_dropped(spark):
    ddl = "store_id string, sku_id string, week_start long, price double, is_promo boolean, year int"
    cleaned = clean.clean_prices(spark.createDataFrame([("s", "a", 1, None, False, 2025)], ddl))
    assert cleaned.frame.count() == 0 and metrics(cleaned)["nulls_dropped"] == 1


def test_dimension_drops_nulls_and_repeats_without_lowercasing(spark):
    ddl = "store_id string, region string, state string, store_type string, open_date date, sqft long, extra int"
    at = datetime(2020, 1, 1).date()
    data = [("A", "r", "s", "t", at, 1, 0), ("A", "r", "s", "t", at, 2, 0), (None, "r", "s", "t", at, 1, 0)]
    cleaned = clean.clean_dimension(spark.createDataFrame(data, ddl), "stores")
    assert rows(cleaned.frame.select("store_id", "sqft")) == [("A", 1)]
    assert "extra" not in cleaned.frame.columns
    assert metrics(cleaned)["dupes_dropped"] == 1 and metrics(cleaned)["nulls_dropped"] == 1


def test_dedupe_limits_hot_keys_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("'s' store_id", "cast(id % 3 as string) sku_id", "id % 2 date", "id units_sold")
    out = clean.first_per_key(df, ["store_id", "sku_id", "date"], [df.units_sold.asc()])
    assert sorted(rows(out.select("units_sold"))) == [(i,) for i in range(6)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_fill_prices_plain(spark):
    df = spark.createDataFrame(
        [("s", "a", 1, None), ("s", "a", 2, 5.0), ("s", "a", 3, None)],
        "store_id string, sku_id string, week_start long, price double",
    )
    got = sorted(rows(clean.fill_prices(df).select("week_start", "price", "was_imputed")))
    assert got == [(2, 5.0, False), (3, 5.0, True)]
