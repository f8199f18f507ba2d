import math
import statistics

import pytest
from helpers import DAY, day, ns, rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.operators import audit
from shelfcast.operators import features as gold
from shelfcast.operators.profile import calendar
from shelfcast.plans import catalog
from shelfcast.sources.driver_tables import DriverTables

SALES = "store_id string, sku_id string, date long, units_sold long, revenue double, year int, month int"
PRICES = "store_id string, sku_id string, week_start long, price double, is_promo boolean, year int"


@pytest.fixture(scope="module")
def ramp(spark):
    start = "2026-01-01"
    sales = [("s", "a", day(i, start), i, float(i), 2026, 1) for i in range(90)]
    monday = ns("2025-12-29")
    prices = [("s", "a", monday + 7 * DAY * w, 10.0 + w, w % 2 == 0, 2026) for w in range(14)]
    bounds = spark.sql("select date'2025-12-01' first_day, date'2026-04-30' last_day")
    return (
        spark.createDataFrame(sales, SALES),
        spark.createDataFrame(prices, PRICES),
        calendar(bounds),
    )


@pytest.fixture(scope="module")
def driver(spark):
    return DriverTables(spark, "/root/testdata/sf0.001")


def test_ramp_row(ramp):
    master = gold.features_master(*ramp)
    assert len(master.columns) == 49 and master.count() == 90
    row = master.filter(F.col("date") == ns("2026-01-15")).first()
    assert row.label_units_sold == 14 and row.lag_7_units == 7 and row.lag_14_units == 0
    assert row.rolling_mean_7 == sum(range(7, 14)) / 7
    assert math.isclose(row.rolling_std_7, math.sqrt(28 / 6))
    assert row.rolling_zero_rate_7 == 0.0 and row.rolling_zero_rate_14 == 1 / 14
    assert row.price_week_start == ns("2026-01-12") and row.current_price == 12.0
    assert row.price_4w_ago is None and row.discount_depth is None
    assert row.is_on_promo and row.days_since_promo_start == 3 and row.promo_streak_length == 4
    assert row.days_until_promo_end == 3
    assert row.days_since_last_holiday == 14 and row.days_to_next_holiday is None
    off = master.filter(F.col("date") == ns("2026-01-08")).first()
    assert off.days_since_promo_start is None and off.promo_streak_length == 0
    late = master.filter(F.col("date") == ns("2026-02-10")).first()
    assert late.price_4w_ago == 12.0 and math.isclose(late.price_ratio_4w, 16 / 12) and late.discount_depth == 0.0
    first = master.filter(F.col("date") == ns("2026-01-01")).first()
    assert first.lag_1_units is None and first.rolling_mean_7 is None and first.rolling_std_7 is None


def test_running_totals_equal_plain_frames(driver):
    sales = driver.sales()
    expected = audit._expected(sales)
    got = gold.add_demand_history(sales)
    bad = got.join(expected, ["store_id", "sku_id", "date"])
    names = [*gold.LAG_COLUMNS, *gold.ROLLING_COLUMNS]
    counts = bad.agg(*[F.sum(audit._differs(n).cast("int")).alias(n) for n in names]).first()
    assert set(counts) == {0} and bad.count() == sales.count()


def test_rolling_std_of_constant_series_is_zero(spark):
    data = [("s", "a", day(i), 1_000_003, 1.0, 2025, 1) for i in range(40)]
    stds = gold.add_rolling(spark.createDataFrame(data, SALES)).select("rolling_std_7", "rolling_std_28")
    assert {v for r in rows(stds) for v in r if v is not None} == {0.0}


def test_asof_equals_inequality_join(driver):
    sales, prices = driver.sales().select("store_id", "sku_id", "date"), driver.prices()
    # every third week only, so that most days reach back over several weeks
    sparse = prices.filter((F.col("week_start") / F.lit(7 * DAY)).cast("long") % 3 == 0)
    got = gold.asof_backward(
        sales, sparse, ["store_id", "sku_id"], "date", "week_start", {"w": "week_start", "p": "price"}
    )
    pairs = sales.alias("s").join(
        sparse.alias("v"),
        (F.col("s.store_id") == F.col("v.store_id"))
        & (F.col("s.sku_id") == F.col("v.sku_id"))
        & (F.col("v.week_start") <= F.col("s.date")),
        "left",
    )
    latest = Window.partitionBy("s.store_id", "s.sku_id", "s.date").orderBy(F.col("v.week_start").desc())
    want = (
        pairs.withColumn("rn", F.row_number().over(latest))
        .filter("rn = 1")
        .select("s.store_id", "s.sku_id", "s.date", F.col("v.week_start").alias("w"), F.col("v.price").alias("p"))
    )
    assert got.count() == sales.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_asof_of_repeated_facts(spark):
    facts = spark.createDataFrame([("k", 5, i) for i in range(50)] + [("k", 1, 99), ("n", 5, 98)], "key string, at long, id long")
    versions = spark.createDataFrame([("k", 2, 1.0), ("k", 5, None), ("k", 6, 3.0)], "key string, since long, p double")
    got = gold.asof_backward(facts, versions, ["key"], "at", "since", {"w": "since", "p": "p"}, repeated=True)
    want = [("k", 5, i, 5, None) for i in range(50)] + [("k", 1, 99, None, None), ("n", 5, 98, None, None)]
    assert sorted(rows(got), key=lambda r: r[2]) == sorted(want, key=lambda r: r[2])


def test_holiday_window_equals_range_join(driver):
    days = driver.calendar()
    hol = days.filter("is_us_holiday").select(F.col("date").alias("h"))
    near = days.join(hol, F.col("h").between(F.col("date") - 370 * DAY, F.col("date") + 370 * DAY), "left")
    want = near.groupBy("date").agg(
        ((F.col("date") - F.max(F.when(F.col("h") <= F.col("date"), F.col("h")))) / DAY).cast("int"),
        ((F.min(F.when(F.col("h") >= F.col("date"), F.col("h"))) - F.col("date")) / DAY).cast("int"),
    )
    got = gold.calendar_features(days).select("date", "days_since_last_holiday", "days_to_next_holiday")
    assert got.exceptAll(want).count() == 0


def test_master_shuffles_each_input_once(driver):
    plan = catalog.master(driver)._jdf.queryExecution().executedPlan().toString()
    by_series = [
        line
        for line in plan.splitlines()
        if "Exchange hashpartitioning(store_id" in line and line.count("#") == 3 + line.count("plan_id=#") - 1
    ]
    assert len(by_series) == 2, plan


def test_rolling_deviation_of_large_volumes_after_a_ramp(spark):
    units = [400_000] + [47_000_000 + (i * 7_919) % 80_000 - 40_000 for i in range(400)]
    frame = spark.createDataFrame(
        [("S1", "K1", day(i), u) for i, u in enumerate(units)], "store_id string, sku_id string, date long, units_sold long"
    )
    found = gold.add_rolling(frame).orderBy("date").collect()
    for i, row in enumerate(found):
        for n in gold.ROLLING:
            before = units[max(0, i - n) : i]
            want = statistics.stdev(before) if len(before) > 1 else None
            assert row[f"rolling_std_{n}"] == (want if want is None else pytest.approx(want, rel=1e-9))
