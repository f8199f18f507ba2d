import pytest
from helpers import day
from pyspark.sql import functions as F

from shelfcast.operators import audit
from shelfcast.operators import features as gold

SALES = "store_id string, sku_id string, date long, units_sold long, revenue double"


@pytest.fixture(scope="module")
def tables(spark):
    data = [("s", k, day(i), (i * 7 + j) % 11, 1.0) for j, k in enumerate("ab") for i in range(60)]
    sales = spark.createDataFrame(data, SALES)
    prices = spark.createDataFrame(
        [("s", k, day(0), 5.0, False) for k in "ab"],
        "store_id string, sku_id string, week_start long, price double, is_promo boolean",
    )
    return sales, gold.add_prices(sales, prices), gold.add_prices(gold.add_demand_history(sales), prices)


def test_clean_audit(tables):
    sales, priced, master = tables
    result = audit.audit_master(master, sales, priced)
    assert result.count() == 19
    assert {r["sample_size_checked"] for r in result.collect()} == {120}
    audit.require_clean_audit(result)


def test_injected_leak_is_named(tables):
    sales, priced, master = tables
    leaky = master.withColumn("lag_7_units", F.col("units_sold"))
    with pytest.raises(ValueError, match="lag_7_units"):
        audit.require_clean_audit(audit.audit_master(leaky, sales, priced))


def test_sample_bounds_the_check(tables):
    sales, priced, master = tables
    result = audit.audit_master(master, sales, priced, sample_size=10)
    assert {r["sample_size_checked"] for r in result.collect()} == {10}


def test_target_leakage(spark):
    df = spark.createDataFrame(
        [(i, 2.0 * i, (i * 7) % 5, 1.0, None) for i in range(40)],
        "label_units_sold long, leaky double, clean long, constant double, empty double",
    )
    with pytest.raises(ValueError, match="leaky"):
        audit.require_no_target_leakage(df, ["leaky", "clean", "constant", "empty"])
    audit.require_no_target_leakage(df, ["clean", "constant", "empty"])


def fold(spark, start, n, null_from=None):
    data = [(day(start + i), None if null_from is not None and i >= null_from else 1.0) for i in range(n)]
    return spark.createDataFrame(data, "date long, x double")


def test_fold_leakage(spark):
    audit.require_no_fold_leakage(fold(spark, 0, 20), fold(spark, 20, 5), ["x"])
    with pytest.raises(ValueError, match="overlap"):
        audit.require_no_fold_leakage(fold(spark, 0, 21), fold(spark, 20, 5), ["x"])
    with pytest.raises(ValueError, match="x"):
        audit.require_no_fold_leakage(fold(spark, 0, 20, null_from=16), fold(spark, 20, 5), ["x"])


def test_feature_columns_and_model_frame(spark):
    df = spark.createDataFrame(
        [("s", "a", day(0), 1, 2.0, True, 2025)],
        "store_id string, sku_id string, date long, label_units_sold long, revenue double, is_on_promo boolean, year int",
    )
    assert audit.feature_columns(df) == (["store_id", "sku_id", "is_on_promo"], ["store_id", "sku_id"])
    present = [("store_id", True, 1), ("sku_id", True, 1), ("is_on_promo", False, 1)]
    assert [tuple(r) for r in audit.feature_summary(df).collect()] == present
    typed = dict(audit.model_frame(df).dtypes)
    assert typed["date"] == "timestamp" and typed["is_on_promo"] == "double"
    with pytest.raises(ValueError, match="note"):
        audit.model_frame(df.withColumn("note", F.lit("x")))
