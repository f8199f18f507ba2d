import math

import pytest
from helpers import DAY, day, ns, rows

from shelfcast.operators import segments

SALES = "store_id string, sku_id string, date long, units_sold long"


def test_volume_tiers(spark):
    totals = [20, 15, 15, 10, 10, 10, 5, 5, 5, 5]
    data = [("s", f"k{i}", day(0), t) for i, t in enumerate(totals)]
    got = segments.volume_tiers(spark.createDataFrame(data, SALES)).orderBy("sku_id").collect()
    assert [r.volume_tier[0] for r in got] == list("ABBCCCCCCC")
    assert math.isclose(got[1].cumulative_volume_share, 0.35)


def test_volume_tiers_without_volume(spark):
    got = segments.volume_tiers(spark.createDataFrame([("s", "a", day(0), 0)], SALES)).first()
    assert got.volume_tier == "C_bottom50pct" and got.volume_share == 0.0


def test_intermittency(spark):
    patterns = {
        "smooth": [5, 5, 6, 5],
        "intermittent": [4, 0, 0, 4, 0, 0],
        "lumpy": [1, 0, 0, 30, 0, 0],
        "erratic": [1, 1, 30, 1],
        "none": [0, 0],
    }
    data = [("s", k, day(i), u) for k, units in patterns.items() for i, u in enumerate(units)]
    got = {r.sku_id: r for r in segments.intermittency_classes(spark.createDataFrame(data, SALES)).collect()}
    for name in ("smooth", "intermittent", "lumpy", "erratic"):
        assert got[name].intermittency_class == name
    assert got["intermittent"].adi == 3.0
    assert got["none"].intermittency_class == "lumpy" and math.isinf(got["none"].adi)


def test_promo_days(spark):
    monday = ns("2026-01-05")
    preds = spark.createDataFrame([("s", "a", monday + d * DAY) for d in (-1, 0, 6)], "store_id string, sku_id string, date long")
    prices = spark.createDataFrame([("s", "a", monday, True)], "store_id string, sku_id string, week_start long, is_promo boolean")
    want = [(monday - DAY, False), (monday, True), (monday + 6 * DAY, True)]
    assert sorted(rows(segments.with_promo_day(preds, prices).select("date", "is_promo_day"))) == want
    dated = prices.selectExpr("store_id", "sku_id", f"week_start + {2 * DAY} as date", "is_promo")
    assert sorted(rows(segments.with_promo_day(preds, dated).select("date", "is_promo_day"))) == want


def test_segment_report(spark):
    df = spark.createDataFrame(
        [("A", 10.0, 12.0), ("B", 10.0, 5.0), (None, 1.0, 1.0)], "segment string, y_true double, y_pred double"
    )
    got = {r.segment: r for r in segments.segment_report(df, ["segment"]).collect()}
    assert got["A"].mae == 2 and math.isclose(got["A"].wape, 0.2) and math.isclose(got["A"].smape, 2 / 11)
    assert got["A"].bias == 2 and got["B"].bias == -5 and got[None].n_rows == 1


def test_bias_flags(spark):
    report = spark.createDataFrame(
        [("over", 10.0, 3.0), ("fine", 10.0, 0.5), ("zero", 0.0, 3.0), ("under", 10.0, -4.0)],
        "segment string, mean_actual double, bias double",
    )
    got = rows(segments.bias_flags(report).select("segment", "bias_ratio", "bias_direction"))
    assert got == [("under", -0.4, "under"), ("over", 0.3, "over")]


def test_best_and_worst(spark):
    data = [("s", f"sku_{i}", "c", day(d), 10.0, 10.0 + i) for i in range(6) for d in range(3)]
    data.append(("s", "tiny", "c", day(0), 1.0, 99.0))
    df = spark.createDataFrame(data, "store_id string, sku_id string, category string, date long, y_true double, y_pred double")
    best, worst = segments.best_and_worst(df, n=2)
    assert [r.sku_id for r in best.collect()] == ["sku_0", "sku_1"]
    assert [r.sku_id for r in worst.collect()] == ["sku_5", "sku_4"]
    assert best.first().n_days == 3


@pytest.mark.parametrize(
    ("volumes", "want"),
    [([1, 2, 3, 4, 5, 6], ["low", "low", "medium", "medium", "high", "high"]), ([5, 5, 5, 5, 5, 9], ["medium"] * 6)],
)
def test_train_volume_tiers(spark, volumes, want):
    df = spark.createDataFrame([("s", f"k{i}", v) for i, v in enumerate(volumes)], "store_id string, sku_id string, label_units_sold long")
    got = segments.train_volume_tiers(df).orderBy("sku_id").collect()
    assert [r.volume_tier for r in got] == want


def test_heatmap(spark):
    df = spark.createDataFrame([("s1", "x", 0.1), ("s1", "y", 0.2), ("s2", "y", 0.3)], "store_id string, c string, wape double")
    assert sorted(rows(segments.heatmap(df, "c", "store_id", ["x", "y"]))) == [("s1", 0.1, 0.2), ("s2", None, 0.3)]


def test_report_set_and_enrich(spark):
    preds = spark.createDataFrame(
        [("s", f"k{i}", day(d), 5.0 + i, 6.0) for i in range(3) for d in range(4)],
        "store_id string, sku_id string, date long, y_true double, y_pred double",
    )
    products = spark.createDataFrame([("k0", "c0", "x"), ("k1", "c1", "x"), ("k2", None, "x")], "sku_id string, category string, subcategory string")
    stores = spark.createDataFrame([("s", "r", "st", "A")], "store_id string, region string, state string, store_type string")
    sales = preds.selectExpr("store_id", "sku_id", "date", "cast(y_true as long) as units_sold")
    rich = segments.enrich(preds, products, stores, sales, None)
    assert rich.count() == 12 and not rich.filter("is_promo_day").count()
    report = segments.report_set(rich, top_categories=1)
    got = {r.report: r["count"] for r in report.groupBy("report").count().collect()}
    assert got == {"category": 1, "store_category": 3, "volume_promo": rich.select("volume_tier").distinct().count(), "intermittency": 1}


def test_segment_log(spark):
    scored = spark.createDataFrame(
        [("s", f"k{i}", f"c{i}", "A", 5.0 + i, 6.0) for i in range(7)],
        "store_id string, sku_id string, category string, store_type string, y_true double, y_pred double",
    )
    train = scored.selectExpr("store_id", "sku_id", "cast(y_true as long) as label_units_sold")
    got = segments.segment_metric_log(scored, train).filter("metric = 'wape'")
    kinds = {r.segment: r["count"] for r in got.groupBy("segment").count().collect()}
    assert kinds == {"category": 5, "store_type": 1, "volume_tier": 3}
    assert {r.value for r in got.filter("segment = 'category'").collect()} == {f"c{i}" for i in range(2, 7)}


def test_heatmap_finds_its_columns(spark):
    report = spark.createDataFrame([("c1", t, float(i)) for i, t in enumerate(["A", "B", "C", "D", None])] + [("c2", "D", 9.0)], "category string, store_type string, wape double")
    got = segments.heatmap(report, "store_type", "category")
    assert got.columns == ["category", "A", "B", "C", "D", "null"]
    assert sorted(map(tuple, got.collect())) == [("c1", 0.0, 1.0, 2.0, 3.0, 4.0), ("c2", None, None, None, 9.0, None)]
    assert segments.heatmap(report, "store_type", "category", ["D"]).columns == ["category", "D"]
    with pytest.raises(ValueError, match="more than 3"):
        segments.heatmap(report, "store_type", "category", most=3)
    assert segments.heatmap(report.limit(0), "store_type", "category").count() == 0
