import math

import numpy as np
import pytest
from helpers import day, rows
from pyspark.sql import functions as F

from shelfcast.operators import evaluate, forecast
from shelfcast.plans import experiments

PAIRS = "y_true double, y_pred double"


def test_scores(spark):
    row = evaluate.score(spark.createDataFrame([(10.0, 12.0), (20.0, 18.0), (30.0, 33.0)], PAIRS)).first()
    assert math.isclose(row.mae, 7 / 3) and math.isclose(row.rmse, math.sqrt(17 / 3))
    assert math.isclose(row.wape, 7 / 60) and math.isclose(row.bias, 3 / 60)
    assert math.isclose(row.smape, np.mean([2 / 11, 2 / 19, 3 / 31.5]))


def test_scores_guard_zero_and_empty(spark):
    assert all(v == 0.0 for v in evaluate.score(spark.createDataFrame([(0.0, 0.0)], PAIRS)).first())
    assert all(v == 0.0 for v in evaluate.score(spark.createDataFrame([], PAIRS)).first())


def test_segments_keep_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), (None, 4.0, 1.0)], "seg string, " + PAIRS)
    got = {r["seg"]: r["mae"] for r in evaluate.segment_scores(df, ["seg"]).collect()}
    assert got == {"a": 1.0, None: 3.0}


def test_walk_forward(spark):
    dates = spark.createDataFrame([(day(i),) for i in range(500) for _ in range(2)], "date long")
    folds = evaluate.fold_list(evaluate.walk_forward_folds(dates, 3, 28, 365))
    assert [f.fold_id for f in folds] == [1, 2, 3]
    for i, f in enumerate(folds):
        assert f.train_start == day(0) and f.val_start == day(416 + 28 * i)
        assert f.val_end == day(416 + 28 * i + 27) and f.train_end == day(415 + 28 * i)


def test_walk_forward_rejects(spark):
    dates = spark.createDataFrame([(day(i),) for i in range(100)], "date long")
    for bad in ((0, 28, 10), (1, 0, 10), (1, 28, 0)):
        with pytest.raises(ValueError):
            evaluate.walk_forward_folds(dates, *bad)
    with pytest.raises(Exception, match="not enough dates"):
        evaluate.walk_forward_folds(dates, 3, 28, 365).collect()


def test_holdout(spark):
    dates = spark.createDataFrame([(day(i, "2026-01-01"),) for i in range(40)], "date long")
    row = evaluate.last_days_holdout(dates, 7).first()
    assert row.val_start == day(33, "2026-01-01") and row.val_end == day(39, "2026-01-01")


def test_label_folds(spark):
    df = spark.createDataFrame([(day(i),) for i in range(10)], "date long")
    folds = evaluate.fold_list(evaluate.walk_forward_folds(df, 2, 2, 3))
    got = evaluate.label_folds(df, folds).groupBy("fold_id", "side").count()
    assert set(rows(got)) == {(1, "train", 6), (1, "val", 2), (2, "train", 8), (2, "val", 2)}


@pytest.fixture(scope="module")
def panel(spark):
    data = [
        (s, k, day(i), (i * 3 + len(k) + ord(k)) % 9, float(i % 4) if i else None, 2.0, 3.0)
        for s in ("s1", "s2")
        for k in ("a", "b", "c")
        for i in range(90)
    ]
    return spark.createDataFrame(
        data,
        "store_id string, sku_id string, date long, label_units_sold long, lag_1_units double, "
        "lag_7_units double, rolling_mean_28 double",
    )


def test_baseline_folds_equal_numpy(panel):
    per_fold, comparison = experiments.run_baselines(panel, 3, 10, 30)
    pdf = panel.toPandas()
    got = {(r.model, r.fold_id): r for r in per_fold.collect()}
    assert len(got) == 9
    for fold in (1, 2, 3):
        lo, hi = day(60 + 10 * (fold - 1)), day(60 + 10 * fold - 1)
        val = pdf[(pdf.date >= lo) & (pdf.date <= hi)]
        for model, column in (("naive", "lag_1_units"), ("seasonal_naive", "lag_7_units")):
            err = (val[column] - val.label_units_sold).abs().sum() / val.label_units_sold.sum()
            assert math.isclose(got[model, fold].wape, err)
    ranked = comparison.collect()
    assert [r.wape for r in ranked] == sorted(r.wape for r in ranked)


def test_predict_falls_back_to_training_mean(panel):
    fallback = forecast.fit_fallback(panel)
    out = forecast.predict(panel, "naive", fallback, ordered=True)
    first = out.filter(F.col("date") == day(0)).first()
    assert math.isclose(first.y_pred, panel.agg(F.avg("label_units_sold")).first()[0])
    empty = forecast.fit_fallback(panel.limit(0))
    assert forecast.predict(panel, "naive", empty).filter(F.col("date") == day(0)).first().y_pred == 0.0
    with pytest.raises(ValueError):
        forecast.predict(panel, "oracle", 0.0)


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(y), float(y + rng.normal()), float(y + 3 * rng.normal())) for i, y in enumerate(rng.poisson(20, 300))]
    df = spark.createDataFrame(data, "k long, y_true double, a double, b double")
    equal = evaluate.bootstrap_wape_difference(df, ["k"], "a", "a", n=50).first()
    assert equal.mean_diff == 0.0 and equal.ci_lower_95 <= 0.0 <= equal.ci_upper_95
    better = evaluate.bootstrap_wape_difference(df, ["k"], "a", "b", n=200).first()
    assert better.ci_lower_95 < better.mean_diff < better.ci_upper_95 < 0
    assert better.p_value_a_better_than_b == 0.0
    y = np.array([d[1] for d in data])
    point = (np.abs(y - [d[2] for d in data]).sum() - np.abs(y - [d[3] for d in data]).sum()) / y.sum()
    assert abs(better.mean_diff - point) < 0.01
    again = evaluate.bootstrap_wape_difference(df.repartition(5), ["k"], "a", "b", n=200).first()
    assert math.isclose(again.mean_diff, better.mean_diff)


def test_compare_models(spark):
    ddl = "model string, fold_id int, mae double, rmse double, wape double, smape double, bias double"
    runs = spark.createDataFrame(
        [("a", 1, 1.0, 1.0, 0.5, 1.0, 0.0), ("a", 1, 1.0, 1.0, 0.7, 1.0, 0.0), ("a", 2, 1.0, 1.0, 0.2, 1.0, 0.0),
         ("b", 1, 1.0, 1.0, 0.65, 1.0, 0.0)],
        ddl,
    )
    got = rows(evaluate.compare_models(runs).select("model", "wape", "delta_wape_vs_baseline", "rank"))
    assert got[0][0] == "a" and math.isclose(got[0][1], 0.4) and math.isclose(got[0][2], 0.25 / 0.65) and got[0][3] == 1
    assert got[1][0] == "b" and abs(got[1][2]) < 1e-12 and got[1][3] == 2


def test_learned_models_never_predict_below_zero(panel):
    numbered = forecast.number_categories(panel, ["store_id", "sku_id"])
    encoded, features = forecast.encode_categories(numbered, ["store_id", "sku_id", "lag_1_units", "lag_7_units"], ["store_id", "sku_id"], day(69))
    assert features == ["mean_of_number_of_store_id", "mean_of_number_of_sku_id", "lag_1_units", "lag_7_units"]
    train, val = encoded.filter(F.col("date") < day(70)), encoded.filter(F.col("date") >= day(70))
    model = forecast.fit_boosted_trees(train, val, features, max_iter=2, max_depth=2)
    out = forecast.predict_learned(model, val, features)
    assert out.agg(F.min("y_pred")).first()[0] >= 0.0 and out.count() == val.count()
    assert len(model.importances()) == 4
    poisson = forecast.fit_poisson(train, features)
    assert forecast.predict_learned(poisson, val, features).agg(F.min("y_pred")).first()[0] > 0.0


def test_poisson_steps_give_mean_and_variance_one():
    steps = evaluate.poisson_steps()
    edges = [0, *steps, evaluate.MODULUS]
    shares = [(hi - lo) / evaluate.MODULUS for lo, hi in zip(edges, edges[1:])]
    mean = sum(k * p for k, p in enumerate(shares))
    assert mean == pytest.approx(1, abs=1e-7)
    assert sum((k - mean) ** 2 * p for k, p in enumerate(shares)) == pytest.approx(1, abs=1e-6)
