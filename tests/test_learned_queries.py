"""The learned queries fit both learners with the operator's own rounds and depth."""

from helpers import day
from pyspark.sql import functions as F

from shelfcast.operators import boosting, forecast
from shelfcast.plans import catalog, experiments
from shelfcast.sources.driver_tables import DriverTables


def test_learned_queries_fit_the_operators_own_rounds(spark, monkeypatch):
    """The trees behind the learned queries, counted: as many as the operator's defaults allow."""
    fitted = []
    fit = boosting.fit_boosted_counts
    monkeypatch.setattr(forecast, "fit_boosted_counts", lambda *a, **given: fitted.append(fit(*a, **given)) or fitted[-1])
    rows = [
        (f"s{s}", f"k{k}", day(d), (d * 5 + s * 3 + k) % 11, float((d * 7 + s) % 11), float(d % 5))
        for s in range(2)
        for k in range(3)
        for d in range(700)
    ]
    ddl = "store_id string, sku_id string, date long, label_units_sold long, lag_1_units double, price double"
    frame = spark.createDataFrame(rows, ddl)
    monkeypatch.setattr(catalog, "_model_rows", lambda t: frame)
    monkeypatch.setattr(catalog, "N_FOLDS", 1)
    run = catalog.learned(DriverTables(spark, "/nowhere"))
    assert run.per_fold.count() == 2
    assert len(fitted) == 1 and len(fitted[0].valid_deviance) == 41
    assert max(t.feature.count(-1) for t in fitted[0].trees) > 16  # deeper than four levels


def test_folds_score_both_learners_with_importances(spark):
    rows = [
        (f"s{s}", f"k{k}", day(d), 5 + (d + s + k) % 7, float((d + s) % 7), float(d % 5))
        for s in range(2)
        for k in range(3)
        for d in range(60)
    ]
    ddl = "store_id string, sku_id string, date long, label_units_sold long, lag_1_units double, price double"
    frame = spark.createDataFrame(rows, ddl)
    per_fold, scored, _ = experiments.run_learned(frame, n_folds=2, horizon=7, min_train=30, max_iter=3, max_depth=2)
    found = {(r.fold_id, r.model): r for r in per_fold.collect()}
    assert set(found) == {(f, m) for f in (1, 2) for m in ("boosted_trees", "poisson")}
    for (_, model), r in found.items():
        gains = {x.feature: x.gain for x in r.importances or []}
        assert bool(gains) == (model == "boosted_trees")
        assert not gains or abs(sum(gains.values()) - 1) < 1e-9
    assert scored.groupBy("model").agg(F.count("*").alias("n")).filter("n <> 84").count() == 0
    assert scored.filter("y_pred < 0").count() == 0
