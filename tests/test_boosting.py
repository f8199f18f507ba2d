"""Boosted counts and category statistics next to plain numpy and plain loops."""

import math

import numpy as np
import pytest
from helpers import day
from pyspark.sql import functions as F

from shelfcast.operators import boosting, forecast, labels
from shelfcast.plans import experiments

DDL = "store_id string, sku_id string, date long, label_units_sold long, a double, b double, c double"


def panel(spark, n=900, seed=5):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = draw.normal(), float(draw.integers(0, 5)), None if i % 7 == 0 else draw.uniform()
        mean = math.exp(0.5 + 0.8 * a + (1.0 if b > 2 else 0.0) - (c or 0.3))
        rows.append((f"s{i % 3}", f"k{i % 11}", day(i // 33), int(draw.poisson(mean)), a, b, c))
    return spark.createDataFrame(rows, DDL)


def plain_split(x, edges, g, h, l2, least):
    """(gain, feature, threshold bin, missing left) by loops over all rows, features and cuts."""
    bins = np.zeros(x.shape, int)
    for f in range(x.shape[1]):
        for i, v in enumerate(x[:, f]):
            bins[i, f] = 0 if math.isnan(v) else 1 + sum(e < v for e in edges[f])
    best = (1e-9, None, None, None)
    for missing_left in (True, False):
        for f in range(x.shape[1]):
            for cut in range(0 if missing_left else 1, 256):
                left = (bins[:, f] <= cut) & (missing_left | (bins[:, f] > 0))
                if min(left.sum(), (~left).sum()) < least:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + l2) + g[~left].sum() ** 2 / (h[~left].sum() + l2) - g.sum() ** 2 / (h.sum() + l2)
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut, missing_left)
    return best, bins


def test_first_trees_equal_a_plain_version(spark):
    frame = panel(spark, 400)
    model = boosting.fit_boosted_counts(
        frame, frame.limit(0), ["a", "b", "c"], "label_units_sold", max_iter=2, max_depth=2, row_share=1.0, feature_share=1.0,
        row_key=["store_id", "sku_id", "date"], max_bins=16,
    )
    rows = frame.collect()
    x = np.array([[float("nan") if v is None else v for v in (r.a, r.b, r.c)] for r in rows])
    y = np.array([float(r.label_units_sold) for r in rows])
    raw = np.full(len(y), math.log(y.mean()))
    assert len(model.trees) == 2
    for tree in model.trees:
        open_nodes = [(0, np.ones(len(y), bool))]
        mean = np.exp(raw)
        g, h, gained = np.rint((mean - y) * 2**20) / 2**20, np.rint(mean * 2**20) / 2**20, raw.copy()
        while open_nodes:
            node, own = open_nodes.pop(0)
            depth_left = tree.feature[node] >= 0
            (gain, f, cut, missing_left), bins = plain_split(x[own], model.edges, g[own], h[own], 1.0, 20)
            if not depth_left:
                assert tree.value[node] == pytest.approx(-0.1 * g[own].sum() / (h[own].sum() + 1.0), rel=1e-6)
                gained[own] += tree.value[node]
                continue
            assert (tree.feature[node], tree.threshold[node], tree.missing_left[node]) == (f, cut, missing_left)
            left = np.zeros(len(y), bool)
            left[own] = (bins[:, f] <= cut) & (missing_left | (bins[:, f] > 0))
            open_nodes += [(tree.left[node], left), (tree.right[node], own & ~left)]
        raw = gained
    scored = model.predict(frame).select("y_pred").collect()
    assert [r.y_pred for r in scored] == pytest.approx(np.exp(raw).tolist(), rel=1e-9)


def test_partitions_do_not_change_the_model(spark):
    frame, names = panel(spark), ["a", "b", "c"]
    train, valid = frame.filter(F.col("date") < day(20)), frame.filter(F.col("date") >= day(20))
    fits = [
        boosting.fit_boosted_counts(train.repartition(n), valid, names, "label_units_sold", max_iter=5, row_key=["store_id", "sku_id", "date"], rows_per_part=100)
        for n in (1, 5)
    ]
    assert fits[0].trees == fits[1].trees and fits[0].valid_deviance == pytest.approx(fits[1].valid_deviance)


def test_rounds_lower_the_validation_deviance_and_stop(spark):
    frame, names = panel(spark, 2000), ["a", "b", "c"]
    train, valid = frame.filter(F.col("date") < day(45)), frame.filter(F.col("date") >= day(45))
    model = forecast.fit_boosted_trees(train, valid, names, max_iter=15, step=0.2, max_depth=3, patience=5)
    seen = model.valid_deviance
    assert len(model.trees) == int(np.argmin(seen)) and seen[len(model.trees)] < 0.75 * seen[0]
    noise = train.withColumn("label_units_sold", F.pmod(F.xxhash64("a"), F.lit(4)))
    early = forecast.fit_boosted_trees(noise, valid.withColumn("label_units_sold", F.pmod(F.xxhash64("b", "a"), F.lit(4))), names, patience=3)
    assert len(early.trees) < 40
    assert abs(sum(gain for _, gain in model.importances()) - 1) < 1e-9


def test_odd_inputs(spark):
    frame, names = panel(spark, 60), ["a", "b", "c"]
    nothing = boosting.fit_boosted_counts(frame.limit(0), frame, names, "label_units_sold")
    zero = boosting.fit_boosted_counts(frame.withColumn("label_units_sold", F.lit(0)), frame, names, "label_units_sold")
    for model in (nothing, zero):
        assert not model.trees and model.predict(frame).filter("y_pred < 0 or y_pred is null").count() == 0
    blank = frame.withColumn("c", F.lit(None).cast("double")).withColumn("label_units_sold", F.when(F.col("b") > 1, F.col("label_units_sold")))
    assert boosting.fit_boosted_counts(blank, frame, names, "label_units_sold", max_iter=2).predict(blank).count() == 60
    with pytest.raises(ValueError, match="negative"):
        boosting.fit_boosted_counts(frame.withColumn("label_units_sold", F.lit(-1)), frame, names, "label_units_sold")


def test_thousands_of_labels_have_their_own_numbers(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("label-"), F.col("id") % 5000).alias("c")).union(spark.createDataFrame([(None,)], "c string"))
    index = labels.label_index(rows, "c")
    found = index.collect()
    assert [r.number for r in sorted(found, key=lambda r: r.label)] == list(range(5000))
    numbered = labels.with_label_number(rows, "c", index, "n")
    assert numbered.count() == 20_001 and numbered.select("n").distinct().count() == 5001
    assert numbered.filter("c is null and n is null").count() == 1


def test_target_means_look_back_only(spark):
    draw = np.random.default_rng(8)
    data = [(i, [None, "x", "y", "z"][draw.integers(0, 4)], day(int(draw.integers(0, 12))), int(draw.integers(0, 9))) for i in range(300)]
    data += [(900, "new", day(11), 3), (901, "x", day(2), None)]
    frame = spark.createDataFrame(data, "id long, c string, date long, y long")
    end = day(7)
    got = {r.id: r.mean_of_c for r in labels.ordered_target_means(frame, ["c"], "y", end).collect()}
    for i, c, at, _ in data:
        known = [(k, y) for _, k, d, y in data if y is not None and d <= end and (d < at or at > end)]
        prior = sum(y for _, y in known) / len(known) if known else 0.0
        own = [y for k, y in known if k == c]
        assert got[i] == pytest.approx((sum(own) + 10 * prior) / (len(own) + 10))
    # labels of validation rows are never read
    spoiled = frame.withColumn("y", F.when(F.col("date") > end, 1000).otherwise(F.col("y")))
    assert {r.id: r.mean_of_c for r in labels.ordered_target_means(spoiled, ["c"], "y", end).collect()} == pytest.approx(got)


def test_folds_log_their_segments(spark):
    rows = [
        (f"s{s}", f"k{k}", day(d), 5 + (d + s + k) % 7, float((d + s) % 7), float(d % 5), f"cat{k % 7}", "AB"[s])
        for s in range(2)
        for k in range(8)
        for d in range(60)
    ]
    ddl = "store_id string, sku_id string, date long, label_units_sold long, lag_1_units double, price double, category string, store_type string"
    run = experiments.run_learned(spark.createDataFrame(rows, ddl), n_folds=2, horizon=7, min_train=30, max_iter=2, max_depth=2)
    log = run.segments.collect()
    assert {(r.fold_id, r.model) for r in log} == {(f, m) for f in (1, 2) for m in ("boosted_trees", "poisson")}
    scored = run.scored.toPandas()
    for f in (1, 2):
        for m in ("boosted_trees", "poisson"):
            own = [r for r in log if (r.fold_id, r.model) == (f, m)]
            assert len({r.value for r in own if r.segment == "category"}) == 5
            assert {r.value for r in own if r.segment == "store_type"} == {"A", "B"}
            part = scored[(scored.fold_id == f) & (scored.model == m)]
            for r in own:
                if r.segment != "volume_tier" and r.metric == "mae":
                    rows_of = part[part[r.segment] == r.value]
                    assert r.score == pytest.approx((rows_of.y_pred - rows_of.y_true).abs().mean())
