"""Walk-forward experiments over the feature table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.errors import score_columns
from shelfcast.operators import audit, evaluate, forecast, segments
from shelfcast.operators.audit import LABEL
from shelfcast.session import freeze, saved
from shelfcast.sources.schemas import SERIES_DAY


def fold_context(
    labels: DataFrame, n_folds: int, horizon: int, min_train: int
) -> tuple[DataFrame, list[evaluate.Fold]]:
    """Per-day label totals (one row per day, written once) and the fold bounds."""
    days = freeze(evaluate.training_days(labels))
    folds = evaluate.fold_list(evaluate.walk_forward_folds(days, n_folds, horizon, min_train))
    return days, folds


def run_baselines(
    features: DataFrame, n_folds: int = 3, horizon: int = 28, min_train: int = 365
) -> tuple[DataFrame, DataFrame]:
    """Scores per (model, fold) and their mean per model, best first. All models and folds are
    scored in one pass over the validation range."""
    days, folds = fold_context(features, n_folds, horizon, min_train)
    scored = evaluate.score_baselines(features, days, folds)
    per_fold = scored.groupBy("model", "fold_id").agg(*score_columns(), F.count("*").alias("n_val_rows"))
    return per_fold, evaluate.mean_over_folds(per_fold)


#: Folds that are fitted at a time.
PARALLEL_FOLDS = 4


class LearnedRun(NamedTuple):
    """Scores per fold and model, the scored validation rows of all folds, and the segment log."""

    per_fold: DataFrame
    scored: DataFrame
    segments: DataFrame


def run_learned(
    features: DataFrame,
    n_folds: int = 3,
    horizon: int = 14,
    min_train: int = 180,
    null_tolerance: float = 0.05,
    **params,
) -> LearnedRun:
    """Boosted trees and a Poisson regression per fold behind the leakage guards: scores per model and
    fold with the gain on the baseline bar and, for the trees, the features' importances; the scored
    validation rows; and the scores of segments within each fold.

    The driver loops over folds only; every fit and every score is a distributed job.
    """
    columns, categorical = audit.feature_columns(features)
    audit.require_no_target_leakage(features, columns)
    _, folds = fold_context(features, n_folds, horizon, min_train)
    keep = [c for c in ("category", "store_type") if c in features.columns]
    numbered = saved(forecast.number_categories(features, categorical), "numbered")

    def run_fold(fold: evaluate.Fold) -> tuple[DataFrame, list, DataFrame]:
        train = evaluate.between_days(numbered, fold.train_start, fold.train_end)
        val = evaluate.between_days(numbered, fold.val_start, fold.val_end)
        audit.require_no_fold_leakage(train, val, columns, null_tolerance)
        both = evaluate.between_days(numbered, fold.train_start, fold.val_end)
        encoded, names = forecast.encode_categories(both, columns, categorical, fold.train_end)
        encoded = saved(encoded, "fold")
        own_train, own_val = encoded.filter(F.col("date") <= fold.train_end), encoded.filter(F.col("date") >= fold.val_start)
        models = {
            "boosted_trees": forecast.fit_boosted_trees(own_train, own_val, names, **params),
            "poisson": forecast.fit_poisson(own_train, names),
        }
        scored = [
            forecast.predict_learned(model, own_val, names).select(
                F.lit(name).alias("model"),
                F.lit(fold.fold_id).alias("fold_id"),
                *SERIES_DAY,
                *keep,
                F.col(LABEL).cast("double").alias("y_true"),
                "y_pred",
            )
            for name, model in models.items()
        ]
        return scored[0].unionByName(scored[1]), models["boosted_trees"].importances(), train

    # a fold is a chain of short jobs: folds side by side keep the cluster busy
    with ThreadPoolExecutor(min(len(folds), PARALLEL_FOLDS)) as pool:
        runs = list(pool.map(run_fold, folds))
    scored_all = reduce(DataFrame.unionByName, [scored for scored, _, _ in runs])
    gains = [(f.fold_id, "boosted_trees", gain) for f, (_, gain, _) in zip(folds, runs)]
    trains = {f.fold_id: train for f, (_, _, train) in zip(folds, runs)}
    scored_all = saved(scored_all, "scored")
    gained = features.sparkSession.createDataFrame(
        gains, "fold_id int, model string, importances array<struct<feature: string, gain: double>>"
    )
    bar = F.lit(evaluate.BAR_WAPE)
    per_fold = (
        scored_all.groupBy("model", "fold_id")
        .agg(*score_columns())
        .withColumn("delta_wape_vs_moving_average", (bar - F.col("wape")) / bar)
        .join(gained, ["fold_id", "model"], "left")
    )
    return LearnedRun(per_fold, scored_all, segments.fold_segment_log(scored_all, trains))
