"""Walk-forward folds, scores and model comparison."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions.dates import as_date
from shelfcast.functions.errors import EPSILON, SCORES, score_columns
from shelfcast.operators.forecast import all_baselines
from shelfcast.operators.audit import LABEL
from shelfcast.sources.schemas import SERIES_DAY

# Fixed value: the moving-average WAPE that learned models are compared with.
BAR_WAPE = 0.650


class Fold(NamedTuple):
    fold_id: int
    train_start: int
    train_end: int
    val_start: int
    val_end: int


def _positive(**values: int) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


def walk_forward_folds(df: DataFrame, n_folds: int, horizon: int, min_train: int) -> DataFrame:
    """Expanding folds over the distinct dates: the last n_folds * horizon dates are consecutive
    validation blocks. Too few dates stop the job.

    The unpartitioned windows run over distinct dates, that is one row per day on record.
    """
    _positive(n_folds=n_folds, horizon_days=horizon, min_train_days=min_train)
    in_order = Window.orderBy("date")
    days = (
        df.select("date")
        .distinct()
        .withColumn("n", F.count("*").over(Window.partitionBy()))
        .withColumn("pos", F.row_number().over(in_order))
        .withColumn("previous", F.lag("date").over(in_order))
        .withColumn("first", F.min("date").over(Window.partitionBy()))
    )
    start = F.col("n") - F.lit(n_folds * horizon)
    block = F.floor((F.col("pos") - start - 1) / F.lit(horizon)).cast("int") + 1
    short = F.raise_error(F.lit("not enough dates for requested walk-forward split")).cast("int")
    fold = F.when(F.col("n") < F.lit(min_train + n_folds * horizon), short).otherwise(block)
    return (
        days.withColumn("fold_id", fold)
        .filter(F.col("fold_id") >= 1)
        .groupBy("fold_id")
        .agg(
            F.min("first").alias("train_start"),
            F.min("previous").alias("train_end"),
            F.min("date").alias("val_start"),
            F.max("date").alias("val_end"),
        )
    )


def last_days_holdout(df: DataFrame, days: int) -> DataFrame:
    """One fold whose validation block is the last `days` dates."""
    _positive(holdout_days=days)
    return walk_forward_folds(df, 1, days, 1).drop("fold_id")


def fold_list(folds: DataFrame) -> list[Fold]:
    """Fold bounds on the driver (n_folds rows), so that range filters are literals; over a written
    table they reach the scan and prune partitions."""
    rows = folds.orderBy("fold_id").collect()
    return [Fold(*[int(r[c]) for c in Fold._fields]) for r in rows]


def between_days(df: DataFrame, start: int, end: int) -> DataFrame:
    """Inclusive date range. A known year outside the range prunes year folders; rows without a year
    (dates that the calendar lacks) stay."""
    out = df.filter(F.col("date").between(start, end))
    if "year" in df.columns:
        years = F.col("year").between(F.year(as_date(F.lit(start))), F.year(as_date(F.lit(end))))
        out = out.filter(years | F.col("year").isNull())
    return out


def _within(fold: Column, lo: str, hi: str) -> Column:
    return (F.col("date") >= fold[lo]) & (F.col("date") <= fold[hi])


def fold_array(folds: list[Fold]) -> Column:
    return F.array(
        *[F.struct(*[F.lit(v).alias(n) for n, v in zip(Fold._fields, f, strict=True)]) for f in folds]
    )


def label_folds(df: DataFrame, folds: list[Fold]) -> DataFrame:
    """One row per (row, fold it belongs to) with `fold_id` and `side` train or val. Matching folds
    are picked from a literal array, so no range join is needed."""
    hits = F.filter(
        fold_array(folds), lambda f: _within(f, "train_start", "train_end") | _within(f, "val_start", "val_end")
    )
    side = F.when(_within(F.col("_fold"), "val_start", "val_end"), "val").otherwise("train")
    return (
        df.withColumn("_fold", F.explode(hits))
        .withColumns({"fold_id": F.col("_fold.fold_id"), "side": side})
        .drop("_fold")
    )


def with_actuals(actuals: DataFrame, forecasts: DataFrame, label: str = LABEL) -> DataFrame:
    """Actuals joined to forecasts on the key."""
    extra = [c for c in ("category",) if c in actuals.columns]
    keyed = actuals.select(*SERIES_DAY, F.col(label).cast("double").alias("y_true"), *extra)
    return keyed.join(forecasts.select(*SERIES_DAY, "y_pred"), SERIES_DAY, "inner")


def score(df: DataFrame) -> DataFrame:
    """All five scores in one row."""
    return df.agg(*score_columns())


def segment_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """All five scores per segment in one aggregate; a null segment is a segment."""
    return df.groupBy(*by).agg(*score_columns())


def top_segment_scores(df: DataFrame, by: str, n: int = 5) -> DataFrame:
    """Scores of the n segments with the largest actual demand: one aggregate, then a top-k."""
    totals = df.groupBy(by).agg(F.sum("y_true").alias("total_actual"), *score_columns())
    return totals.orderBy(F.col("total_actual").desc(), F.col(by).asc()).limit(n)


def training_days(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Label sum and count per date: what folds and fallbacks need, one row per day."""
    return df.groupBy("date").agg(
        F.sum(F.col(label).cast("double")).alias("label_sum"),
        F.count(label).alias("label_count"),
        F.count("*").alias("n_rows"),
    )


def fold_fallbacks(days: DataFrame, folds: list[Fold]) -> DataFrame:
    """Per fold: mean training label (0.0 without one) and number of training rows."""
    hit = F.filter(fold_array(folds), lambda f: _within(f, "train_start", "train_end"))
    mean = F.sum("label_sum") / F.nullif(F.sum("label_count"), F.lit(0))
    return (
        days.withColumn("fold_id", F.explode(F.transform(hit, lambda f: f["fold_id"])))
        .groupBy("fold_id")
        .agg(F.coalesce(mean, F.lit(0.0)).alias("fallback"), F.sum("n_rows").alias("n_train_rows"))
    )


def score_baselines(features: DataFrame, days: DataFrame, folds: list[Fold]) -> DataFrame:
    """Validation rows of every fold scored by every baseline, long: one row per model.

    Only rows of the validation range are scored; `features` computed on the fly still read the
    history behind their windows. Fallbacks come from the per-day totals and are joined by broadcast
    (one row per fold).
    """
    val = between_days(features, folds[0].val_start, folds[-1].val_end)
    hit = F.filter(fold_array(folds), lambda f: _within(f, "val_start", "val_end"))
    rows = val.withColumn("fold_id", F.explode(F.transform(hit, lambda f: f["fold_id"])))
    joined = rows.join(F.broadcast(fold_fallbacks(days, folds)), "fold_id")
    return joined.select(
        "fold_id",
        *SERIES_DAY,
        F.col(LABEL).cast("double").alias("y_true"),
        F.inline(all_baselines(F.col("fallback"))),
    )


def mean_over_folds(per_fold: DataFrame) -> DataFrame:
    """Mean score per model over its folds, best WAPE first (one row per model)."""
    out = per_fold.groupBy("model").agg(*[F.avg(s).alias(s) for s in SCORES])
    return out.orderBy("wape", "model")


def compare_models(runs: DataFrame) -> DataFrame:
    """Mean per (model, fold), then per model; relative gain on the bar and dense rank by WAPE.
    The ranking window spans one row per model."""
    per_fold = runs.groupBy("model", "fold_id").agg(*[F.avg(s).alias(s) for s in SCORES])
    summary = per_fold.groupBy("model").agg(*[F.avg(s).alias(s) for s in SCORES])
    return summary.withColumns(
        {
            "delta_wape_vs_baseline": (F.lit(BAR_WAPE) - F.col("wape")) / F.lit(BAR_WAPE),
            "rank": F.dense_rank().over(Window.orderBy("wape")),
        }
    ).orderBy("rank", "wape", "model")


MODULUS = (1 << 31) - 1


def poisson_steps(modulus: int = MODULUS) -> list[int]:
    """The smallest of `modulus` equally likely draws that stand for 1, 2, 3, ... under Poisson(1).
    The list ends where no draw is left, so weights have no other bound."""
    steps, term, total = [], math.exp(-1), 0.0
    while (step := math.ceil((total := total + term) * modulus)) < modulus:
        steps.append(step)
        term /= len(steps)
    return steps


def bootstrap_wape_difference(
    df: DataFrame, key: list[str], a: str, b: str, n: int = 1000, seed: int = 42, y: str = "y_true"
) -> DataFrame:
    """Bootstrap of WAPE(a) - WAPE(b): mean, 95 % interval, share of differences >= 0.

    Each row draws a Poisson(1) weight per replicate by whole-number arithmetic on a hash of its
    key: a repeated task draws the same weights, and so does any engine with MD5. Replicates are
    summed map-side: the shuffle carries n rows per task. Weights of 0 are left out before the sums.
    """
    actual = F.col(y).cast("double")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    rows = df.select(
        F.conv(F.substring(digest, 1, 7), 16, 10).cast("long").alias("_start"),
        F.conv(F.substring(digest, 8, 7), 16, 10).cast("long").alias("_stride"),
        F.abs(actual).alias("_y"),
        F.abs(F.col(a) - actual).alias("_a"),
        F.abs(F.col(b) - actual).alias("_b"),
    )
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))
    m = F.lit(MODULUS)
    x = (F.col("_start") + F.col("rep") * (F.col("_stride") + 1)) % m
    fourth = ((x * x) % m) * ((x * x) % m) % m
    draw = fourth * x % m  # fifth powers permute the residues of this prime
    weight = sum(((draw >= F.lit(step)).cast("int") for step in poisson_steps()), F.lit(0))
    weighted = reps.withColumn("w", weight).filter(F.col("w") > 0)
    sums = weighted.groupBy("rep").agg(
        *[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("_y", "_a", "_b")]
    )
    diff = (F.col("_a") - F.col("_b")) / F.greatest(F.col("_y"), F.lit(EPSILON))
    return sums.select(diff.alias("d")).agg(
        F.avg("d").alias("mean_diff"),
        F.percentile("d", F.lit(0.025)).alias("ci_lower_95"),
        F.percentile("d", F.lit(0.975)).alias("ci_upper_95"),
        F.avg((F.col("d") >= 0).cast("double")).alias("p_value_a_better_than_b"),
    )
