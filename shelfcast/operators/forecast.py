"""Baseline and learned demand forecasters."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators import labels
from shelfcast.operators.audit import LABEL
from shelfcast.operators.boosting import BoostedCounts, fit_boosted_counts
from shelfcast.sources.schemas import SERIES_DAY

BASELINES = ("naive", "seasonal_naive", "moving_average")


def baseline_column(name: str, window: int = 28) -> Column:
    """The feature a baseline reads its forecast from."""
    columns = {
        "naive": "lag_1_units",
        "seasonal_naive": "lag_7_units",
        "moving_average": f"rolling_mean_{window}",
    }
    if name not in columns:
        raise ValueError(f"unknown baseline: {name}")
    return F.col(columns[name]).cast("double")


def fit_fallback(train: DataFrame, label: str = LABEL) -> Column:
    """Mean training label (0.0 without one) as a scalar subquery of the job that uses it."""
    return F.coalesce(train.agg(F.avg(label)).scalar(), F.lit(0.0))


def predict(
    future: DataFrame, name: str, fallback: Column | float, window: int = 28, ordered: bool = False
) -> DataFrame:
    """Key columns and y_pred; sorted only on request, since most readers do not need the order."""
    fallback = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    filled = F.coalesce(baseline_column(name, window), fallback).cast("double")
    out = future.select(*SERIES_DAY, filled.alias("y_pred"))
    return out.orderBy(*SERIES_DAY) if ordered else out


def all_baselines(fallback: Column) -> Column:
    """Array of (model, y_pred) structs: one pass scores every baseline."""
    return F.array(
        *[
            F.struct(F.lit(n).alias("model"), F.coalesce(baseline_column(n), fallback).alias("y_pred"))
            for n in BASELINES
        ]
    )


def number_of(column: str) -> str:
    return f"number_of_{column}"


def number_categories(df: DataFrame, categorical: list[str]) -> DataFrame:
    """Adds `number_of_<column>`: each label's own number, whatever their count."""
    for c in categorical:
        df = labels.with_label_number(df, c, labels.label_index(df, c), number_of(c))
    return df


def encode_categories(
    numbered: DataFrame, columns: list[str], categorical: list[str], train_end: int, label: str = LABEL
) -> tuple[DataFrame, list[str]]:
    """The frame and its feature columns, all numeric: a category enters as the mean label of its
    earlier training days."""
    out = labels.ordered_target_means(numbered, [number_of(c) for c in categorical], label, train_end)
    return out, [c if c not in categorical else f"mean_of_{number_of(c)}" for c in columns]


def fit_boosted_trees(train: DataFrame, valid: DataFrame, features: list[str], label: str = LABEL, **params) -> BoostedCounts:
    """Boosted trees on the Poisson objective that stop early on the validation rows."""
    return fit_boosted_counts(train, valid, features, label, row_key=SERIES_DAY, **params)


def _vector(df: DataFrame, features: list[str], blank: float) -> DataFrame:
    filled = {f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(blank)) for c in features}
    return VectorAssembler(inputCols=list(filled), outputCol="features").transform(df.withColumns(filled)).drop(*filled)


def fit_poisson(train: DataFrame, features: list[str], reg: float = 0.1, label: str = LABEL):
    """Poisson regression on numeric features; nulls count as 0."""
    matrix = _vector(train, features, 0.0).select("features", F.col(label).cast("double").alias("label"))
    return GeneralizedLinearRegression(family="poisson", link="log", regParam=reg, maxIter=25).fit(matrix)


def predict_learned(model, df: DataFrame, features: list[str]) -> DataFrame:
    """Add y_pred, never below zero."""
    if isinstance(model, BoostedCounts):
        return model.predict(df)
    scored = model.transform(_vector(df, features, 0.0))
    return scored.withColumn("y_pred", F.greatest("prediction", F.lit(0.0))).drop("features", "prediction")
