"""Forecast-error aggregates. All are plain aggregate columns: one pass gives any set of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9
SCORES = ("mae", "rmse", "wape", "smape", "bias")


def _err(y: str, p: str) -> Column:
    return F.col(p).cast("double") - F.col(y).cast("double")


def _floor(value: Column) -> Column:
    return F.greatest(value, F.lit(EPSILON))


def mae(y: str = "y_true", p: str = "y_pred") -> Column:
    return F.avg(F.abs(_err(y, p)))


def rmse(y: str = "y_true", p: str = "y_pred") -> Column:
    return F.sqrt(F.avg(_err(y, p) * _err(y, p)))


def wape(y: str = "y_true", p: str = "y_pred") -> Column:
    return F.sum(F.abs(_err(y, p))) / _floor(F.sum(F.abs(F.col(y).cast("double"))))


def smape(y: str = "y_true", p: str = "y_pred") -> Column:
    halves = (F.abs(F.col(y).cast("double")) + F.abs(F.col(p).cast("double"))) / F.lit(2.0)
    return F.avg(F.abs(_err(y, p)) / _floor(halves))


def bias_ratio(y: str = "y_true", p: str = "y_pred") -> Column:
    """Signed error over total actual demand."""
    return F.sum(_err(y, p)) / _floor(F.sum(F.abs(F.col(y).cast("double"))))


def bias_mean(y: str = "y_true", p: str = "y_pred") -> Column:
    """Signed error per row; segment reports use this one."""
    return F.avg(_err(y, p))


def score_columns(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    """The five scores, 0.0 where no row contributes."""
    parts = zip(SCORES, (mae, rmse, wape, smape, bias_ratio), strict=True)
    return [F.coalesce(fn(y, p), F.lit(0.0)).alias(name) for name, fn in parts]
