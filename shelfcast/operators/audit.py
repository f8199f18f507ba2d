"""Leakage checks on feature tables and model frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.operators.features import LAGS, ROLLING
from shelfcast.session import saved
from shelfcast.sources.raw import seeded_sample
from shelfcast.sources.schemas import SERIES, SERIES_DAY

LABEL = "label_units_sold"
# Columns never used as features, and the categorical ones in their fixed order.
NOT_FEATURES = {LABEL, "date", "_gold_run_id", "year", "month", "revenue"}
CATEGORICAL = ["store_id", "sku_id", "category", "subcategory", "region", "state", "store_type"]
TOLERANCE = 1e-9


def _expected(sales: DataFrame) -> DataFrame:
    """The audited demand features again, written with plain frames rather than running totals."""
    by_day = Window.partitionBy(*SERIES).orderBy("date")
    columns = {f"lag_{n}_units": F.lag("units_sold", n).over(by_day) for n in LAGS}
    for n in ROLLING:
        frame = by_day.rowsBetween(-n, -1)
        columns[f"rolling_mean_{n}"] = F.avg("units_sold").over(frame)
        columns[f"rolling_std_{n}"] = F.stddev_samp("units_sold").over(frame)
        zero = F.when(F.col("units_sold") == 0, 1.0).otherwise(0.0)
        columns[f"rolling_zero_rate_{n}"] = F.avg(zero).over(frame)
    return sales.select(*SERIES_DAY, *[c.alias(f"expected_{n}") for n, c in columns.items()])


def _differs(name: str) -> Column:
    got, want = F.col(name).cast("double"), F.col(f"expected_{name}").cast("double")
    both = got.isNotNull() & want.isNotNull()
    return (got.isNull() != want.isNull()) | (both & (F.abs(got - want) > TOLERANCE))


def audit_master(
    master: DataFrame, sales: DataFrame, priced: DataFrame, sample_size: int = 1000
) -> DataFrame:
    """Compare a seeded sample of the master table with recomputed lag, rolling and price columns.

    One row per feature: passes, sample_size_checked, mismatches. Only the sampled series are
    recomputed (their keys are written, so that Spark knows whether they can be broadcast) and all
    features are compared in one aggregate.
    """
    names = [f"lag_{n}_units" for n in LAGS]
    names += [f"rolling_{k}_{n}" for n in ROLLING for k in ("mean", "std", "zero_rate")]
    price_names = ["current_price", "price_week_start"]
    sample = saved(
        seeded_sample(master.select(*SERIES_DAY, *names, *price_names), SERIES_DAY, sample_size), "audit-sample"
    )
    touched = saved(sample.select(*SERIES).distinct(), "audit-series")
    expected = _expected(sales.join(touched, SERIES, "left_semi"))
    prices = priced.join(touched, SERIES, "left_semi").select(
        *SERIES_DAY, *[F.col(n).alias(f"expected_{n}") for n in price_names]
    )
    joined = sample.join(expected, SERIES_DAY, "left").join(prices, SERIES_DAY, "left")
    names += price_names
    wide = joined.agg(
        F.count("*").alias("checked"),
        *[F.coalesce(F.sum(_differs(n).cast("long")), F.lit(0)).alias(n) for n in names],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("bad")) for n in names]))
    return wide.select("checked", rows.alias("r")).select(
        "r.feature",
        (F.col("r.bad") == 0).alias("passes"),
        F.col("checked").alias("sample_size_checked"),
        F.col("r.bad").alias("mismatches"),
    )


def require_clean_audit(results: DataFrame) -> None:
    """Raise with the failing features (one result row per feature)."""
    failed = [r["feature"] for r in results.filter(~F.col("passes")).collect()]
    if failed:
        raise ValueError("leakage audit failed: " + ", ".join(failed))


def feature_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Feature columns and their categorical part. Revenue is out: it holds the label."""
    features = [c for c in df.columns if c not in NOT_FEATURES]
    return features, [c for c in CATEGORICAL if c in features]


def model_frame(df: DataFrame) -> DataFrame:
    """Typed model input: date as TIMESTAMP, booleans as double, no untyped string feature."""
    features, categorical = feature_columns(df)
    types = dict(df.dtypes)
    loose = [c for c in features if types[c] == "string" and c not in categorical]
    if loose:
        raise ValueError(f"string features without a category type: {loose}")
    flags = {c: F.col(c).cast("double") for c in features if types[c] == "boolean"}
    stamp = F.timestamp_micros((F.col("date") / F.lit(1000)).cast("long"))
    return df.withColumns({**flags, "date": stamp})


def _long(wide: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn one row of `<field>_<name>` columns into one row per name."""
    items = [
        F.struct(F.lit(n).alias("feature"), *[F.col(f"{p}_{n}").alias(f) for f, p in fields.items()])
        for n in names
    ]
    return wide.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def feature_summary(df: DataFrame) -> DataFrame:
    """One row per feature column of a table: whether it is categorical, and its rows with a value."""
    features, categorical = feature_columns(df)
    wide = df.agg(*[F.count(c).alias(f"present_{c}") for c in features])
    wide = wide.withColumns({f"kind_{c}": F.lit(c in categorical) for c in features})
    return _long(wide, features, {"is_categorical": "kind", "present": "present"})


def label_correlations(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """Pearson correlation of each numeric feature with the label over pairs without nulls.

    Constant columns give null. Constancy is read off min = max, so all features fit in one
    aggregate without a distinct count.
    """
    numeric = [
        c for c, t in df.dtypes if c in features and t in ("int", "bigint", "double", "float", "smallint")
    ]
    y = F.col(label).cast("double")
    parts = []
    for c in numeric:
        x = F.col(c).cast("double")
        y_pair, x_pair = F.when(x.isNotNull(), y), F.when(y.isNotNull(), x)
        varied = (F.min(x_pair) < F.max(x_pair)) & (F.min(y_pair) < F.max(y_pair))
        # corr() itself divides by zero on a constant column, whatever the guard around it
        spread = F.stddev_pop(x_pair) * F.stddev_pop(y_pair)
        corr = F.covar_pop(x_pair, y_pair) / F.nullif(spread, F.lit(0.0))
        parts.append(F.when(varied, corr).alias(f"corr_{c}"))
    wide = df.agg(*parts)
    return _long(wide, numeric, {"correlation": "corr"})


def require_no_target_leakage(
    df: DataFrame, features: list[str], label: str = LABEL, limit: float = 0.95
) -> None:
    rows = label_correlations(df, features, label)
    leaks = rows.filter(~F.isnan("correlation") & (F.abs("correlation") > limit)).collect()
    if leaks:
        names = ", ".join(f"{r['feature']} ({r['correlation']:.3f})" for r in leaks)
        raise ValueError(f"target leakage: correlation with the label above {limit}: {names}")


def fold_null_rates(
    train: DataFrame, val: DataFrame, features: list[str], tolerance: float = 0.05
) -> DataFrame:
    """Per feature: null rate in the last validation-span of training and in validation, whether
    the drop exceeds `tolerance`, and whether the date ranges overlap."""
    train_end = train.agg(F.max("date")).scalar()
    span = val.agg(F.max("date") - F.min("date")).scalar()
    null_avg = [F.avg(F.col(c).isNull().cast("double")).alias(f"null_{c}") for c in features]
    recent = train.filter(F.col("date") >= train_end - span)
    rates = {
        "train": recent.agg(*null_avg, F.max("date").alias("edge")),
        "val": val.agg(*null_avg, F.min("date").alias("edge")),
    }
    both = None
    for side, wide in rates.items():
        rows = wide.select(
            "edge",
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"null_{c}").alias("rate")) for c in features])
            ).alias("r"),
        ).select(F.lit(side).alias("side"), "edge", "r.feature", "r.rate")
        both = rows if both is None else both.unionByName(rows)

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    return (
        both.groupBy("feature")
        .agg(
            of("train", "rate").alias("train_null_rate"),
            of("val", "rate").alias("val_null_rate"),
            (of("train", "edge") >= of("val", "edge")).alias("dates_overlap"),
        )
        .withColumn("suspicious", F.col("train_null_rate") - F.col("val_null_rate") > tolerance)
    )


def require_no_fold_leakage(
    train: DataFrame, val: DataFrame, features: list[str], tolerance: float = 0.05
) -> None:
    rows = fold_null_rates(train, val, features, tolerance).filter("dates_overlap or suspicious").collect()
    if any(r["dates_overlap"] for r in rows):
        raise ValueError("train and validation dates overlap")
    if rows:
        raise ValueError("null rates differ: " + ", ".join(sorted(r["feature"] for r in rows)))
