"""Segment assignment and segment-level error reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions.dates import week_start
from shelfcast.functions.errors import EPSILON, SCORES, bias_mean, mae, rmse, score_columns, smape, wape
from shelfcast.operators.audit import LABEL
from shelfcast.operators.ordering import exact_quantiles, global_running_totals, ranked_values
from shelfcast.session import freeze
from shelfcast.sources.schemas import SERIES

# Demand-class cut-offs.
ADI_CUT, CV2_CUT = 1.32, 0.49


def volume_tiers(sales: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pareto tier per series: A while less than 20 % of volume lies before it, B while less than
    50 %, else C. Ties in volume fall to the key order."""
    by = by or SERIES
    totals = sales.groupBy(*by).agg(F.coalesce(F.sum("units_sold"), F.lit(0)).alias("total_units_sold"))
    order = [F.col("total_units_sold").desc(), *[F.col(k).asc() for k in by]]
    run = global_running_totals(totals, order, {"_upto": F.col("total_units_sold")})
    volume = run.agg(F.sum("total_units_sold")).scalar()
    positive = volume > 0
    before = (F.col("_upto") - F.col("total_units_sold")) * F.lit(10)

    def share(part: str):
        return F.when(positive, F.col(part) / volume).otherwise(F.lit(0.0))

    tier = (
        F.when(positive & (before < volume * 2), "A_top20pct")
        .when(positive & (before < volume * 5), "B_middle30pct")
        .otherwise("C_bottom50pct")
    )
    return run.select(
        *by,
        "total_units_sold",
        share("total_units_sold").alias("volume_share"),
        share("_upto").alias("cumulative_volume_share"),
        tier.alias("volume_tier"),
    )


def intermittency_classes(sales: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Syntetos-Boylan class from the demand interval and the squared variation of non-zero demand."""
    by = by or SERIES
    units = F.col("units_sold").cast("double")
    sold = F.when(units > 0, units)
    infinite = F.lit(float("inf"))
    stats = sales.groupBy(*by).agg(
        F.count("*").alias("total_periods"),
        F.count(sold).alias("non_zero_periods"),
        F.avg(sold).alias("_mean"),
        F.var_pop(sold).alias("_var"),
    )
    some = F.col("non_zero_periods") > 0
    classed = stats.withColumns(
        {
            "adi": F.when(some, F.col("total_periods") / F.nullif(F.col("non_zero_periods"), F.lit(0)))
            .otherwise(infinite),
            "cv_squared": F.when(some, F.col("_var") / (F.col("_mean") * F.col("_mean"))).otherwise(infinite),
        }
    )
    often, steady = F.col("adi") < ADI_CUT, F.col("cv_squared") < CV2_CUT
    label = (
        F.when(often & steady, "smooth")
        .when(often, "erratic")
        .when(steady, "intermittent")
        .otherwise("lumpy")
    )
    return classed.withColumn("intermittency_class", label).drop("_mean", "_var")


def with_promo_day(preds: DataFrame, prices: DataFrame) -> DataFrame:
    """Flag days in promoted weeks; days without a price row are not promoted."""
    start = F.col("week_start") if "week_start" in prices.columns else week_start("date")
    weeks = prices.select(*SERIES, start.alias("week_start"), "is_promo").distinct()
    dated = preds.withColumn("week_start", week_start("date"))
    joined = dated.join(weeks, [*SERIES, "week_start"], "left")
    return joined.withColumn("is_promo_day", F.coalesce("is_promo", F.lit(False))).drop("is_promo")


def _report_columns(y: str, p: str) -> list:
    return [
        F.count("*").alias("n_rows"),
        F.avg(F.col(y).cast("double")).alias("mean_actual"),
        mae(y, p).alias("mae"),
        rmse(y, p).alias("rmse"),
        wape(y, p).alias("wape"),
        smape(y, p).alias("smape"),
        bias_mean(y, p).alias("bias"),
    ]


def segment_report(
    df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred", ordered: bool = False
) -> DataFrame:
    """Row count, mean actual and error measures per segment; null segments are kept."""
    out = df.groupBy(*by).agg(*_report_columns(y, p))
    return out.orderBy(*by) if ordered else out


def bias_flags(report: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Segments whose mean error exceeds `threshold` of mean demand, largest first."""
    size = F.abs("mean_actual")
    ratio = F.when(size > EPSILON, F.col("bias") / F.nullif(size, F.lit(0.0)))
    flagged = report.withColumn("bias_ratio", ratio).filter(F.abs("bias_ratio") > threshold)
    side = F.when(F.col("bias_ratio") > 0, "over").otherwise("under")
    return flagged.withColumn("bias_direction", side).orderBy(F.abs("bias_ratio").desc())


def best_and_worst(
    df: DataFrame, n: int = 20, min_total_actual: float = 10.0
) -> tuple[DataFrame, DataFrame]:
    """The n series with the lowest and the highest WAPE among those with enough actual demand.
    Both ends are top-k sorts over the per-series aggregate; ties fall to the key order."""
    category = F.min("category") if "category" in df.columns else F.lit(None).cast("string")
    ranked = (
        df.groupBy(*SERIES)
        .agg(
            category.alias("category"),
            wape().alias("wape"),
            F.count("*").alias("n_days"),
            F.sum("y_true").alias("_total"),
        )
        .filter(F.col("_total") >= min_total_actual)
        .drop("_total")
    )
    best = ranked.orderBy(F.col("wape").asc(), *SERIES).limit(n)
    worst = ranked.orderBy(F.col("wape").desc(), *SERIES).limit(n)
    return best, worst


def enrich(
    preds: DataFrame,
    products: DataFrame,
    stores: DataFrame,
    sales: DataFrame,
    prices: DataFrame | None,
    panel: DataFrame | None = None,
) -> DataFrame:
    """Predictions with product, store, volume tier, demand class and promo flag. Demand classes
    come from `panel`, the sales with zero days filled in, where one is given.

    No join is forced to broadcast: dimension sizes are unknown here and Spark checks them itself.
    """
    out = preds
    if "category" not in out.columns:
        out = out.join(products.select("sku_id", "category", "subcategory"), "sku_id", "left")
    if "store_type" not in out.columns:
        out = out.join(stores.select("store_id", "region", "state", "store_type"), "store_id", "left")
    out = out.join(volume_tiers(sales).select(*SERIES, "volume_tier"), SERIES, "left")
    classes = intermittency_classes(sales if panel is None else panel).select(*SERIES, "intermittency_class")
    out = out.join(classes, SERIES, "left")
    if prices is None:
        return out.withColumn("is_promo_day", F.lit(False))
    return with_promo_day(out, prices)


REPORT_SETS = {
    "category": ["category"],
    "store_category": ["store_id", "category"],
    "volume_promo": ["volume_tier", "is_promo_day"],
    "intermittency": ["intermittency_class"],
}


def report_set(enriched: DataFrame, top_categories: int = 10) -> DataFrame:
    """The four standard segment reports from one grouping-sets pass over the predictions.

    Rows carry `report` and only the segment columns of that report. The category report keeps
    the categories with the largest actual demand.
    """
    columns = ["category", "store_id", "volume_tier", "is_promo_day", "intermittency_class"]
    sets = [[F.col(c) for c in by] for by in REPORT_SETS.values()]
    gid = F.grouping_id()
    bits = {
        name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in by)
        for name, by in REPORT_SETS.items()
    }
    name = F.lit(None).cast("string")
    for report, value in bits.items():
        name = F.when(F.col("_gid") == value, report).otherwise(name)
    grouped = freeze(
        enriched.groupingSets(sets, *columns)
        .agg(gid.alias("_gid"), F.sum("y_true").alias("_total"), *_report_columns("y_true", "y_pred"))
        .withColumn("report", name)
        .drop("_gid")
    )
    per_category = grouped.filter(F.col("report") == "category")
    top = per_category.orderBy(F.col("_total").desc(), F.col("category").asc()).limit(top_categories)
    rest = grouped.filter(F.col("report") != "category")
    return top.unionByName(rest).select("report", *columns, *_metric_names())


def _metric_names() -> list[str]:
    return ["n_rows", "mean_actual", "mae", "rmse", "wape", "smape", "bias"]


#: Columns that a grid may have.
MOST_COLUMNS = 200


def heatmap(
    report: DataFrame, x: str, y: str, values: list[str] | None = None, metric: str = "wape", most: int = MOST_COLUMNS
) -> DataFrame:
    """Metric grid: one row per y, one column per x value, in order. Values are found in the report
    unless given; more than `most` raise, none is dropped. A null x is the column `null`."""
    if values is None:
        found = report.select(x).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{x} has more than {most} values")
        values = sorted((r[x] for r in found), key=lambda v: (v is None, v))
    cell = [
        F.first(F.when(F.col(x).eqNullSafe(F.lit(v)), F.col(metric)), ignorenulls=True).alias("null" if v is None else str(v))
        for v in values
    ]
    return report.groupBy(y).agg(*cell) if cell else report.select(y).distinct()


def train_volume_tiers(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Series in three equal-count volume bands from training demand; medium for all if the bands
    collapse."""
    volume = train.groupBy(*SERIES).agg(F.sum(label).alias("volume"))
    ranked = ranked_values(volume, "volume", SERIES)
    cuts = exact_quantiles(ranked, "volume", {"q1": 1 / 3, "q2": 2 / 3})
    edges = [cuts[c] for c in ("min_value", "q1", "q2", "max_value")]
    if None in edges or sorted(set(edges)) != edges:
        return ranked.select(*SERIES, F.lit("medium").alias("volume_tier"))
    band = (
        F.when(F.col("volume") <= cuts["q1"], "low")
        .when(F.col("volume") <= cuts["q2"], "medium")
        .otherwise("high")
    )
    return ranked.select(*SERIES, band.alias("volume_tier"))


# How many segments of each kind the log keeps (None: all).
SEGMENT_LOG = {"category": 5, "store_type": 3, "volume_tier": None}


def segment_metric_log(scored: DataFrame, train: DataFrame) -> DataFrame:
    """Scores of the top 5 categories, top 3 store types and all volume tiers as
    (segment, value, metric, score) rows."""
    return _segment_log(scored.join(train_volume_tiers(train), SERIES, "left"), [])


def fold_segment_log(scored: DataFrame, trains: dict[int, DataFrame]) -> DataFrame:
    """The log of each (fold_id, model); volume tiers are those of the fold's training rows."""
    tiers = None
    for fold_id, train in trains.items():
        own = train_volume_tiers(train).withColumn("fold_id", F.lit(fold_id))
        tiers = own if tiers is None else tiers.unionByName(own)
    return _segment_log(scored.join(tiers, [*SERIES, "fold_id"], "left"), ["fold_id", "model"])


def _segment_log(rows: DataFrame, by: list[str]) -> DataFrame:
    limits = {c: n for c, n in SEGMENT_LOG.items() if c in rows.columns}
    columns = list(limits)
    grouped = freeze(
        rows.groupingSets([[*map(F.col, by), F.col(c)] for c in columns], *by, *columns).agg(
            F.grouping_id().alias("_gid"), F.sum("y_true").alias("_total"), *score_columns()
        )
    )
    out = None
    for i, (column, n) in enumerate(limits.items()):
        bits = (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i))
        part = grouped.filter((F.col("_gid") == bits) & F.col(column).isNotNull())
        if n is not None:
            largest = Window.partitionBy(*by).orderBy(F.col("_total").desc(), F.col(column).asc())
            part = part.withColumn("_nth", F.row_number().over(largest)).filter(F.col("_nth") <= n)
        part = part.select(*by, F.lit(column).alias("segment"), F.col(column).cast("string").alias("value"), *SCORES)
        out = part if out is None else out.unionByName(part)
    return out.unpivot([*by, "segment", "value"], list(SCORES), "metric", "score")
