"""Numbers for category labels and statistics of the label column that look back only.

Both stay distributed: labels are numbered along a sliced global order, and statistics are joined,
so no dictionary of labels sits on the driver and no two labels share a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.operators.ordering import global_running_totals

#: Rows that the overall mean counts for beside a label's own.
PRIOR_ROWS = 10.0


def label_index(df: DataFrame, column: str) -> DataFrame:
    """(label, number): dense numbers from 0 of the distinct non-null labels, in their order."""
    labels = df.select(F.col(column).alias("label")).filter("label is not null").distinct()
    ranked = global_running_totals(labels, [F.col("label").asc()], {"number": F.lit(1)})
    return ranked.select("label", (F.col("number") - 1).cast("long").alias("number"))


def with_label_number(df: DataFrame, column: str, index: DataFrame, name: str) -> DataFrame:
    """Adds a label's number; null where the label is null or not in the index."""
    known = index.withColumnsRenamed({"label": "_label", "number": name})
    return df.join(known, F.col(column) == F.col("_label"), "left").drop("_label")


def _smoothed(total: Column, count: Column, prior: Column, rows: float) -> Column:
    return (total + F.lit(rows) * prior) / (count + F.lit(rows))


def daily_history(df: DataFrame, by: str | None, label: str, day: str = "date") -> DataFrame:
    """(by, day, sum, count of the label on all earlier days, sum and count to its end). One row a
    label and day on record; a partial aggregate absorbs labels of very many rows first."""
    keys = [by, day] if by else [day]
    daily = df.groupBy(*keys).agg(F.sum(F.col(label).cast("double")).alias("s"), F.count(label).alias("n"))
    order = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(day)
    earlier, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"{c}_before": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("s", "n")}
    return daily.select(
        *keys, *[v.alias(k) for k, v in sums.items()], *[F.sum(c).over(so_far).alias(f"{c}_until") for c in ("s", "n")]
    )


def ordered_target_means(
    df: DataFrame,
    columns: list[str],
    label: str,
    train_end: int,
    day: str = "date",
    prior_rows: float = PRIOR_ROWS,
    prefix: str = "mean_of_",
) -> DataFrame:
    """Adds, for each category column, the mean label of its rows on earlier training days.

    A training row sees the days before its own, a later row all days up to `train_end`; labels of
    later rows are never read. Means lean to the overall mean of the same days by `prior_rows` rows.
    Null labels of a category form a category; one that training lacks has the overall mean.
    """
    train = df.filter(F.col(day) <= train_end)
    overall = daily_history(train, None, label, day)  # one row a day
    last = overall.agg(F.max_by("s_until", day).alias("s"), F.max_by("n_until", day).alias("n"))
    whole = F.coalesce(last.select(F.col("s") / F.nullif("n", F.lit(0))).scalar(), F.lit(0.0))
    mean = F.coalesce(F.col("s_before") / F.nullif("n_before", F.lit(0)), F.lit(0.0))
    days = overall.select(F.col(day).alias("_day"), mean.alias("_overall"))
    rows = df.join(days, F.col(day) == F.col("_day"), "left").withColumn("_overall", F.coalesce("_overall", whole)).drop("_day")
    for c in columns:
        history = daily_history(train, c, label, day)
        own = history.select(
            F.col(c).alias("_label"), F.col(day).alias("_at"), F.col("s_before").alias("_s"), F.col("n_before").alias("_n")
        )
        # all training days of a label, as if on the first day after them
        total = history.groupBy(c).agg(F.max_by("s_until", day).alias("_s"), F.max_by("n_until", day).alias("_n"))
        total = total.select(F.col(c).alias("_label"), F.lit(None).cast("long").alias("_at"), "_s", "_n")
        at = F.when(F.col(day) <= train_end, F.col(day))
        same = F.col(c).eqNullSafe(F.col("_label")) & at.eqNullSafe(F.col("_at"))
        value = _smoothed(F.coalesce("_s", F.lit(0.0)), F.coalesce("_n", F.lit(0)), F.col("_overall"), prior_rows)
        rows = rows.join(own.unionByName(total), same, "left").withColumn(f"{prefix}{c}", value).drop("_label", "_at", "_s", "_n")
    return rows.drop("_overall")
