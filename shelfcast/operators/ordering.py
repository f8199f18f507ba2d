"""Work over one global order without one global task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.session import freeze


def global_running_totals(
    df: DataFrame,
    order_by: list[Column],
    measures: dict[str, Column],
    slices: int | None = None,
) -> DataFrame:
    """Add inclusive running totals of `measures` along `order_by` over the whole frame.

    The rows are range-partitioned along the order and written to the checkpoint folder, so every
    row keeps its slice. Each slice is then summed, the few slice sums are accumulated, and a
    window inside each slice finishes the totals. No task sees more than a slice. `order_by` must
    end in a unique key: the range partitioner then also cuts through runs of equal values.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = freeze(
        df.repartitionByRange(slices, *order_by).withColumn("_slice", F.spark_partition_id())
    )
    sums = sliced.groupBy("_slice").agg(*[F.sum(m).alias(f"_sum_{n}") for n, m in measures.items()])
    # One row per slice: at most `slices` rows, whatever the data size.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_slice", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in measures]
    )
    inside = (
        Window.partitionBy("_slice").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = sliced.join(F.broadcast(offsets), "_slice")
    return joined.select(
        *df.columns,
        *[(F.col(f"_off_{n}") + F.sum(m).over(inside)).alias(n) for n, m in measures.items()],
    )


def ranked_values(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    """Key, value and 1-based `rank` of the non-null values in the global order (value, key)."""
    present = df.filter(F.col(value).isNotNull()).select(*key, value)
    order = [F.col(value).asc(), *[F.col(k).asc() for k in key]]
    return global_running_totals(present, order, {"rank": F.lit(1)})


def exact_quantiles(ranked: DataFrame, value: str, probs: dict[str, float]) -> dict[str, float | None]:
    """Linearly interpolated quantiles of `ranked_values`, with min_value and max_value.

    Only the two neighbours of each quantile are read off by rank; an exact percentile aggregate
    would gather all distinct values in one buffer instead.
    """
    n = ranked.count()
    at = {name: divmod(p * (n - 1), 1) for name, p in probs.items()}

    def value_at(rank: float):
        return F.max(F.when(F.col("rank") == F.lit(int(rank) + 1), F.col(value).cast("double")))

    parts = [F.min(F.col(value)).alias("min_value"), F.max(F.col(value)).alias("max_value")]
    for name, (whole, _) in at.items():
        parts += [value_at(whole).alias(f"low_{name}"), value_at(min(whole + 1, n - 1)).alias(f"high_{name}")]
    row = ranked.agg(*parts).first()
    out = {"min_value": row["min_value"], "max_value": row["max_value"]}
    for name, (_, part) in at.items():
        low, high = row[f"low_{name}"], row[f"high_{name}"]
        out[name] = None if low is None else low + (high - low) * part
    return out
