"""Silver cleaning. Every cleaner gives the cleaned frame and a one-row frame of metrics.

Hot keys are safe: de-duplication keeps one row per key on the map side before its shuffle, and
the metrics and the price fill work on per-key partial aggregates.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.sources.schemas import KEYS, SERIES, schema_of

METRICS = (
    "rows_in",
    "rows_out",
    "dupes_dropped",
    "nulls_dropped",
    "invalid_dropped",
    "imputations_applied",
)


class Cleaned(NamedTuple):
    frame: DataFrame
    metrics: DataFrame


def cast_business(df: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to the business schema; a value that does not fit its type becomes null."""
    fields = schema_of(table).fields
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields], *keep)


def any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns], F.lit(False))


def drop_required_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`. Filtering a row_number to 1 lets Spark limit each
    key to one row per map task before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter(F.col("_nth") == 1).drop("_nth")


def drop_duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """One row per natural key; the survivor is the smallest row in column order."""
    keys = KEYS[table]
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in keys]
    return first_per_key(df, keys, rest or [F.col(keys[0])])


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0))


def _metric_row(
    per_key: DataFrame, nulls: Column, invalid: Column, survivors: Column, imputed: Column
) -> DataFrame:
    sums = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"),
        survivors.alias("rows_out"),
        nulls.alias("nulls_dropped"),
        invalid.alias("invalid_dropped"),
        imputed.alias("imputations_applied"),
    )
    gone = F.col("nulls_dropped") + F.col("invalid_dropped") + F.col("rows_out")
    return sums.withColumn("dupes_dropped", F.col("rows_in") - gone).select(*METRICS)


def _plain_metrics(flagged: DataFrame, keys: list[str]) -> DataFrame:
    per_key = flagged.groupBy(*keys).agg(
        F.count("*").alias("n"),
        _count_if(F.col("_null")).alias("nulls"),
        _count_if(~F.col("_null") & F.col("_bad")).alias("bad"),
    )
    kept = (F.col("n") > F.col("nulls") + F.col("bad")).cast("long")
    zero = F.lit(0).cast("long")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), zero)

    return _metric_row(per_key, total(F.col("nulls")), total(F.col("bad")), total(kept), zero)


def _flagged(df: DataFrame, table: str) -> DataFrame:
    """The cast rows with marks for null keys or values (`_null`) and invalid ones (`_bad`)."""
    if table != "sales":
        cast = cast_business(df, table)
        return cast.withColumn("_null", any_null(cast.columns)).withColumn("_bad", F.lit(False))
    cast = cast_business(df, "sales", keep=("_ingested_at",)).withColumn("store_id", F.lower("store_id"))
    bad = F.coalesce(F.col("units_sold") < 0, F.lit(False))
    return cast.withColumn("_null", any_null(schema_of("sales").fieldNames())).withColumn("_bad", bad)


def _survivors(valid: DataFrame, table: str) -> DataFrame:
    """One row per key. Sales keep the earliest load; loads of one run share a timestamp, so
    remaining ties fall to the smallest row."""
    names = schema_of(table).fieldNames()
    if table != "sales":
        return drop_duplicate_keys(valid.select(*names), table)
    ties = [F.col(c).asc() for c in names if c not in KEYS["sales"]]
    frame = first_per_key(valid, KEYS["sales"], [F.col("_ingested_at").asc_nulls_last(), *ties])
    return frame.select(*names)


def clean_dimension(df: DataFrame, table: str) -> Cleaned:
    """Stores, products and calendar: cast, every column required, one row per key."""
    flagged = _flagged(df, table)
    return Cleaned(_survivors(flagged.filter(~F.col("_null")), table), _plain_metrics(flagged, KEYS[table]))


def clean_sales(df: DataFrame) -> Cleaned:
    """Lower-case store ids, drop null and negative rows, keep the earliest load of each key."""
    flagged = _flagged(df, "sales")
    valid = flagged.filter(~F.col("_null") & ~F.col("_bad"))
    return Cleaned(_survivors(valid, "sales"), _plain_metrics(flagged, KEYS["sales"]))


def _weekly_price_profile(cast: DataFrame) -> DataFrame:
    """One row per price key with what filling and de-duplication need, then the carried price.

    Inside one week priced rows count as earlier than unpriced ones, so an unpriced row takes the
    highest price of its own week if there is one and else the last priced week before it.
    The carry window runs over weeks, not rows.
    """
    required = [c for c in cast.columns if c != "price"]
    keyed = ~any_null(required)
    priced = keyed & F.col("price").isNotNull()
    rest = F.struct("is_promo", "year")
    per_key = cast.groupBy(*KEYS["prices"]).agg(
        F.count("*").alias("n"),
        _count_if(~keyed).alias("broken"),
        _count_if(keyed & F.col("price").isNull()).alias("unpriced"),
        F.max(F.when(priced, F.col("price"))).alias("own_price"),
        F.min(F.when(priced, F.struct("price", "is_promo", "year"))).alias("priced_row"),
        F.min(F.when(keyed & F.col("price").isNull(), rest)).alias("unpriced_row"),
    )
    earlier = (
        Window.partitionBy(*SERIES).orderBy("week_start").rowsBetween(Window.unboundedPreceding, 0)
    )
    return per_key.withColumn("carried", F.last("own_price", ignorenulls=True).over(earlier))


def _price_cleaning(df: DataFrame, counting: Observation | None = None) -> tuple[DataFrame, DataFrame, dict[str, Column]]:
    """(profile, cleaned frame, metric columns over the profile)."""
    cast = cast_business(df, "prices").withColumn("store_id", F.lower("store_id"))
    profile = _weekly_price_profile(cast)
    fillable = F.col("carried").isNotNull()
    unfilled = F.when(fillable, F.lit(0)).otherwise(F.col("unpriced"))
    filled = F.when(fillable, F.col("unpriced")).otherwise(F.lit(0))

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    counts = {
        "rows_in": total(F.col("n")),
        "nulls_dropped": total(F.col("broken") + unfilled),
        "invalid_dropped": total(F.lit(0)),
        "imputations_applied": total(filled),
    }
    if counting is not None:
        profile = profile.observe(counting, *[c.alias(n) for n, c in counts.items()])
    survivor = F.coalesce(
        F.col("priced_row"),
        F.when(
            F.col("unpriced_row").isNotNull() & F.col("carried").isNotNull(),
            F.struct(
                F.col("carried").alias("price"),
                F.col("unpriced_row.is_promo").alias("is_promo"),
                F.col("unpriced_row.year").alias("year"),
            ),
        ),
    )
    frame = (
        profile.withColumn("row", survivor)
        .filter(F.col("row").isNotNull())
        .select(*KEYS["prices"], "row.price", "row.is_promo", "row.year")
    )
    return profile, frame, counts


def clean_prices(df: DataFrame) -> Cleaned:
    """Lower-case store ids, drop rows with broken keys, carry the last price into unpriced rows,
    drop what has no earlier price, keep one row per key."""
    profile, frame, counts = _price_cleaning(df)
    fillable = F.col("carried").isNotNull()
    kept = F.col("priced_row").isNotNull() | (fillable & (F.col("unpriced") > 0))
    survivors = F.coalesce(F.sum(kept.cast("long")), F.lit(0))
    nulls, invalid, imputed = (counts[n] for n in ("nulls_dropped", "invalid_dropped", "imputations_applied"))
    return Cleaned(frame, _metric_row(profile, nulls, invalid, survivors, imputed))


class CountedClean(NamedTuple):
    """A cleaned frame whose own run counts the metrics: run one action on it, then ask."""

    frame: DataFrame
    before: Observation
    after: Observation
    source: DataFrame
    table: str

    def metrics(self) -> dict[str, int]:
        """The counts of the action. Stages that ran twice, after a lost executor, count twice: the
        row count, which file footers tell without a scan, shows it, and the metrics are then
        taken by a job of their own."""
        seen, kept = self.before.get, self.after.get
        if seen["rows_in"] != self.source.count():
            row = clean(self.source, self.table).metrics.first()
            return {m: row[m] for m in METRICS}
        out = {**seen, "rows_out": kept["rows_out"]}
        out["dupes_dropped"] = out["rows_in"] - out["nulls_dropped"] - out["invalid_dropped"] - out["rows_out"]
        return {m: out[m] for m in METRICS}


def _after(frame: DataFrame, after: Observation) -> DataFrame:
    return frame.observe(after, F.count(F.lit(1)).alias("rows_out"))


def counted_clean(df: DataFrame, table: str) -> CountedClean:
    """Cleaning that counts while it runs: the action that writes the frame is the only scan."""
    before, after = Observation(f"{table}-before-{uuid.uuid4().hex}"), Observation(f"{table}-after-{uuid.uuid4().hex}")
    if table == "prices":
        _, frame, _ = _price_cleaning(df, before)
        return CountedClean(_after(frame, after), before, after, df, table)
    flagged = _flagged(df, table).observe(
        before,
        F.count(F.lit(1)).alias("rows_in"),
        _count_if(F.col("_null")).alias("nulls_dropped"),
        _count_if(~F.col("_null") & F.col("_bad")).alias("invalid_dropped"),
        _count_if(F.lit(False)).alias("imputations_applied"),
    )
    frame = _survivors(flagged.filter(~F.col("_null") & ~F.col("_bad")), table)
    return CountedClean(_after(frame, after), before, after, df, table)


def fill_prices(df: DataFrame) -> DataFrame:
    """Last-observation-carried-forward over one row per (store, sku, week): price rows with
    nulls taken from the nearest earlier priced week, unfillable rows left out."""
    earlier = (
        Window.partitionBy(*SERIES).orderBy("week_start").rowsBetween(Window.unboundedPreceding, -1)
    )
    prior = F.last("price", ignorenulls=True).over(earlier)
    return (
        df.withColumn("was_imputed", F.col("price").isNull())
        .withColumn("price", F.coalesce("price", prior))
        .filter(F.col("price").isNotNull())
    )


def clean(df: DataFrame, table: str) -> Cleaned:
    if table == "sales":
        return clean_sales(df)
    if table == "prices":
        return clean_prices(df)
    return clean_dimension(df, table)
