"""Data-quality checks, one result row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.clean import any_null
from shelfcast.sources.schemas import KEYS, REFERENCES, TABLES


def _failed(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(False, None)], "passed boolean, failures long")


def no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Passes when the columns exist and hold no null; no columns pass."""
    if any(c not in df.columns for c in columns):
        return _failed(df)
    bad = F.coalesce(F.sum(any_null(columns).cast("long")), F.lit(0))
    return df.agg((bad == 0).alias("passed"), bad.alias("failures"))


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Passes when no key combination repeats. Partial counts absorb a hot key before the shuffle."""
    if any(c not in df.columns for c in columns):
        return _failed(df)
    surplus = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    counted = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counted.agg((surplus == 0).alias("passed"), surplus.alias("failures"))


def references(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """Distinct child values without a parent row; null child values count as orphans."""
    orphans = child.select(column).distinct().join(parent.select(column).distinct(), column, "left_anti")
    return orphans.agg((F.count("*") == 0).alias("passed"), F.count("*").alias("failures"))


def min_rows(df: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("n must be nonnegative")
    return df.agg(
        (F.count("*") >= n).alias("passed"),
        F.greatest(F.lit(n) - F.count("*"), F.lit(0)).cast("long").alias("failures"),
    )


def key_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key combination with its rows `n`; hot keys are counted before the shuffle. All
    checks on keys follow from it, and queries that use it more than once read the table once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _key_checks(profile: DataFrame, keys: list[str], table: str) -> DataFrame:
    nulls = F.coalesce(F.sum(F.when(any_null(keys), F.col("n")).otherwise(0)), F.lit(0))
    surplus = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    checks = [(f"{table}_natural_key_no_nulls", "nulls"), (f"{table}_natural_key_unique", "surplus")]
    rows = [F.struct(F.lit(n).alias("check_name"), (F.col(c) == 0).alias("passed"), F.col(c).alias("failures")) for n, c in checks]
    return profile.agg(nulls.alias("nulls"), surplus.alias("surplus")).select(F.inline(F.array(*rows)))


def _profile_values(profile: DataFrame, column: str) -> DataFrame:
    """Distinct values of one key column, through the counts, so that the profile is the same
    exchange in every check."""
    return profile.groupBy(column).agg(F.sum("n").alias("rows"))


def suite(frames: dict[str, DataFrame]) -> DataFrame:
    """The fixed 15 checks over the five Silver tables: one key profile a table, from which its null
    and uniqueness checks and the references' values follow."""
    profiles = {t: key_profile(frames[t], KEYS[t]) for t in TABLES if all(k in frames[t].columns for k in KEYS[t])}
    out = None
    for table in TABLES:
        if table in profiles:
            made = _key_checks(profiles[table], KEYS[table], table)
        else:
            made = frames[table].sparkSession.createDataFrame(
                [(f"{table}_natural_key_{c}", False, None) for c in ("no_nulls", "unique")], "check_name string, passed boolean, failures long"
            )
        out = made if out is None else out.unionByName(made)
    for child, column, parent in REFERENCES:
        sides = [
            _profile_values(profiles[t], column) if t in profiles and column in KEYS[t] else frames[t].groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
            for t in (child, parent)
        ]
        orphans = sides[0].join(sides[1].filter("rows > 0"), column, "left_anti").filter("rows > 0")
        found = orphans.agg(F.count(F.lit(1)).alias("failures"))
        name = F.lit(f"{child}_{column}_in_{parent}").alias("check_name")
        out = out.unionByName(found.select(name, (F.col("failures") == 0).alias("passed"), "failures"))
    return out


def require(results: DataFrame) -> None:
    """Raise with the names of failed checks (the result frame has one row per check)."""
    failed = [r["check_name"] for r in results.filter(~F.col("passed")).collect()]
    if failed:
        raise ValueError("data quality checks failed: " + ", ".join(sorted(failed)))
