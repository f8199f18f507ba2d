"""Backward as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_backward(
    facts: DataFrame,
    versions: DataFrame,
    keys: list[str],
    at: str,
    valid_from: str,
    values: dict[str, str],
    repeated: bool = False,
) -> DataFrame:
    """Left as-of join: each fact row gets `values` of the latest version with valid_from <= at.

    Both sides are hashed on `keys` once, put into one stream ordered by time (a version sorts
    before a fact of the same instant) and the last version is carried forward. The work is linear
    in facts + versions; a join on the inequality would pair every fact with all its earlier
    versions first.

    The stream of one key is one window partition. Facts unique in (keys, at) bound it by the
    instants on record; with `repeated` facts the stream holds each instant once and the facts
    join it by equality, which AQE can split on a hot key.
    """
    if repeated:
        instants = facts.select(*keys, at).distinct()
        found = asof_backward(instants, versions, keys, at, valid_from, values)
        return facts.join(found, [*keys, at], "left").select(*facts.columns, *values)
    payload = F.struct(*[F.col(src).alias(dst) for dst, src in values.items()])
    left = facts.withColumn("_is_fact", F.lit(1))
    right = versions.select(
        *keys, F.col(valid_from).alias(at), F.lit(0).alias("_is_fact"), payload.alias("_version")
    )
    stream = left.unionByName(right, allowMissingColumns=True)
    carry = (
        Window.partitionBy(*keys).orderBy(at, "_is_fact").rowsBetween(Window.unboundedPreceding, 0)
    )
    carried = stream.withColumn("_version", F.last("_version", ignorenulls=True).over(carry))
    return carried.filter(F.col("_is_fact") == 1).select(
        *facts.columns, *[F.col(f"_version.{dst}").alias(dst) for dst in values]
    )
