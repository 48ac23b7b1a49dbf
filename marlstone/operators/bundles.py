"""Bundles of series, stacks, runways and findings that several figures make together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stacked(parts: list[tuple[str, DataFrame]], keys: list[str], value: str) -> DataFrame:
    """Series by name in one long table: ``series``, keys, ``v``; null values are left out."""
    rows = [df.select(F.lit(name).alias("series"), *keys, F.col(value).cast("double").alias("v")) for name, df in parts]
    return reduce(DataFrame.unionByName, rows).where("v is not null")


def by_difference(levels: list[Column], names: list[str]) -> list[Column]:
    """Layers of nested levels, each less the one before, floored at 0."""
    return [(F.greatest(level - (levels[k - 1] if k else F.lit(0)), F.lit(0.0))).alias(name) for k, (level, name) in enumerate(zip(levels, names, strict=True))]


def runway(level: Column, per_step: Column, floor: float) -> Column:
    """Steps until a falling level meets the floor; 0 under it, null if it doesn't fall."""
    return F.when(level <= floor, 0.0).when(per_step < 0, (level - floor) / -per_step)


def top_and_rest(df: DataFrame, keys: list[str], label: str, value: str, top: int, rest: str = "rest") -> DataFrame:
    """Values of the ``top`` labels of all keys together, the others folded into one."""
    total = df.groupBy(label).agg(F.sum(F.col(value).cast("decimal(38,6)")).alias("_t"))
    largest = total.orderBy(F.col("_t").desc(), label).limit(top).select(F.col(label).alias("_label"))
    named = df.join(F.broadcast(largest), F.col(label) == F.col("_label"), "left").withColumn(label, F.coalesce("_label", F.lit(rest)))
    return named.groupBy(*keys, label).agg(F.sum(F.col(value).cast("decimal(38,6)")).cast("double").alias(value))


def finding(df: DataFrame, keys: list[str], order: str, value: str, window: int) -> DataFrame:
    """First, last, least and greatest value of the last ``window`` rows of each key, and where the extremes stand."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    last = df.where(F.col(value).isNotNull()).withColumn("_n", n).where(F.col("_n") <= window)
    return last.groupBy(*keys).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.min(value).alias("low"), F.min_by(order, F.struct(value, order)).alias("low_at"), F.max(value).alias("high"), F.max_by(order, F.struct(F.col(value), -F.col(order))).alias("high_at"))


def share_of_trailing(flow: DataFrame, base: DataFrame, order: str, value: str, n: int) -> DataFrame:
    """Sum of the last n flows over the base of the same position, in percent; only complete windows over a positive base."""
    w = Window.orderBy(order).rangeBetween(-(n - 1), 0)  # one row per position
    total = F.sum(F.col(value).cast("decimal(38,6)")).over(w).cast("double")
    got = flow.withColumn("_n", F.count(value).over(w)).withColumn("_sum", total).where(F.col("_n") == n)
    return got.join(base.select(order, F.col(value).alias("_base")), order).where("_base > 0").select(order, (100 * F.col("_sum") / F.col("_base")).alias("share"))


def unchanged_tail(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """How many of the last rows hold the last value."""
    last = F.first(value).over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    got = df.withColumn("_other", (F.col(value) != last).cast("int")).withColumn("_seen", F.sum("_other").over(w))
    return got.groupBy(*keys).agg(F.count_if(F.col("_seen") == 0).alias("held"))
