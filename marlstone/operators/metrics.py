"""Metric families over grouped observations: changes, bridges, ladders, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import exact_sum


def delta_over(df: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    """Last value less the one n rows before; the first one where history is shorter."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    last = df.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n + 1)
    return last.groupBy(*keys).agg(F.max_by(value, order).alias("last"), (F.max_by(value, order) - F.min_by(value, order)).alias("delta"))


def spread(df: DataFrame, keys: list[str], group: str, order: str, value: str) -> DataFrame:
    """Leaders of the groups' latest values: least and greatest with their groups."""
    latest = df.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.max_by(value, order).alias("v"))
    return latest.groupBy(*keys).agg(F.min("v").alias("low"), F.min_by(group, F.struct("v", group)).alias("low_at"), F.max("v").alias("high"), F.max_by(group, F.struct("v", group)).alias("high_at"))


def all_moved(df: DataFrame, keys: list[str], group: str, order: str, value: str) -> DataFrame:
    """Positions at which every group moved the same way against its position before."""
    before = df.select(*keys, group, (F.col(order) + 1).alias(order), F.col(value).alias("_was"))
    sign = F.signum(F.col(value) - F.col("_was"))
    got = df.join(before, [*keys, group, order]).groupBy(*keys, order).agg(F.count("*").alias("groups"), F.min(sign).alias("least"), F.max(sign).alias("most"))
    return got.where("least = most and least != 0").select(*keys, order, "groups", F.col("least").cast("int").alias("direction"))


def trailing_year(df: DataFrame, keys: list[str], year: str, month: str, ytd: str) -> DataFrame:
    """Flow of the last twelve months from sums since January: now + last December - the same month a year ago."""
    december = df.where(F.col(month) == 12).select(*keys, (F.col(year) + 1).alias(year), F.col(ytd).alias("_dec"))
    before = df.select(*keys, (F.col(year) + 1).alias(year), month, F.col(ytd).alias("_was"))
    return df.join(december, [*keys, year]).join(before, [*keys, year, month]).select(*keys, year, month, (F.col(ytd) + F.col("_dec") - F.col("_was")).alias("flow"))


def complete_only(df: DataFrame, keys: list[str], group: str, value: str, members: int) -> DataFrame:
    """Sums over groups where all ``members`` are there."""
    return df.groupBy(*keys).agg(exact_sum(F.col(value)).cast("double").alias("total"), F.count_distinct(group).alias("members")).where(F.col("members") == members).drop("members")


def movement_ranking(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Change against the position before, its share of all changes' size, and rank by size."""
    w = Window.partitionBy(order)
    before = df.select(*keys, (F.col(order) + 1).alias(order), F.col(value).alias("_was"))
    got = df.join(before, [*keys, order]).withColumn("delta", F.col(value) - F.col("_was"))
    size = F.abs("delta").cast("decimal(38,6)")
    rank = F.row_number().over(w.orderBy(F.abs("delta").desc(), *keys))
    return got.select(*keys, order, "delta", (F.abs("delta") / F.nullif(F.sum(size).over(w).cast("double"), F.lit(0.0))).alias("part"), rank.alias("rank"))


def freshness(age_days: Column, cadence_days: float) -> Column:
    """fresh up to 1.5 cadences, late up to 3, else stale."""
    return F.when(age_days <= 1.5 * cadence_days, "fresh").when(age_days <= 3 * cadence_days, "late").otherwise("stale")


def waterfall(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Ordered steps with the running base that each stands on."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.col(value).cast("decimal(38,6)")).over(w), F.lit(0)).cast("double")
    return df.withColumn("base", base).withColumn("top", F.col("base") + F.col(value))


def template_instances(df: DataFrame, keys: list[str], order: str, number: str) -> DataFrame:
    """Rows of numbered blocks; an instance ends where the numbering starts again."""
    w = Window.partitionBy(*keys).orderBy(order)
    again = F.when(F.col(number) <= F.lag(number).over(w), 1).otherwise(0)
    at = df.withColumn("_again", again)
    return at.withColumn("instance", F.sum("_again").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_again")


def contains_all(left: DataFrame, right: DataFrame, left_key: str, left_tokens: str, right_key: str, right_tokens: str) -> DataFrame:
    """Right rows whose tokens all stand among a left row's; the one with most tokens wins.

    Equal sets of tokens are one row each, so frequent tokens meet once per set and
    not once per row; sets come from a join on tokens, each by its rarest one.
    """
    sets = lambda df, tokens: df.select("*", F.sort_array(F.array_distinct(tokens)).alias("_set")).where(F.size("_set") > 0)
    need = sets(right, right_tokens).groupBy("_set").agg(F.max(right_key).alias(right_key))
    have = sets(left, left_tokens)
    kinds = have.select("_set").distinct()
    words = need.select("_set", F.explode("_set").alias("_t"))
    often = words.groupBy("_t").agg(F.count("*").alias("_often"))
    rarest = words.join(often, "_t").groupBy("_set").agg(F.min_by("_t", F.struct("_often", "_t")).alias("_t")).withColumnRenamed("_set", "_need")
    met = kinds.select("_set", F.explode("_set").alias("_t")).join(rarest, "_t").where(F.size(F.array_except("_need", "_set")) == 0)
    best = met.join(need.withColumnRenamed("_set", "_need"), "_need").groupBy("_set").agg(F.max_by(right_key, F.struct(F.size("_need"), right_key)).alias(right_key), F.max(F.size("_need")).cast("bigint").alias("tokens"))
    return have.join(best, "_set").select(left_key, right_key, "tokens")
