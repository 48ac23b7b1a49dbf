"""Identities inside statements and detectors between them. A missing operand skips; it never passes or fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import verdict


def total(*parts: Column) -> Column:
    """Sum of the parts; null if one is."""
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def all_of(*verdicts: Column) -> Column:
    """fail if one fails, else skip if one skips, else pass."""
    every = F.array(*verdicts)
    return F.when(F.array_contains(every, "fail"), "fail").when(F.array_contains(every, "skip"), "skip").otherwise("pass")


def cash_flow(sections: list[Column], change: Column, opening: Column, closing: Column, base: float = 3.0, rel: float = 5e-5) -> Column:
    """Sections add up to the change in cash, and opening cash and the change to closing cash."""
    return all_of(verdict(total(*sections), change, base, rel), verdict(opening + change, closing, base, rel))


def matches_any(value: Column, candidates: Column, base: float = 10.0) -> Column:
    """pass if any candidate is near the value; skip without a value or candidates."""
    some = F.filter(candidates, lambda c: c.isNotNull())
    return F.when(value.isNull() | (F.size(some) == 0), "skip").when(F.exists(some, lambda c: F.abs(c - value) <= base), "pass").otherwise("fail")


def capital_order(core: Column, tier1: Column, total_capital: Column, ratios: Column, spread: float = 0.08) -> Column:
    """Core <= tier 1 <= total, and the weighted assets that each ratio implies within ``spread`` of each other."""
    implied = F.filter(F.transform(F.arrays_zip(F.array(core, tier1, total_capital).alias("v"), ratios.alias("r")), lambda x: F.when(x["r"] > 0, x["v"] / x["r"])), lambda x: x.isNotNull())
    wide = F.array_max(implied) > (1 + spread) * F.array_min(implied)
    return F.when(core.isNull() | tier1.isNull() | total_capital.isNull(), "skip").when((core > tier1) | (tier1 > total_capital), "order").when(wide, "spread").otherwise("pass")


def drifts(df: DataFrame, keys: list[str], value: str, medians: DataFrame, limit: float = 0.5) -> DataFrame:
    """Rows whose distance from the key's own median is over ``limit`` of it. ``medians``: keys and ``median``."""
    got = df.join(medians, keys)
    return got.where((F.col("median") != 0) & (F.abs(F.col(value) / F.nullif(F.col("median"), F.lit(0.0)) - 1) > limit))


def vanished(df: DataFrame, keys: list[str], order: str, rows: str, largest: str, tiny: float) -> Column:
    """What is odd about a period's rows: fewer than half of the period before, or a largest value that is tiny."""
    before = F.lag(rows).over(Window.partitionBy(*keys).orderBy(order))
    return F.when(F.col(largest) < tiny, "tiny").when(2 * F.col(rows) < before, "vanished")


def composition_divergence(other_share: Column, before: Column, ratio_change: Column) -> Column:
    """Non-core capital of 40 % or more, or 3 points up, while the whole ratio is not down by over half a point."""
    return F.coalesce(((other_share >= 0.4) | (other_share - before >= 0.03)) & (ratio_change >= -0.005), F.lit(False))


def flips(df: DataFrame, keys: list[str], order: str, value: str, floor: float) -> DataFrame:
    """Rows at which a value crosses the floor of materiality against the row before."""
    was = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("was", was).where((F.col("was") >= floor) != (F.col(value) >= floor))


def role_changes(df: DataFrame, keys: list[str], order: str, role: str) -> DataFrame:
    """Roles that came and went between neighbouring periods of each key."""
    sets = df.groupBy(*keys, order).agg(F.sort_array(F.collect_set(role)).alias("roles"))
    was = F.lag("roles").over(Window.partitionBy(*keys).orderBy(order))
    got = sets.withColumn("was", was).where("was is not null and roles != was")
    return got.select(*keys, order, F.array_except("roles", "was").alias("added"), F.array_except("was", "roles").alias("lost"))
