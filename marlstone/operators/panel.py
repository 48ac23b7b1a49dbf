"""Entities by period: shares, concentration, ranks, and statistics of a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_sum(column: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(column.cast("decimal(38,6)"))


def shares(df: DataFrame, period: str, entity: str, value: str) -> DataFrame:
    """Share of the period's positive values, and rank by value (then by entity)."""
    positive = F.when(F.col(value) > 0, F.col(value))
    w = Window.partitionBy(period)
    got = df.withColumn("_total", exact_sum(positive).over(w).cast("double")).withColumn("rank", F.row_number().over(w.orderBy(F.col(value).desc(), entity)))
    return got.select(period, entity, value, F.when(F.col("_total") > 0, positive / F.col("_total")).alias("share"), "rank")


def concentration(shared: DataFrame, period: str) -> DataFrame:
    """Herfindahl index: squared shares times 10 000."""
    return shared.groupBy(period).agg((F.sum((F.col("share") * F.col("share")).cast("decimal(38,18)")).cast("double") * 10000).alias("hhi"), F.count("share").alias("members"))


def league(shared: DataFrame, period: str, entity: str, back: int = 4) -> DataFrame:
    """Change of rank since the period before, and of share since ``back`` periods of the list."""
    periods = shared.groupBy(period).agg(F.count("*").alias("_n"))
    number = F.row_number().over(Window.orderBy(period))  # one row per period
    at = shared.join(F.broadcast(periods.select(period, number.alias("_p"))), period)
    w = Window.partitionBy(entity).orderBy("_p")
    # rows of an entity may miss periods: look for the one that lies exactly so far back
    then = lambda column, n: F.coalesce(*(F.when(F.lag("_p", k).over(w) == F.col("_p") - n, F.lag(column, k).over(w)) for k in range(1, n + 1)))
    return at.select(period, entity, "share", "rank", (then("rank", 1) - F.col("rank")).alias("rank_change"), (F.col("share") - then("share", back)).alias("share_shift"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean weighted where the value is there."""
    return exact_sum(value * weight).cast("double") / exact_sum(F.when(value.isNotNull(), weight)).cast("double")


#: Distinct values of a key that one window may hold; more are cut to ``PIECES`` by quantiles of their own.
LARGE_KEY, PIECES = 100_000, 64


def value_ranks(df: DataFrame, keys: list[str], value: str, large: int = LARGE_KEY) -> DataFrame:
    """``keys, value, ties, below, there``: how often each non-null value occurs, how many rows of the key are less, and how many there are.

    Values are counted first, and counts are added up by windows. Values of a key that
    has over ``large`` distinct ones are cut to pieces at quantiles of these values, so that no
    window holds more than a ``PIECES``-th of them, however near to one another they are; how many lie
    in the pieces below is added to them.
    """
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"))
    cuts = [k / PIECES for k in range(1, PIECES)]
    bounds = counts.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count("*").alias("_n"), F.percentile_approx(v, cuts, 1000).alias("_cuts")).where(F.col("_n") > large)
    own = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] or [F.lit(True)]
    at = counts.join(bounds.drop("_n"), own, "left").withColumn("_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < v))))
    at = at.select(*keys, value, "ties", "_piece", F.col("_cuts").isNotNull().alias("_large"))
    piece = Window.partitionBy(*keys, "_piece")
    inside = F.coalesce(F.sum("ties").over(piece.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = at.withColumn("_inside", inside).withColumn("_all", F.sum("ties").over(piece))
    # a row for each piece of the large keys
    totals = at.where("_large").groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_piece").alias("_p")).agg(F.sum("ties").alias("_t"))
    over = Window.partitionBy(*(f"_{k}" for k in keys))
    before = F.coalesce(F.sum("_t").over(over.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*(f"_{k}" for k in keys), "_p", before.alias("_before"), F.sum("_t").over(over).alias("_there"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_piece") == F.col("_p"), F.col("_large")]
    got = got.join(totals, same, "left")
    return got.select(*keys, value, "ties", (F.col("_inside") + F.coalesce("_before", F.lit(0))).alias("below"), F.coalesce("_there", "_all").alias("there"))


def with_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every row with ``ties, below, there`` of its value; null values and those of no key get nulls."""
    ranks = value_ranks(df, keys, value)
    ranks = ranks.select(*(F.col(c).alias(f"_{c}") for c in (*keys, value)), "ties", "below", "there")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(value) == F.col(f"_{value}")]
    return df.join(ranks, same, "left").select(*df.columns, "ties", "below", "there")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], names: list[str]) -> DataFrame:
    """Quantiles of each key by linear interpolation between neighbouring values, and ``there``, the number of values."""
    ranks = value_ranks(df, keys, value)
    out = []
    for q, name in zip(shares, names, strict=True):
        at = (F.col("there") - 1) * F.lit(q)
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("ties"))
        low, high = (F.max(F.when(holds(f(at)), F.col(value))) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return ranks.groupBy(*keys).agg(*out, F.max("there").alias("there"))


def midrank_score(df: DataFrame, keys: list[str], value: str, higher_is_worse: bool = False, out: str = "score") -> DataFrame:
    """(mean rank - 1) / (n - 1) with tied ranks averaged; alone 0.5; null stays null. No ``keys``: the whole table is one field."""
    mean = F.col("below") + (F.col("ties") + 1) / 2
    score = F.when(F.col("there") == 1, 0.5).otherwise((mean - 1) / F.nullif(F.col("there") - 1, F.lit(0)))
    return with_ranks(df, keys, value).withColumn(out, 1 - score if higher_is_worse else score).select(*df.columns, out)


def peer_rank(df: DataFrame, entity: str, group: str, value: str, least: int = 8) -> DataFrame:
    """Rank in the own class if it has ``least`` members, else in the whole field; null under ``least``. Equal values rank by entity."""
    some = df.where(F.col(value).isNotNull())
    own = with_ranks(some, [group], value).withColumnsRenamed({"ties": "own_ties", "below": "own_below", "there": "own_n"})
    both = with_ranks(own, [], value)
    tied = lambda *k: F.row_number().over(Window.partitionBy(*k, value).orderBy(entity))
    in_class = F.col("own_n") - F.col("own_below") - F.col("own_ties") + tied(group)
    in_all = F.col("there") - F.col("below") - F.col("ties") + tied()
    large, enough = F.col("own_n") >= least, F.col("there") >= least
    return both.select(entity, group, value, F.when(large, F.col(group)).when(enough, F.lit("all")).alias("field"), F.when(large, in_class).when(enough, in_all).alias("rank"))


def capped_z(value: Column, mean: Column, deviation: Column, n: Column, cap: float = 8.0, least: int = 6) -> Column:
    """Distance from the history in deviations, capped; a history without spread gives 0 or the cap."""
    z = F.when(deviation > 0, F.abs((value - mean) / F.nullif(deviation, F.lit(0.0)))).otherwise(F.when(value == mean, 0.0).otherwise(cap))
    return F.when(n >= least, F.least(z, F.lit(cap)))


def latest_common(df: DataFrame, period: str, entity: str, least: int) -> DataFrame:
    """The last period that has ``least`` distinct entities."""
    return df.groupBy(period).agg(F.countDistinct(entity).alias("n")).where(F.col("n") >= least).orderBy(F.col(period).desc()).limit(1)


def with_residual(df: DataFrame, keys: list[str], label: str, value: str, least: float = 0.004) -> DataFrame:
    """Shares of ``least`` or more, the others folded into one row ``other``."""
    totals = df.groupBy(*keys).agg(exact_sum(F.col(value)).cast("double").alias("total"))
    at = df.join(totals, keys).withColumn("share", F.when(F.col("total") > 0, F.col(value) / F.col("total")))
    name = F.when(F.col("share") >= least, F.col(label)).otherwise(F.lit("other"))
    return at.groupBy(*keys, name.alias(label)).agg(exact_sum(F.col("share")).cast("double").alias("share"))


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order``, aggregated on the map side."""
    top = F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *(F.col(f"_top.{c}").alias(c) for c in columns))
