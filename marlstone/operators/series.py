"""Series algebra over grouped observations.

A series has group columns, a position (a date, or an integer ordinal of months or
quarters) and a value. Windows are partitioned by the group; positions are joined by
equality on shifted keys, so that gaps are seen as gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b where b > 0, else null."""
    return F.when(b > 0, a / b)


def magnitude_growth(now: Column, then: Column) -> Column:
    """100 (now - then) / |then|; null without a base."""
    return F.when(then != 0, (now - then) * 100 / F.abs(then))


def fisher(growth: Column, inflation: Column) -> Column:
    """Growth in real terms, in percent; null where prices fall by 100 or more."""
    return F.when(inflation > -100, ((1 + growth / 100) / (1 + inflation / 100) - 1) * 100)


def year_ago(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Rows with a row of the same keys one year before, and ``base``, its value."""
    before = df.select(*keys, (F.col(year) + 1).alias(year), F.col(value).alias("base"))
    return df.join(before, [*keys, year])


def tolerant_base(df: DataFrame, keys: list[str], date: str, value: str, days: int, shifts=(0, 7, -7)) -> DataFrame:
    """``base`` and ``elapsed`` of the first of the dates ``days`` + shift back that has a value."""
    tries = F.posexplode(F.array(*(F.lit(days + s) for s in shifts))).alias("rank", "elapsed")
    left = df.select("*", tries).withColumn("at", F.expr(f"date_sub({date}, elapsed)"))
    right = df.where(F.col(value).isNotNull()).select(*keys, F.col(date).alias("at"), F.col(value).alias("base"))
    met = left.join(right, [*keys, "at"])
    first = met.groupBy(*keys, date).agg(F.min_by(F.struct("base", "elapsed"), "rank").alias("b"), F.first(value).alias(value))
    return first.select(*keys, date, value, F.col("b.base").alias("base"), F.col("b.elapsed").alias("elapsed"))


def tolerant_growth(df: DataFrame, keys: list[str], date: str, value: str, weeks: int = 52, cutoff: str | None = None) -> DataFrame:
    """Growth against the tolerant base, raised to 364 days. A base of 0 or less gives no row."""
    got = tolerant_base(df, keys, date, value, 7 * weeks).where(F.col("base") > 0)
    if cutoff:
        got = got.where(F.col(date) >= F.to_date(F.lit(cutoff)))
    return got.select(*keys, date, ((F.pow(F.col(value) / F.col("base"), 364 / F.col("elapsed")) - 1) * 100).alias("growth"))


def lag_growth(df: DataFrame, keys: list[str], order: str, value: str, n: int, exponent: float = 1.0) -> DataFrame:
    """Growth against the n-th row before, by row and not by date; its value must be positive."""
    before = F.lag(value, n).over(Window.partitionBy(*keys).orderBy(order))
    got = df.withColumn("base", before).where(F.col("base") > 0)
    return got.select(*keys, order, ((F.pow(F.col(value) / F.col("base"), exponent) - 1) * 100).alias("growth"))


def rolling(df: DataFrame, keys: list[str], order: str, value: str, n: int, how: str = "sum", out: str = "rolled", contiguous: bool = False) -> DataFrame:
    """Sum or mean of the last n values; only complete windows.

    ``contiguous``: n neighbouring positions of an integer ``order``, else n rows.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    w = w.rangeBetween(-(n - 1), 0) if contiguous else w.rowsBetween(-(n - 1), 0)
    total = F.sum(F.col(value).cast("decimal(38,6)")).over(w).cast("double")
    return df.withColumn(out, F.when(F.count(value).over(w) == n, total / n if how == "avg" else total)).where(F.col(out).isNotNull())


def decumulate(df: DataFrame, keys: list[str], order: str, ytd: str, per_year: int = 4, out: str = "single") -> DataFrame:
    """Values of single periods from sums since the year's start; null after a gap."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.col(order) % per_year == 0
    follows = F.lag(order).over(w) == F.col(order) - 1
    return df.withColumn(out, F.when(first, F.col(ytd)).when(follows, F.col(ytd) - F.lag(ytd).over(w)))


def trailing_sum(df: DataFrame, keys: list[str], order: str, value: str, n: int = 4, out: str = "ttm") -> DataFrame:
    """Sum over the last n positions, null unless all are there."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(-(n - 1), 0)
    return df.withColumn(out, F.when(F.count(value).over(w) == n, F.sum(F.col(value).cast("decimal(38,6)")).over(w).cast("double")))


def average_stock(df: DataFrame, keys: list[str], order: str, value: str, points: int = 5, least: int = 2, out: str = "average", positive: bool = True) -> DataFrame:
    """Mean of the last ``points`` positions' values, positive ones if so asked; null under ``least``."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(-(points - 1), 0)
    v = F.when(F.col(value) > 0, F.col(value)) if positive else F.col(value)
    n = F.count(v).over(w)
    return df.withColumn(out, F.when(n >= least, F.sum(v.cast("decimal(38,6)")).over(w).cast("double") / n))


def asof(left: DataFrame, right: DataFrame, keys: list[str], date: str, value: str, lookback: int | None = None) -> DataFrame:
    """The value of ``right`` at its last date on or before each row of ``left``.

    Both sides meet in windows by key and month, without a range join; a month also
    gets the last value of the months before it, so a frequent key is many tasks.
    ``lookback``: days after which a value no longer holds.
    """
    cols = left.columns
    a = left.withColumn("_side", F.lit(1)).withColumn("_found", F.lit(None).cast(f"struct<at:date,v:{dict(right.dtypes)[value]}>"))
    b = right.where(F.col(value).isNotNull()).select(*(F.col(c) if c in (*keys, date) else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in cols), F.lit(0).alias("_side"), F.struct(F.col(date).alias("at"), F.col(value).alias("v")).alias("_found"))
    both = a.unionByName(b).withColumn("_month", F.trunc(date, "MM"))
    months = both.groupBy(*keys, "_month").agg(F.max("_found").alias("_top"))
    carried = F.last("_top", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1))  # a row per month
    months = months.select(*keys, "_month", carried.alias("_carried"))
    w = Window.partitionBy(*keys, "_month").orderBy(date, "_side").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_in", F.last("_found", ignorenulls=True).over(w)).where("_side = 1")
    for k in (*keys, "_month"):
        months = months.withColumnRenamed(k, f"{k}_m")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_m")) for k in (*keys, "_month")]
    got = got.join(months, same, "left").withColumn("_last", F.coalesce("_in", "_carried"))
    fresh = F.col("_last.v") if lookback is None else F.when(F.datediff(date, "_last.at") <= lookback, F.col("_last.v"))
    return got.select(*cols, fresh.alias(value))


def daily_steps(rates: DataFrame, date: str, value: str, upto) -> DataFrame:
    """A value for every day from a few changes of it: each holds until the next one, the last up to the day ``upto``.

    ``upto`` is the last day that is asked for (null: no day is); changes after it stay as they are.
    """
    after = F.coalesce(F.date_sub(F.lead(date).over(Window.orderBy(date)), 1), F.greatest(F.lit(upto).cast("date"), F.col(date)))  # a row per change
    return rates.select(date, value, after.alias("_to")).select(F.explode(F.sequence(date, "_to")).alias(date), value)


def combine(a: DataFrame, b: DataFrame, keys: list[str], value: str, how: str) -> DataFrame:
    """``a`` and ``b`` by shared keys: add, sub, mul or div (a divisor of 0 drops the row)."""
    x, y = F.col("x"), F.col("y")
    met = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys)
    if how == "div":
        met = met.where("y != 0")
    return met.select(*keys, {"add": x + y, "sub": x - y, "mul": x * y, "div": x / y}[how].alias(value))


def tail_run(df: DataFrame, keys: list[str], order: str, test: Column, out: str = "run") -> DataFrame:
    """How many of the last values in a row pass ``test``; null and failures end the run."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    fails = F.when(test, 0).otherwise(1)
    got = df.withColumn("_fails", fails).withColumn("_ended", F.sum("_fails").over(w))
    return got.groupBy(*keys).agg(F.sum(F.when(F.col("_ended") == 0, 1).otherwise(0)).alias(out))


def with_change(df: DataFrame, keys: list[str], order: str, value: str, out: str = "change") -> DataFrame:
    """The change against the row before."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def largest_step(df: DataFrame, keys: list[str], order: str, value: str, points: int = 13, factor: float = 3.0) -> DataFrame:
    """The largest change among the last ``points`` values, and whether it breaks with the others.

    The first of equal changes counts; a break is over ``factor`` times the others' mean.
    """
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    got = df.where(F.col(value).isNotNull()).withColumn("_n", last).where(F.col("_n") <= points)
    got = with_change(got, keys, order, value).where("change is not null")
    size = F.abs("change")
    agg = got.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(order).alias("at"), F.col("change").alias("step")), F.struct((-size).alias("s"), F.col(order).alias("o"))).alias("top"),
        F.count("*").alias("n"),
        F.sum(size.cast("decimal(38,6)")).cast("double").alias("total"),
        (F.max_by(value, order) - F.min_by(F.col(value) - F.col("change"), order)).alias("all_change"),
    )
    step = F.col("top.step")
    others = safe_div(F.col("total") - F.abs(step), F.col("n") - 1)
    return agg.select(*keys, F.col("top.at").alias("at"), step.alias("step"), (F.col("all_change") - step).alias("rest"), F.coalesce(F.abs(step) > factor * others, F.lit(False)).alias("breaks"))
