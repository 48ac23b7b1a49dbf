"""Where a change comes from: steps and drift, parts of a total, legs of real growth; movements scored by surprise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import capped_z, exact_sum


def implied_ratio(stock: DataFrame, book: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, ratio``: stock in percent of book where both are there and the book is positive."""
    both = stock.select(*keys, F.col(value).alias("s")).join(book.select(*keys, F.col(value).alias("b")), keys)
    return both.where("s is not null and b > 0").select(*keys, (100 * F.col("s") / F.col("b")).alias("ratio"))


def step_and_drift(df: DataFrame, keys: list[str], order: str, value: str, span: int = 12, factor: float = 3.0) -> DataFrame:
    """The change over the last ``span`` steps of each series, cut into its largest move and the rest, and the drift since.

    Missing values are no observations. The largest move is the first of its size among the last
    ``span``; ``is_break`` tells whether it is over ``factor`` times the mean of the others. ``drift`` is by ``span``
    observations, null if the move is the last. Series of ``span`` observations or fewer are left out.
    """
    at = df.where(F.col(value).isNotNull()).select(*keys, F.col(order).alias("_o"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_o")
    at = at.withColumn("_move", F.col("_v") - F.lag("_v").over(w)).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_o").desc()))).where(F.col("_k") <= span + 1)
    moved = F.when(F.col("_k") <= span, F.abs("_move"))
    top = F.max_by(F.struct("_o", "_k", "_move", "_v"), F.when(F.col("_k") <= span, F.struct(F.abs("_move").alias("m"), F.col("_k")))).alias("_top")
    got = at.groupBy(*keys).agg(
        F.max(F.when(F.col("_k") == span + 1, F.col("_v"))).alias("start"), F.max(F.when(F.col("_k") == 1, F.col("_v"))).alias("end"),
        top, F.sum(moved.cast("decimal(38,6)")).cast("double").alias("_all"), F.count(moved).alias("_n"),
    ).where("start is not null")
    step, size = F.col("_top._move"), F.abs(F.col("_top._move"))
    others = F.when(F.col("_n") > 1, (F.col("_all") - size) / (F.col("_n") - 1)).otherwise(size)
    since, change = F.col("_top._k") - 1, F.col("end") - F.col("_top._v")
    return got.select(
        *keys, (F.col("end") - F.col("start")).alias("total"), F.col("_top._o").alias("step_at"), step.alias("step"), (F.col("end") - F.col("start") - step).alias("rest"),
        (size > factor * others).alias("is_break"), since.cast("int").alias("since"), F.when(since > 0, change).alias("change"), F.when(since > 0, change / since * span).alias("drift"),
    )


def attributed(parts: DataFrame, part: str, order: str, value: str, back: int) -> DataFrame:
    """``part, delta, share``: what each part adds to the change of the total over ``back`` steps to the last one.

    Parts without both ends are left out; the share is null if the total stands still.
    """
    total = parts.groupBy(order).agg(exact_sum(F.col(value)).cast("double").alias("_t"))
    last = total.agg(F.max(order).alias("_last"))  # one row
    both = lambda df, keys, v: df.join(F.broadcast(last)).groupBy(*keys).agg(*(F.max(F.when(F.col(order) == F.col("_last") - k, F.col(v))).alias(n) for n, k in (("now", 0), ("was", back))))
    whole = both(total, [], "_t").select((F.col("now") - F.col("was")).alias("_whole"))
    own = both(parts, [part], value).where("now is not null and was is not null").select(part, (F.col("now") - F.col("was")).alias("delta"))
    return own.join(F.broadcast(whole)).select(part, "delta", (100 * F.col("delta") / F.nullif("_whole", F.lit(0.0))).alias("share"))


def deflated(growth: Column, inflation: Column) -> Column:
    """Real growth in percent."""
    return ((1 + growth / 100) / (1 + inflation / 100) - 1) * 100


def growth_legs(rows: DataFrame, keys: list[str], order: str, nominal: str, adjusted: str, inflation: str) -> DataFrame:
    """From nominal to real growth at the last point where inflation is known: what currency and prices take.

    ``lagged`` tells that nominal growth is known for a later point. Legs add up to the ends.
    """
    real = F.when(F.col(inflation).isNotNull(), deflated(F.col(adjusted), F.col(inflation)))
    at = rows.withColumn("_real", real)
    last = F.max_by(F.struct(order, nominal, adjusted, "_real"), F.when(F.col("_real").isNotNull(), F.col(order))).alias("_x")
    got = at.groupBy(*keys).agg(last, F.max(F.when(F.col(nominal).isNotNull(), F.col(order))).alias("_newest")).where("_x is not null")
    n, a, r = F.col(f"_x.{nominal}"), F.col(f"_x.{adjusted}"), F.col("_x._real")
    return got.select(*keys, F.col(f"_x.{order}").alias("asof"), n.alias("nominal"), (n - a).alias("currency"), (a - r).alias("inflation"), r.alias("real"), (F.col("_newest") > F.col(f"_x.{order}")).alias("lagged"))


def next_event(days: DataFrame, day: str, events: DataFrame, event: str) -> DataFrame:
    """``day, next``: the first event on or after each distinct day; null after the last one.

    Days and events of a calendar are few: one window holds them.
    """
    both = days.select(F.col(day).alias("_d"), F.lit(None).cast("date").alias("_e")).distinct().unionByName(events.select(F.col(event).alias("_d"), F.col(event).alias("_e")).distinct())
    by_day = both.withColumn("_n", F.datediff("_d", F.lit("1970-01-01").cast("date")))
    ahead = F.min("_e").over(Window.orderBy("_n").rangeBetween(0, Window.unboundedFollowing))
    return by_day.withColumn("next", ahead).where("_e is null").select(F.col("_d").alias(day), "next")


def changelog(bullets: DataFrame, key: str, text: str, ids: str, sources: DataFrame, source: str, date: str, title: str, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """Statements re-keyed on the newest source that each cites; one that cites no known source is left out.

    ``checks``: pattern, and whether data agrees or conflicts (conditions on the newest source's columns). Of checks whose
    pattern the text meets, a conflict goes before an agreement.
    """
    cited = bullets.select(key, F.col(text).alias("_text"), F.explode(F.array_distinct(F.col(ids))).alias("_id"))
    known = sources.select(F.col(source).alias("_id"), F.col(date).alias("date"), F.col(title).alias("title"))
    newest = F.max_by(F.struct("_text", "date", "title", F.col("_id").alias("source")), F.struct("date", -F.col("_id"))).alias("x")
    got = cited.join(known, "_id").groupBy(key).agg(newest).select(key, "x.*")
    meets = lambda p: F.col("_text").rlike(p)
    conflict = F.coalesce(*(F.when(meets(p) & bad, F.lit(p)) for p, _, bad in checks))
    agree = F.coalesce(*(F.when(meets(p) & good, F.lit(p)) for p, good, _ in checks))
    return got.select(key, "date", "source", F.when(conflict.isNull(), agree).alias("agrees"), conflict.alias("conflicts"))


def movement_scores(df: DataFrame, entity: str, item: str, order: str, value: str, rollup: str, history: int = 16, least: float = 1.5) -> DataFrame:
    """Movements of items scored by how unusual they are: ``entity, item, order, z, share, flip, appeared, score``.

    The change on the period before is held against the item's own ``history`` changes (capped z, six at
    least), its share in all changes of the statement, and the statement's size; a changed sign and a
    first appearance add to the score, items that match ``rollup`` restate others and are damped. Periods are
    whole numbers; a missing one ends no stretch but gives no change.
    """
    w = Window.partitionBy(entity, item).orderBy(order)
    at = df.where(F.col(value).isNotNull()).select(entity, item, order, F.col(value).alias("v"))
    whole = Window.partitionBy(entity, order)
    at = at.withColumn("before", F.when(F.lag(order).over(w) == F.col(order) - 1, F.lag("v").over(w))).withColumn("first", F.row_number().over(w) == 1)
    at = at.withColumn("delta", F.col("v") - F.col("before"))
    past = w.rangeBetween(-history, -1)
    at = at.withColumn("mu", F.avg("delta").over(past)).withColumn("sd", F.stddev_pop("delta").over(past)).withColumn("n", F.count("delta").over(past))
    at = at.withColumn("moved", F.sum(F.abs("delta").cast("decimal(38,6)")).over(whole).cast("double")).withColumn("size", F.max(F.abs("v")).over(whole))
    at = at.withColumn("z", F.when(F.col("delta").isNotNull(), capped_z(F.col("delta"), F.col("mu"), F.col("sd"), F.col("n"))))
    share, size = F.when(F.col("moved") > 0, F.abs("delta") / F.col("moved")), F.when(F.col("size") > 0, F.abs("delta") / F.col("size"))
    flip = F.coalesce(F.signum("before") * F.signum("v") < 0, F.lit(False))
    appeared = F.col("first") & (F.col("v") != 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    raw = zero(F.col("z")) * 1.5 + F.least(zero(share), F.lit(0.6)) * 3 + F.least(zero(size), F.lit(0.05)) * 40 + F.when(flip, 2.0).otherwise(0.0) + F.when(appeared, 1.5).otherwise(0.0)
    score = raw * F.when(F.col(item).rlike(rollup), 0.4).otherwise(1.0)
    return at.select(entity, item, order, "z", share.alias("share"), flip.alias("flip"), appeared.alias("appeared"), score.alias("score")).where(F.col("score") >= least)
