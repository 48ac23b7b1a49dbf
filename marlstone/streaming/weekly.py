"""Weekly sums of events, in one batch or kept by a stream in which late and revised rows count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import changes
from .revisions import RevisionStore


def week_columns() -> tuple[dict, dict]:
    """Groups and measures of weekly sums."""
    return {"week": F.to_date(F.date_trunc("week", "ts")), "event_type": F.col("event_type")}, {"n": F.lit(1).cast("long"), "total": F.col("value").cast("decimal(18,2)")}


def weekly_counts(events: DataFrame) -> DataFrame:
    """``week, event_type, n, total`` of all events."""
    groups, measures = week_columns()
    at = events.select(*(e.alias(c) for c, e in groups.items()), F.col("value").cast("decimal(18,2)").alias("v"))
    return at.groupBy(*groups).agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("total"))


def weekly_store(spark: SparkSession, root: str, schema, order: list[str]) -> RevisionStore:
    """Events by id, the newest revision of each, and their weekly sums."""
    groups, measures = week_columns()
    return RevisionStore(spark, root, schema, ["event_id"], order, groups, measures)


def weekly_sums(store: RevisionStore) -> DataFrame:
    return store.sums().select("week", "event_type", "n", F.col("total").cast("double").alias("total"))


def day_changes(old: DataFrame, new: DataFrame, keys: list[str], stamps: tuple[str, ...] = ()) -> DataFrame:
    """What a re-read of an overlapping window changes; equal rows write nothing."""
    return changes(old, new, keys, stamps).where("status != 'gone'")
