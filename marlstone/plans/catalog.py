"""A catalogue of series with stable codes, and reading of observations by code."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CODE = re.compile(r"^[A-Z]{2}\.[A-Z0-9]+\.[A-Z]\.\d{3,}\.[A-Z0-9]+$")
MAX_CODES, MAX_POINTS = 20, 2000


def long_form(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key and column of values; null values are left out."""
    return df.unpivot(keys, columns, "item", "v").where("v is not null")


def build(observations: DataFrame, dataset: str, frequency: str, group: str, stored: DataFrame | None = None) -> DataFrame:
    """Catalogue of ``item`` and ``group`` pairs: code, first and last date, observations.

    A pair keeps the slot it has in ``stored`` (item, slot); new items get the next
    slots in the order of their first date, then name.
    """
    stats = observations.groupBy("item", group).agg(F.min("d").alias("start_date"), F.max("d").alias("end_date"), F.count("v").alias("obs_count")).where("obs_count > 0")
    firsts = stats.groupBy("item").agg(F.min("start_date").alias("first"))
    if stored is not None:
        old = stored.select("item", "slot")
        top = old.agg(F.coalesce(F.max("slot"), F.lit(0)).alias("top"))
        new = firsts.join(old, "item", "left_anti").crossJoin(top).withColumn("slot", F.col("top") + F.row_number().over(Window.orderBy("first", "item"))).select("item", "slot")
        slots = old.unionByName(new)
    else:
        slots = firsts.withColumn("slot", F.row_number().over(Window.orderBy("first", "item"))).select("item", "slot")
    code = F.concat_ws(".", F.lit("MS"), F.lit(dataset), F.lit(frequency), F.format_string("%03d", F.col("slot")), F.upper(F.regexp_replace(F.col(group).cast("string"), "[^A-Za-z0-9]", "")))
    return stats.join(slots, "item").select(code.alias("series_code"), "item", group, "slot", "start_date", "end_date", "obs_count")


def lookup(catalogue: DataFrame, codes: list[str]) -> DataFrame:
    """Catalogue rows in the order asked for; unknown codes come back with nulls."""
    bad = [c for c in codes if not CODE.match(c)]
    if bad or len(codes) > MAX_CODES:
        raise ValueError(f"not codes: {bad}" if bad else f"at most {MAX_CODES} codes")
    asked = catalogue.sparkSession.createDataFrame([(c, i) for i, c in enumerate(codes)], "series_code string, pos int")
    return F.broadcast(asked).join(catalogue, "series_code", "left").orderBy("pos")


def observations(catalogue: DataFrame, facts: DataFrame, codes: list[str], group: str, start=None, end=None, limit: int = MAX_POINTS) -> DataFrame:
    """``series_code, d, v`` of the codes, the newest ``limit`` of each, within the dates."""
    keys = lookup(catalogue, codes).where("item is not null").select("series_code", "item", group)
    got = facts.join(F.broadcast(keys), ["item", group])
    if start is not None:
        got = got.where(F.col("d") >= F.lit(start).cast("date"))
    if end is not None:
        got = got.where(F.col("d") <= F.lit(end).cast("date"))
    newest = F.row_number().over(Window.partitionBy("series_code").orderBy(F.col("d").desc()))
    return got.withColumn("n", newest).where(F.col("n") <= limit).select("series_code", "d", "v")


def search(catalogue: DataFrame, term: str, page: int, size: int) -> tuple[DataFrame, int]:
    """A page of the rows whose code or item holds the term, and how many there are in all."""
    hit = catalogue.where(F.contains(F.lower("item"), F.lit(term.lower())) | F.contains(F.lower("series_code"), F.lit(term.lower())))
    return hit.orderBy("series_code").offset(page * size).limit(size), hit.count()
