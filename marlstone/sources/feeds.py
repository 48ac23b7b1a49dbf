"""Feeds, listings and tables of pages as DataFrames."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("guid", "link", "title", "description", "pubDate")])


def canonical(link: Column) -> Column:
    """A link without fragment, query and closing slash, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(link, "[#?].*$", ""), "/+$", ""))


def news_items(spark: SparkSession, path: str, relevant: str, strong: str, against: str) -> DataFrame:
    """Items of RSS files: link and whether they matter.

    One matters if it matches ``relevant`` and, where it matches ``against``, also ``strong``.
    """
    got = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    text = F.concat_ws(" ", "title", "description")
    return got.select(F.coalesce("guid", "link").alias("external_id"), canonical(F.col("link")).alias("link"), "title", "description", "pubDate", (text.rlike(relevant) & (~text.rlike(against) | text.rlike(strong))).alias("relevant"))


def without_followed_hosts(items: DataFrame, followed: DataFrame) -> DataFrame:
    """Items whose host (column ``host`` of ``followed``) isn't read directly anyway."""
    host = F.regexp_replace(F.parse_url("link", F.lit("HOST")), r"^(www|m)\.", "")
    return items.withColumn("host", host).join(followed, "host", "left_anti").drop("host")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Stored objects as (entity, period, kind, size) by their names entity/period/kind.ext, without reading them."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)\.[^./]+$", k)
    return got.select(part(1).alias("entity"), part(2).alias("period"), part(3).alias("kind"), F.col("length").alias("size"))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def tables_of(html: str | None) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(html or "")
    p.close()
    return p.tables


@arrow_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def _tables(pages: pa.Array) -> pa.Array:
    return pa.array([tables_of(x) for x in pages.to_pylist()], pa.list_(pa.list_(pa.list_(pa.string()))))


def html_cells(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """``keys, table, row, col, cell`` of every table of the pages."""
    at = pages.select(*keys, F.posexplode(_tables(F.col(html).cast("string"))).alias("table", "rows"))
    at = at.select(*keys, "table", F.posexplode("rows").alias("row", "cells"))
    return at.select(*keys, "table", "row", F.posexplode("cells").alias("col", "cell"))


def scan(spark: SparkSession, sql: str, args: dict, columns: dict[str, str] | None = None, allowed: frozenset[str] = frozenset()) -> DataFrame:
    """A statement with bound values. ``columns``: placeholders {name} for columns, each from ``allowed``."""
    for name, column in (columns or {}).items():
        if column not in allowed:
            raise ValueError(f"{column} may not stand for {name}")
        sql = sql.replace("{" + name + "}", f"`{column}`")
    return spark.sql(sql, args=args)
