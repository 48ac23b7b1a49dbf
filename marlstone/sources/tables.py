"""Readers and writers of keyed tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of the folder; ``columns`` must be among its own."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns is None:
        return df
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"{name} has no columns {unknown}")
    return df.select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only where both are unset on a local master (tests) a temporary folder becomes
    the context's checkpoint folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        at = context.getCheckpointDir()
    return at


def money(column: str) -> Column:
    """An amount as a decimal, so that sums don't depend on their order."""
    return F.col(column).cast("decimal(18,2)")


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``y, m, g, v``: order value by month and market segment."""
    orders = table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    customers = table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return rows.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.col("c_mktsegment").alias("g")).agg(F.sum(money("o_totalprice")).cast("double").alias("v"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``g, d, v``: order value by status and day."""
    orders = table(spark, sf_dir, "orders", ["o_orderstatus", "o_orderdate", "o_totalprice"])
    return orders.groupBy(F.col("o_orderstatus").alias("g"), F.to_date("o_orderdate").alias("d")).agg(F.sum(money("o_totalprice")).cast("double").alias("v"))


def weekly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``g, d, v``: order value by status and ISO week (its Monday)."""
    orders = table(spark, sf_dir, "orders", ["o_orderstatus", "o_orderdate", "o_totalprice"])
    return orders.groupBy(F.col("o_orderstatus").alias("g"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("d")).agg(F.sum(money("o_totalprice")).cast("double").alias("v"))


def supplier_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``g, o, flow, stock, qty``: revenue, quantity and price level of a supplier by quarter ordinal."""
    lines = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"])
    ordinal = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int")
    return lines.groupBy(F.col("l_suppkey").alias("g"), ordinal.alias("o")).agg(
        F.sum(money("l_extendedprice")).cast("double").alias("flow"),
        F.max(money("l_extendedprice")).cast("double").alias("stock"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Wide table as CSV with a header; quotes double inside quoted cells."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN of floating columns as null."""
    return df.select(*(F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))
