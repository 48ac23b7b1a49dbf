"""Stored tables: revisions kept by streams, partitions replaced on storage, removed keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.partitioned import PartitionedTable
from ..sources.tables import shared_dir, table
from ..streaming import revisions
from ..streaming import weekly as W
from .registry import query

#: Files that the queries hand their streams, and files a batch takes.
DROPS, PER_BATCH = 6, 2


def _folder(spark, label):
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _with_drafts(spark, sf):
    """Events, and for each tenth a draft that a later revision replaces, shuffled over several files."""
    at = table(spark, sf, "events").withColumn("revision", F.lit(1))
    draft = at.where("event_id % 10 = 0").withColumn("value", F.col("value") + 1).withColumn("revision", F.lit(0))
    return at.unionByName(draft).repartition(DROPS, F.xxhash64("event_id", "revision"))


@query("""SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL""")
def stream_weekly(spark, sf):
    """Weekly sums kept by a stream over drafts and revisions in any order; they are the sums of the last revisions."""
    at = _folder(spark, "weekly")
    rows = _with_drafts(spark, sf)
    rows.write.parquet(f"{at}/in")
    store = W.weekly_store(spark, f"{at}/store", rows.schema, ["revision"])
    revisions.run(spark, f"{at}/in", rows.schema, store, PER_BATCH)
    store.vacuum()
    return W.weekly_sums(store)


@query("""SELECT user_id, event_type, ts::DATE AS d, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def stream_latest(spark, sf):
    """The last event of each user, type and day, kept by a stream whose files come in any order."""
    at = _folder(spark, "latest")
    rows = table(spark, sf, "events", ["user_id", "event_type", "ts", "event_id", "value"]).withColumn("d", F.to_date("ts"))
    rows.repartition(DROPS, "event_id").write.parquet(f"{at}/in")
    store = revisions.RevisionStore(spark, f"{at}/store", rows.schema, ["user_id", "event_type", "d"], ["ts", "event_id"])
    revisions.run(spark, f"{at}/in", rows.schema, store, PER_BATCH)
    store.vacuum()
    return store.rows().select("user_id", "event_type", "d", "event_id", "value")


@query("""WITH b AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS mid FROM events) SELECT event_id, CASE WHEN ts < mid THEN 'revised' ELSE 'new' END AS status, CASE WHEN ts < mid THEN value END AS was, CASE WHEN ts < mid THEN value + 1 ELSE value END AS now FROM events, b WHERE ts >= mid OR (ts >= mid - INTERVAL 2 DAY AND event_id % 7 = 0)""")
def overlap_refetch(spark, sf):
    """A second fetch that begins two days before the first one ended: only new and revised rows count as changed."""
    events = table(spark, sf, "events", ["event_id", "ts", "value"])
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    at = events.crossJoin(F.broadcast(span)).withColumn("mid", F.expr("a + (b - a) / 2"))
    first = at.where("ts < mid").select("event_id", "ts", "value", F.lit(0).alias("fetch"))
    second = at.where("ts >= mid - INTERVAL 2 DAY").select("event_id", "ts", F.when((F.col("ts") < F.col("mid")) & (F.col("event_id") % 7 == 0), F.col("value") + 1).otherwise(F.col("value")).alias("value"), F.lit(0).alias("fetch"))
    store = revisions.RevisionStore(spark, _folder(spark, "fetches"), first.schema, ["event_id"], ["fetch"])
    store.merge(first, 0)
    store.merge(second, 1)
    return store.changes(1).select("event_id", "status", F.col("was.value").alias("was"), F.col("now.value").alias("now"))


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("part"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))


@query("""WITH o AS (SELECT o_orderpriority AS part, o_orderkey AS k, o_totalprice AS v FROM orders), n AS (SELECT part, k, CASE WHEN part = '1-URGENT' AND k % 2 = 0 THEN v + 1 ELSE v END AS v FROM o WHERE part <> '5-LOW') SELECT part, k, v, part = '1-URGENT' AS replaced FROM n UNION ALL SELECT part, k, v, false FROM o WHERE part = '5-LOW'""")
def partition_replace(spark, sf):
    """Stored partitions whose digest changed are replaced whole; one that the load lacks is kept."""
    old = _orders(spark, sf)
    store = PartitionedTable(spark, _folder(spark, "orders"), old.schema, ["part"], ["k"])
    store.replace(old, 0)
    store.replace(old.where("part != '5-LOW'").withColumn("v", F.when((F.col("part") == "1-URGENT") & (F.col("k") % 2 == 0), F.col("v") + 1).otherwise(F.col("v"))), 1)
    names = store.replaced(1).select("part").distinct().withColumn("replaced", F.lit(True))
    return store.rows().join(F.broadcast(names), "part", "left").select("part", "k", "v", F.coalesce("replaced", F.lit(False)).alias("replaced"))


@query("""WITH o AS (SELECT o_orderkey AS k, date_trunc('month', o_orderdate)::DATE AS part, o_totalprice AS v FROM orders), l AS (SELECT max(part) AS part FROM o) SELECT o.part, k, CASE WHEN o.part = l.part THEN 'partition' ELSE 'rows' END AS how FROM o, l WHERE o.part = l.part OR k % 13 = 0""")
def partition_removed(spark, sf):
    """Keys that a load of whole partitions takes away: some rows of each month, and the last month altogether."""
    old = table(spark, sf, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("part"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    store = PartitionedTable(spark, _folder(spark, "months"), old.schema, ["part"], ["k"])
    store.replace(old, 0)
    last = old.agg(F.max("part").alias("last"))
    store.replace(old.crossJoin(F.broadcast(last)).where("part < last and k % 13 != 0").drop("last"), 1, whole=True)
    return store.removed(after=0).select("part", "k", "how")
