"""Stores: batches in any split and order, replays, writers that die, removed keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marlstone.sources.commits import CommitLog
from marlstone.sources.partitioned import PartitionedTable
from marlstone.streaming import revisions
from marlstone.streaming import weekly as W

SCHEMA = "event_id long, ts timestamp, event_type string, value double, revision int"


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        for r in range(rng.randint(1, 3)):
            rows.append((k, dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 200)), rng.choice("ab"), float(rng.randint(1, 99)), r))
    return spark.createDataFrame(rows, SCHEMA).persist()


def last_revisions(events):
    newest = events.groupBy("event_id").agg(F.max(F.struct("revision", "ts", "event_type", "value")).alias("x"))
    return newest.select("event_id", "x.ts", "x.event_type", "x.value", "x.revision")


@pytest.mark.parametrize("files", [1, 8, 50])
def test_any_number_of_files(spark, events, tmp_path, files):
    events.repartition(files, F.xxhash64("value", "ts", "revision")).write.parquet(f"file://{tmp_path}/in")
    store = W.weekly_store(spark, f"file://{tmp_path}/store", events.schema, ["revision"])
    revisions.run(spark, f"file://{tmp_path}/in", events.schema, store, max(1, files // 4))
    want = last_revisions(events)
    assert sorted(store.rows().select(*want.columns).collect()) == sorted(want.collect())
    assert sorted(W.weekly_sums(store).collect()) == sorted(W.weekly_counts(want).collect())
    before = store.log.last()
    revisions.run(spark, f"file://{tmp_path}/in", events.schema, store)  # nothing is new
    assert store.log.last() == before


def test_replays_and_failures(spark, events, tmp_path, monkeypatch):
    store = W.weekly_store(spark, f"file://{tmp_path}/s", events.schema, ["revision"])
    store.merge(events.where("revision = 0"), 0)
    first = sorted(store.rows().collect())
    sums = sorted(W.weekly_sums(store).collect())

    def dies(self, number, record):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", dies)
        with pytest.raises(RuntimeError):
            store.merge(events, 1)
    assert sorted(store.rows().collect()) == first and sorted(W.weekly_sums(store).collect()) == sums
    store.merge(events, 1)
    want = sorted(last_revisions(events).select(*events.columns).collect())
    assert sorted(store.rows().collect()) == want
    store.merge(events.where("revision = 0").withColumn("value", F.lit(-1.0)), 1)  # committed: left alone
    store.merge(events.where("revision = 0"), 2)  # older than what is there
    assert sorted(store.rows().collect()) == want and store.changes(2).count() == 0
    record = store.log.read(2)
    assert all(n < 2 for n in record["buckets"].values())  # nothing was written again
    assert store.changes(1).where("status = 'revised'").count() == events.where("revision > 0").select("event_id").distinct().count()
    store.vacuum(1)
    assert sorted(store.rows().collect()) == want and sorted(W.weekly_sums(store).collect()) == sorted(W.weekly_counts(last_revisions(events)).collect())


def test_a_group_that_empties_goes(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    schema = spark.createDataFrame([], SCHEMA).schema
    store = W.weekly_store(spark, f"file://{tmp_path}/g", schema, ["revision"])
    store.merge(spark.createDataFrame([(1, day(1), "a", 1.0, 0), (2, day(1), None, None, 0)], SCHEMA), 0)
    store.merge(spark.createDataFrame([(1, day(9), "a", 3.0, 1)], SCHEMA), 1)
    assert {tuple(r) for r in W.weekly_sums(store).collect()} == {(dt.date(2024, 1, 8), "a", 1, 3.0), (dt.date(2024, 1, 1), None, 1, None)}
    store.merge(spark.createDataFrame([(1, day(9), "a", None, 2)], SCHEMA), 3)
    assert {tuple(r) for r in W.weekly_sums(store).where("event_type = 'a'").collect()} == {(dt.date(2024, 1, 8), "a", 1, None)}
    store.merge(spark.createDataFrame([], SCHEMA), 4)
    assert store.rows().count() == 2


@pytest.fixture()
def parts(spark, tmp_path):
    rows = [(p, k, float(k), n) for n, p in enumerate(["x", "y", None]) for k in range(20)]
    df = spark.createDataFrame(rows, "part string, k int, v double, stamp int")
    store = PartitionedTable(spark, f"file://{tmp_path}/p", df.schema, ["part"], ["k"], ("stamp",))
    assert store.replace(df, 0) == {"replaced": 3, "left": 0, "dropped": 0}
    return store, df


def test_equal_partitions_write_nothing(parts):
    store, df = parts
    assert store.replace(df.withColumn("stamp", F.lit(99)).repartition(5), 1) == {"replaced": 0, "left": 3, "dropped": 0}
    assert {p["load"] for p in store.log.read(1)["parts"].values()} == {0}
    assert store.rows().count() == 60 and store.removed(0).count() == 0


def test_replaced_and_dropped(spark, parts):
    store, df = parts
    new = df.where("part = 'x' and k < 15").unionByName(df.where("part is null"))
    assert store.replace(new, 1) == {"replaced": 1, "left": 1, "dropped": 0}
    assert {(r.part, r.k, r.how) for r in store.removed(0).collect()} == {("x", k, "rows") for k in range(15, 20)}
    assert store.rows().where("part = 'y'").count() == 20  # the load lacks it: kept
    assert store.replace(new.limit(0), 2) == {"replaced": 0, "left": 0, "dropped": 0} and store.rows().count() == 55
    assert store.replace(new, 3, whole=True)["dropped"] == 1 and store.rows().count() == 35
    assert {(r.part, r.how) for r in store.removed(2).collect()} == {("y", "partition")}
    assert store.replace(df.where("part = 'y'"), 4)["replaced"] == 1 and store.rows().count() == 55  # it comes back
    assert store.replace(new.limit(0), 5, dropped=spark.createDataFrame([("x",), ("unknown",)], "part string"))["dropped"] == 1
    assert store.rows().where("part = 'x'").count() == 0 and store.rows(0).count() == 60
    assert store.replace(df, 5) == store.log.read(5)["counts"] and store.rows().where("part = 'x'").count() == 0  # committed: left alone


def test_a_writer_that_dies_leaves_the_old_state(parts, monkeypatch):
    store, df = parts

    def dies(self, number, record):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", dies)
        with pytest.raises(RuntimeError):
            store.replace(df.withColumn("v", F.col("v") + 1), 1)
    assert sorted(map(str, store.rows().collect())) == sorted(map(str, df.collect())) and store.removed(0).count() == 0
    assert store.replace(df.withColumn("v", F.col("v") + 1), 1)["replaced"] == 3
    assert store.rows().agg(F.sum("v")).first()[0] == df.agg(F.sum("v")).first()[0] + 60


def test_commits_are_written_once(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/c")
    assert log.last() == (-1, {})
    log.commit(3, {"a": 1})
    log.commit(10, {"a": 2})
    assert log.last() == (10, {"a": 2}) and log.last(below=10) == (3, {"a": 1}) and log.numbers() == [3, 10]
    with pytest.raises(FileExistsError):
        log.commit(3, {})
