"""Keyed rows that a stream keeps for good: the newest revision of a key wins, whenever it arrives.

State lies in buckets of keys. A batch is reduced to its newest row of each key, meets the
buckets that it touches, and writes those of them that it changed anew; a record that
names each bucket's folder is written last. So a batch that fails half-way leaves the state
before it, one that is replayed after its record changes nothing, and nothing expires.
What is newest is the greatest of order columns and then values, which doesn't depend on
how rows are dealt out to batches.

Sums over the rows are kept beside them: a batch adds what its changed rows are now and
takes off what they were, so no batch reads the rows that it doesn't change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog

BUCKETS = 16


class RevisionStore:
    """``keys``: what names a row; ``order``: columns whose greatest values are the newest.

    ``groups`` and ``measures``: names and expressions of a view of sums over the rows, kept up to date.
    """

    def __init__(self, spark: SparkSession, root: str, schema, keys: list[str], order: list[str], groups: dict[str, Column] | None = None, measures: dict[str, Column] | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.keys, self.order, self.groups, self.measures, self.buckets = keys, order, groups or {}, measures or {}, buckets
        self.values = [c for c in schema.names if c not in keys and c not in order]
        self.log = CommitLog(spark, self.root)

    def _row(self) -> Column:
        return F.struct(*self.order, *self.values)

    def _read(self, buckets: dict[str, int]) -> DataFrame:
        """Keys and newest row of the buckets."""
        paths = [f"{self.root}/data/{n}/bucket={b}" for b, n in buckets.items()]
        if not paths:
            return self.spark.createDataFrame([], self.schema).select(*self.keys, self._row().alias("now"))
        return self.spark.read.parquet(*paths).select(*self.keys, "now")

    def rows(self, number: int | None = None) -> DataFrame:
        """The newest row of each key, as of a commit (the last)."""
        record = self.log.read(number) if number is not None else self.log.last()[1]
        return self._read(record.get("buckets", {})).select(*self.keys, "now.*").select(*self.schema.names)

    def changes(self, number: int) -> DataFrame:
        """What a batch changed: keys, ``status`` (new or revised), ``was`` and ``now``."""
        record = self.log.read(number)
        paths = [f"{self.root}/data/{n}/bucket={b}" for b, n in record["buckets"].items() if n == number]
        if not paths:
            return self._read({}).select(*self.keys, F.lit("new").alias("status"), F.col("now").alias("was"), "now")
        return self.spark.read.parquet(*paths).where("changed").select(*self.keys, F.when(F.col("was").isNull(), "new").otherwise("revised").alias("status"), "was", "now")

    def sums(self, number: int | None = None) -> DataFrame:
        """The view: groups and sums of the measures, groups without rows left out."""
        number, record = self.log.last() if number is None else (number, self.log.read(number))
        return self.spark.read.parquet(f"{self.root}/sums/{record['sums']}").where("rows > 0").select(*self.groups, *(F.when(F.col(f"{m} known") > 0, F.col(m)).alias(m) for m in self.measures))

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take in a batch; one that is committed already is left alone."""
        if self.log.has(number):
            return
        before = self.log.last(below=number)[1]
        had = before.get("buckets", {})
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        newest = batch.select(*self.schema.names).groupBy(*self.keys).agg(F.max(self._row()).alias("now"))
        # staged by the batch's own session, read by the store's
        newest.withColumn("bucket", bucket).write.mode("overwrite").parquet(f"{self.root}/staged/{number}")
        staged = self.spark.read.parquet(f"{self.root}/staged/{number}")
        touched = [str(r["bucket"]) for r in staged.select("bucket").distinct().collect()]
        old = self._read({b: had[b] for b in touched if b in had})
        both = old.select(*self.keys, F.col("now").alias("was"), "now").unionByName(staged.select(*self.keys, F.lit(None).cast(old.schema["now"].dataType).alias("was"), "now"))
        merged = both.groupBy(*self.keys).agg(F.max("was").alias("was"), F.max("now").alias("now"))
        changed = ~F.col("was").eqNullSafe(F.col("now"))
        merged = merged.select(*self.keys, F.when(changed, F.col("was")).alias("was"), "now", changed.alias("changed"), bucket.alias("bucket"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/{number}")
        new = {str(r["bucket"]): number for r in self.spark.read.parquet(f"{self.root}/data/{number}").where("changed").select("bucket").distinct().collect()} if touched else {}
        for b in set(touched) - set(new):  # nothing in it changed
            self.log.files.delete(f"data/{number}/bucket={b}")
        record = {"buckets": {**had, **new}, "sums": before.get("sums")}
        if self.groups and (new or record["sums"] is None):
            self._add_sums(number, new, before.get("sums"))
            record["sums"] = number
        self.log.commit(number, record)
        self.log.files.delete(f"staged/{number}")

    def _add_sums(self, number: int, new: dict[str, int], last: int | None) -> None:
        data = self.spark.read.parquet(*(f"{self.root}/data/{n}/bucket={b}" for b, n in new.items())).where("changed") if new else self._read({}).withColumn("was", F.col("now"))
        # how many rows have a value of a measure: where none has, its sum is null
        known = lambda sign: [F.when(e.isNotNull(), sign).otherwise(0).cast("long").alias(f"{m} known") for m, e in self.measures.items()]
        flat = lambda c, sign: data.where(F.col(c).isNotNull()).select(*self.keys, f"{c}.*").select(*(e.alias(g) for g, e in self.groups.items()), *((e * sign).alias(m) for m, e in self.measures.items()), *known(sign), F.lit(sign).cast("long").alias("rows"))
        counts = [*(f"{m} known" for m in self.measures), "rows"]
        parts = [flat("now", 1), flat("was", -1)]
        if last is not None:
            parts.append(self.spark.read.parquet(f"{self.root}/sums/{last}").select(*self.groups, *self.measures, *counts))
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        summed = both.groupBy(*self.groups).agg(*(F.sum(c).alias(c) for c in (*self.measures, *counts)))
        kinds = {m: e for m, e in flat("now", 1).dtypes}
        summed.select(*self.groups, *(F.col(m).cast(kinds[m]).alias(m) for m in self.measures), *counts).write.mode("overwrite").parquet(f"{self.root}/sums/{number}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete what the last ``keep`` commits don't name."""
        last = self.log.numbers()[-keep:]
        records = [self.log.read(n) for n in last]
        used = {(b, n) for r in records for b, n in r["buckets"].items()}
        files = self.log.files
        for n in files.names("data"):
            kept = [b for b in files.names(f"data/{n}") if b.startswith("bucket=") and (b[7:], int(n)) in used]
            for b in files.names(f"data/{n}") if kept else ():
                if b.startswith("bucket=") and b not in kept:
                    files.delete(f"data/{n}/{b}")
            if not kept:
                files.delete(f"data/{n}")
        for n in files.names("sums"):
            if int(n) not in {r["sums"] for r in records}:
                files.delete(f"sums/{n}")


def run(spark: SparkSession, source: str, schema, store: RevisionStore, files_per_batch: int = 1) -> None:
    """Take in all files that are there as a stream, some at a time; the stream's own state lies beside the store's."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(store.merge).option("checkpointLocation", f"{store.root}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
