"""A table of partitions that are replaced whole, each load seen by readers at once or not at all.

A load writes its partitions to a folder of its own, by Spark's partitioned writer. Partitions
whose rows and digest are as before are left out. What the replaced ones no longer
hold is written as a list of removed keys, and a partition that is gone leaves a
tombstone. Only then the record that names each partition's folder is written. Readers
go by the record, so a writer that dies before it leaves the table as it was, and its
load can be run again under the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import partition_digest
from .commits import CommitLog

#: Column of the writer that names a partition's folder.
PART = "stored_part"


class PartitionedTable:
    """``parts``: columns that name a partition; ``keys``: columns that name a row in it; ``ignore``: stamps that are no difference.

    A record holds an entry for each partition, and is written by the driver: tables of up to
    some hundred thousand partitions.
    """

    def __init__(self, spark: SparkSession, root: str, schema, parts: list[str], keys: list[str], ignore: tuple[str, ...] = ()):
        self.spark, self.root, self.schema, self.parts, self.keys, self.ignore = spark, root.rstrip("/"), schema, parts, keys, ignore
        self.log = CommitLog(spark, self.root)
        if PART in schema.names:
            raise ValueError(f"{PART} is a name of the store")

    def _name(self) -> Column:
        return F.substring(F.sha2(F.to_json(F.struct(*self.parts), {"ignoreNullFields": "false"}), 256), 1, 24)

    def _read(self, record: dict, only: set[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/data/{p['load']}/{PART}={name}" for name, p in record.items() if p["load"] is not None and (only is None or name in only)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def rows(self, number: int | None = None) -> DataFrame:
        """All rows as of a load (the last)."""
        return self._read(self.log.last()[1].get("parts", {}) if number is None else self.log.read(number)["parts"])

    def replace(self, new: DataFrame, number: int, whole: bool = False, dropped: DataFrame | None = None) -> dict[str, int]:
        """Load ``number``: the partitions that ``new`` holds replace theirs; how many were replaced, left and dropped.

        A partition that ``new`` lacks is kept, so that an empty source never wipes the table;
        it goes if ``dropped`` names it, or with ``whole``. A load that is committed is left alone.
        """
        if self.log.has(number):
            return self.log.read(number)["counts"]
        had = self.log.last(below=number)[1].get("parts", {})
        new.select(*self.schema.names).withColumn(PART, self._name()).repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(f"{self.root}/data/{number}")
        if not any(n.startswith(f"{PART}=") for n in self.log.files.names(f"data/{number}")):
            found = []
        else:
            staged = self.spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in self.schema)}, {PART} string").parquet(f"{self.root}/data/{number}")
            found = partition_digest(staged, [PART], self.ignore).collect()  # a row for each partition
        fresh = {r[PART]: {"load": number, "rows": r["rows"], "digest": r["digest"]} for r in found}
        changed = {n for n, p in fresh.items() if n not in had or had[n]["load"] is None or (had[n]["rows"], had[n]["digest"]) != (p["rows"], p["digest"])}
        live = {n for n, p in had.items() if p["load"] is not None}
        gone = live - set(fresh) if whole else set()
        if dropped is not None:
            gone |= {r[0] for r in dropped.select(self._name()).distinct().collect()} & (live - set(fresh))
        self._write_removed(number, had, {**had, **fresh}, changed & live, gone)
        record = {**had, **{n: fresh[n] for n in changed}, **{n: {"load": None, "rows": 0, "digest": None} for n in gone}}
        counts = {"replaced": len(changed), "left": len(fresh) - len(changed), "dropped": len(gone)}
        self.log.commit(number, {"parts": record, "replaced": sorted(changed), "dropped": sorted(gone), "counts": counts})
        for n in set(fresh) - changed:
            self.log.files.delete(f"data/{number}/{PART}={n}")
        return counts

    def _write_removed(self, number: int, had: dict, now: dict, changed: set[str], gone: set[str]) -> None:
        """Partition, keys and how (rows, or the whole partition) of what the load takes away."""
        columns = list(dict.fromkeys([*self.parts, *self.keys]))
        old, new = self._read(had, changed).select(*columns), self._read(now, changed).select(*columns)
        lost = old.alias("o").join(new.alias("n"), [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns], "left_anti").withColumn("how", F.lit("rows"))
        out = lost.unionByName(self._read(had, gone).select(*columns).withColumn("how", F.lit("partition")))
        out.write.mode("overwrite").parquet(f"{self.root}/removed/{number}")

    def removed(self, after: int = -1) -> DataFrame:
        """The outbox: what committed loads after ``after`` took away, with the load's number."""
        numbers = [n for n in self.log.numbers() if n > after]
        columns = list(dict.fromkeys([*self.parts, *self.keys]))
        out = self.spark.createDataFrame([], self.schema).select(*columns, F.lit("").alias("how"), F.lit(0).alias("load"))
        for n in numbers:
            out = out.unionByName(self.spark.read.parquet(f"{self.root}/removed/{n}").withColumn("load", F.lit(n)))
        return out

    def replaced(self, number: int) -> DataFrame:
        """Rows of the partitions that a load replaced."""
        record = self.log.read(number)
        return self._read(record["parts"], set(record["replaced"]))
