"""Keyed tables: universes of keys, priorities, healing, differences, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coalesce_sources(sources: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Every key that any source has; each value from the first source that has one.

    One aggregation over the tagged union: no chain of outer joins.
    """
    tagged = [s.select(*keys, F.lit(i).alias("_rank"), *values) for i, s in enumerate(sources)]
    both = reduce(DataFrame.unionByName, tagged)
    first = [F.min_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), F.col("_rank"))).alias(v) for v in values]
    return both.groupBy(*keys).agg(*first)


def heal_totals(df: DataFrame, keys: list[str], part: str, value: str, parts: tuple[str, str], total: str) -> DataFrame:
    """The table, and a ``total`` row of both parts for keys that have none."""
    a, b = (df.where(F.col(part) == p).select(*keys, F.col(value).alias(x)) for p, x in zip(parts, "ab", strict=True))
    have = df.where(F.col(part) == total).select(*keys)
    new = a.join(b, keys).join(have, keys, "left_anti").select(*keys, F.lit(total).alias(part), (F.col("a") + F.col("b")).alias(value))
    return df.select(*keys, part, value).unionByName(new)


def changes(old: DataFrame, new: DataFrame, keys: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` and ``status``: new, gone or changed. Columns in ``ignore`` (stamps) don't count; nulls are equal."""
    values = [c for c in new.columns if c not in (*keys, *ignore)]
    a = old.select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_had"))
    b = new.select(*keys, F.struct(*values).alias("_new"), F.lit(True).alias("_has"))
    got = a.join(b, keys, "full")
    status = F.when(F.col("_had").isNull(), "new").when(F.col("_has").isNull(), "gone").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return got.withColumn("status", status).where("status is not null").select(*keys, "status")


def row_hash(df: DataFrame, ignore: tuple[str, ...] = (), seed: int = 0) -> Column:
    """A 64-bit hash of a row's columns by name; null is unlike any text."""
    cols = sorted(c for c in df.columns if c not in ignore)
    return F.xxhash64(F.lit(seed), *(x for c in cols for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())))


def partition_digest(df: DataFrame, keys: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows and a digest of each partition, whatever the order of rows; repeated rows count."""
    sums = [F.sum(row_hash(df, ignore, seed).cast("decimal(38,0)")).cast("string") for seed in (0, 1)]
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.concat_ws(":", *sums).alias("digest"))


def unchanged(now: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Partitions of ``now`` whose digest is as stored."""
    return now.join(stored, [*keys, "rows", "digest"], "left_semi").select(*keys)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], stamp: str, keep_if_missing: tuple[str, ...] = ()) -> DataFrame:
    """Target after updates: the row of the newest stamp wins, so revisions replace what they revise.

    A column in ``keep_if_missing`` keeps its last non-null value.
    """
    both = target.withColumn("_turn", F.lit(0)).unionByName(updates.withColumn("_turn", F.lit(1)))
    order = F.struct(stamp, "_turn")
    cols = [c for c in target.columns if c not in keys]
    last = F.max_by(F.struct(*cols), order).alias("_last")
    kept = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in keep_if_missing]
    got = both.groupBy(*keys).agg(last, *kept)
    return got.select(*keys, *((F.col(f"_{c}") if c in keep_if_missing else F.col(f"_last.{c}")).alias(c) for c in cols)).select(*target.columns)


def shrink_guard(old: DataFrame, new: DataFrame, keys: list[str], text: str, share: float = 0.9, least: int = 100) -> DataFrame:
    """New rows but those whose text fell under ``share`` of the old one and by over ``least`` characters."""
    before = old.select(*keys, F.length(text).alias("_was"))
    got = new.join(before, keys, "left")
    shrunk = (F.length(text) < share * F.col("_was")) & (F.col("_was") - F.length(text) > least)
    return got.where(~F.coalesce(shrunk, F.lit(False))).select(*new.columns)


def emptied(log: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Partitions of the log that the table no longer has."""
    return log.select(*keys).distinct().join(table, keys, "left_anti")
