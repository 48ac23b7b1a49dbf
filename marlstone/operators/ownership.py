"""Who owns whom: filed stakes as edges between entities, and entities joined by the holders they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of filings, the better source of one stake first.
PRECEDENCE = ("holder", "sub")
#: Entities that a holder may join to be spelled out as pairs.
PAIRS_UP_TO = 50


def links(rows: DataFrame, entity: str, kind: str, name: str, share: str, key: Column, aliases: DataFrame | None = None) -> DataFrame:
    """``entity, kind, key, label, share``: filed stakes under the key of the other side's name, aliases (``key, is``) resolved."""
    at = rows.select(F.col(entity).alias("entity"), F.col(kind).alias("kind"), key.alias("key"), F.col(name).alias("label"), F.col(share).alias("share")).where("key is not null and key != ''")
    if aliases is None:
        return at
    return at.join(aliases.select("key", F.col("is").alias("_is")), "key", "left").select("entity", "kind", F.coalesce("_is", "key").alias("key"), "label", "share")


def edges(stakes: DataFrame, entities: DataFrame) -> DataFrame:
    """``owner, owned, kind, share`` between entities, one for each pair and direction.

    A holder's filing says that the other side owns the entity, a subsidiary's that the
    entity owns the other side. Where both sides file one stake, the holder's counts; of
    filings of one kind the largest share. ``entities``: ``key, entity``.
    """
    met = stakes.join(entities.select("key", F.col("entity").alias("other")), "key")
    holds = F.col("kind") == PRECEDENCE[0]
    both = met.select(F.when(holds, F.col("other")).otherwise(F.col("entity")).alias("owner"), F.when(holds, F.col("entity")).otherwise(F.col("other")).alias("owned"), "kind", "share")
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("kind"))
    best = F.min_by(F.struct("kind", "share"), F.struct(rank, F.coalesce(-F.col("share"), F.lit(float("inf"))).alias("less")))
    return both.groupBy("owner", "owned").agg(best.alias("x")).select("owner", "owned", "x.kind", "x.share")


def shared(stakes: DataFrame, entities: DataFrame) -> DataFrame:
    """``key, label, degree, stakes`` of names that are no entity of their own and stand under two entities at least."""
    others = stakes.join(entities.select("key"), "key", "left_anti")
    pairs = others.groupBy("key", "entity").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    return pairs.groupBy("key").agg(F.min("label").alias("label"), F.count("*").alias("degree"), F.sum("n").alias("stakes")).where("degree >= 2")


def projection(stakes: DataFrame, entities: DataFrame, up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Entities joined by shared names: ``a, b, holder, weight, names``.

    A name under n entities joins each pair of them with weight 1 / (n - 1), so that all it
    gives an entity is 1. Names under ``up_to`` entities at most are spelled out as pairs,
    added up over names (``holder`` is null); a larger one stays a hub, a row for each entity
    with the hub in ``holder`` and weight 1, so rows are bounded by ``up_to`` / 2 times the stakes.
    """
    hubs = shared(stakes, entities).select("key", "degree")
    one = stakes.join(entities.select("key"), "key", "left_anti").select("key", "entity").distinct().join(hubs, "key")
    small = one.where(F.col("degree") <= up_to).groupBy("key", "degree").agg(F.sort_array(F.collect_set("entity")).alias("es"))
    pairs = F.flatten(F.transform("es", lambda a, i: F.transform(F.slice(F.col("es"), i + 2, F.col("degree").cast("int")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    spelled = small.select(F.explode(pairs).alias("p"), (1 / (F.col("degree") - 1)).alias("w")).groupBy("p.a", "p.b").agg(F.sum("w").alias("weight"), F.count("*").alias("names"))
    large = one.where(F.col("degree") > up_to).select(F.col("entity").alias("a"), F.lit(None).cast(one.schema["entity"].dataType).alias("b"), F.col("key").alias("holder"), F.lit(1.0).alias("weight"), F.lit(1).cast("bigint").alias("names"))
    return spelled.select("a", "b", F.lit(None).cast("string").alias("holder"), "weight", "names").unionByName(large.select("a", "b", F.col("holder").cast("string"), "weight", "names"))
