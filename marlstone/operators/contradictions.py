"""Statements on one subject whose values have nothing in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that one statement may give; more are an error, for its subsets are counted.
MOST_VALUES = 12


def subsets(values: Column) -> Column:
    """All subsets of an array but the empty one, in the array's order."""
    none = F.array().cast("array<array<string>>")
    grown = F.aggregate(values, F.concat(none, F.array(F.array().cast("array<string>"))), lambda a, v: F.concat(a, F.transform(a, lambda s: F.concat(s, F.array(v)))))
    return F.filter(grown, lambda s: F.size(s) > 0)


def conflicts(statements: DataFrame, subject: str, key: str, values: str) -> DataFrame:
    """``subject, key, conflicts, statements``: how many others on its subject each statement contradicts.

    ``values``: an array of texts. Statements agree if they share a value. Those that share one
    are counted by inclusion and exclusion over the subsets of the statement's values: how
    often each subset stands under a subject is one sum, so no pairs are formed and no
    task gets a subject's statements. A statement without values is none.
    """
    own = F.array_sort(F.array_distinct(F.filter(F.col(values).cast("array<string>"), lambda v: v.isNotNull())))
    at = statements.select(F.col(subject).alias("subject"), F.col(key).alias("key"), own.alias("vs")).where(F.size("vs") > 0)
    few = F.when(F.size("vs") <= MOST_VALUES, F.col("vs")).otherwise(F.raise_error(F.lit(f"over {MOST_VALUES} values in a statement")).cast("array<string>"))
    # equal sets of values first: few distinct ones meet the counts
    kinds = at.groupBy("subject", "vs").agg(F.count("*").alias("times"))
    parts = kinds.select("subject", "vs", "times", F.explode(subsets(few)).alias("subset"))
    often = parts.groupBy("subject", "subset").agg(F.sum("times").alias("n"))
    total = kinds.groupBy("subject").agg(F.sum("times").alias("statements"))
    sign = F.when(F.size("subset") % 2 == 1, F.col("n")).otherwise(-F.col("n"))
    agree = parts.join(often, ["subject", "subset"]).groupBy("subject", "vs").agg(F.sum(sign).alias("agree"))
    met = agree.join(total, "subject").select("subject", "vs", (F.col("statements") - F.col("agree")).alias("conflicts"), "statements")
    return at.join(met, ["subject", "vs"]).select(F.col("subject").alias(subject), F.col("key").alias(key), "conflicts", "statements")


def contradicted(found: DataFrame, subject: str) -> DataFrame:
    """Pairs that contradict each other, and statements, of each subject."""
    return found.groupBy(subject).agg((F.sum("conflicts") / 2).cast("bigint").alias("contradictions"), F.count("*").alias("bullets"))
