"""From raw documents to token ids: what each stage rejects is gone for the next.

Each stage takes the documents that its predecessor kept, written and read again.
All but the last return the columns of ``documents``.

Every stage judges null and empty texts as its operator does: the rules reject them. Very
long texts are read whole. Of repeated rows, and of rows whose ids are null or repeated, each
is judged by itself, but that one row of a group of near duplicates stays. Columns
beside id and text pass unchanged, whatever their names. No documents give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, decontam, neighbours, quality_rules, simhash
from marlstone.llm.common import cut, discard, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.keep_good(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold; labels are learned from those not held out."""
    space = neighbours.training_space(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    name = quality_rules.free_name(docs, "quality_score")
    return neighbours.quality_score(docs, space, out=name).where(F.col(name) >= neighbours.THRESHOLD).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to."""
    return bpe.token_digests(bpe.bpe_encode(docs))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("near duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            kept = cut(kept, "pipeline")
            if k:
                discard(docs)  # the next stages read what was kept
        docs = kept
    return docs
