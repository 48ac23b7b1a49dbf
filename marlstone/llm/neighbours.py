"""Quality by the votes of nearest labelled neighbours in a latent-semantic space.

Terms are hashed byte n-grams, weighted by inverse document frequency, and one term
for how much of a text's three-word sequences are repeats; their latent directions
come from the labelled sample. The labelled vectors are broadcast (their
number is a parameter). Cosines of each document with all of them are exact blocked
products, and the nearest vote with the weight of their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import crc_mod, table, text_view, tidy, tune
from .decontam import grams, inner, word_hashes
from .features import bounded_sample, by_steps, ngram_counts, unit_rows

WIDTH, RANK, NEAREST, SHARPNESS, THRESHOLD = 1024, 64, 15, 8.0, 0.3
#: Expected labelled rows that are fitted and broadcast.
LABELLED = 3000


#: Shares of repeated three-word sequences at which the next term begins, and these terms' weight beside all others.
REPEATS, REPEAT_WEIGHT = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7), 1.0


def terms(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """A row for each text: n-gram counts, then a 1 at its term of repeats."""
    words, doc = word_hashes(data, docs)
    size = np.diff(doc)
    three = grams(words, 3, np.uint64(0x9E3779B97F4A7C15))
    of = np.repeat(np.arange(len(size)), size)[: len(three)]
    inside = inner(doc, 3, len(words))
    of, three = of[inside], three[inside]
    order = np.lexsort((three, of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (three[order][1:] != three[order][:-1]) | (of[order][1:] != of[order][:-1])
    n = len(size)
    share = 1 - np.bincount(of[order][fresh], minlength=n) / np.maximum(1, np.bincount(of, minlength=n))
    share[size < 3] = 0
    repeats = np.zeros((n, len(REPEATS) + 1), np.float32)
    repeats[np.arange(n), np.searchsorted(REPEATS, share, "right")] = 1
    return np.hstack([np.log1p(ngram_counts(data, docs, WIDTH)).astype(np.float32), repeats])


@dataclass
class Space:
    """Weights of terms, latent directions, and the labelled vectors with their labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Space:
        idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
        idf[WIDTH:] = 1
        t = Space.weigh(x, idf)
        _, vec = np.linalg.eigh(t.T.astype(np.float64) @ t)
        basis = vec[:, ::-1][:, :rank].astype(np.float32)
        return Space(idf.astype(np.float32), basis, unit_rows(t @ basis).astype(np.float32), labels.astype(np.float32))

    @staticmethod
    def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
        return np.hstack([unit_rows(x[:, :WIDTH] * idf[:WIDTH]), REPEAT_WEIGHT * x[:, WIDTH:]])

    def score(self, x: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
        own = unit_rows(self.weigh(x, self.idf) @ self.basis)
        near = own @ self.vectors.T
        k = min(nearest, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, axis=1), 1e-3) ** SHARPNESS
        return (weight * self.labels[at]).sum(axis=1) / weight.sum(axis=1)


def fit_space(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rank: int = RANK) -> Space | None:
    """Fit on ``doc_id, text`` rows that ``labels`` (doc_id, quality) marks 0 or 1. None if there are none."""
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = marked.count()
    if not n:
        return None
    few = bounded_sample(marked.select(F.lit(0).alias("all"), "quality", "doc_id"), {0: (n, labelled)}, "all", 5, ["doc_id"])
    # one row for each labelled id, however often documents repeat it
    some = rows.join(few.select("doc_id", "quality"), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")).select("quality", "text")

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                x = terms(*text_view(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("quality").cast(pa.int32()), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["quality", "x"])

    got = some.mapInArrow(tidy(run), "quality int, x binary").toArrow()
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, WIDTH + len(REPEATS) + 1).astype(np.float32)
    return Space.fit(x, got.column("quality").to_numpy(), min(rank, len(x)))


def quality_score(docs: DataFrame, space: Space | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` and ``out``, 0 to 1: higher where label 1 is likelier.

    Null and empty texts get the labelled rows' mean. Without labelled rows all
    scores are 0.5.
    """
    tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(space)

    @arrow_udf(T.DoubleType())
    @tidy
    def run(texts: pa.Array) -> pa.Array:
        def step(data, off, part):
            if held.value is None:
                return np.full(len(part), 0.5)
            got = held.value.score(terms(data, off))
            return np.where(np.diff(off) > 0, np.clip(got, 0, 1), held.value.labels.mean()).astype(np.float64)

        made = list(by_steps(texts, step))
        return pa.array(np.concatenate(made) if made else [], pa.float64())

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def held_out(column: str = "doc_id"):
    return crc_mod(column, 5) == 0


def training_space(docs: DataFrame, labels: DataFrame) -> Space | None:
    return fit_space(docs.where(~held_out()), labels.where(~held_out()))


def op5_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document.

    Null and empty texts are scored as texts without terms; very long ones count whole.
    Ties in similarity share their votes by the order of the learned rows; repeated rows get
    equal scores. Without labels all score alike; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality_score(docs, training_space(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_neighbour_quality": op5_neighbour_quality}
