"""Importance resampling: rows are drawn so that their features come to resemble a target's.

A 256-byte table lower-cases a text and blanks its separators, ``bytes.split`` gives the
words. A run of words is known by the crc32 of its bytes: that of a longer run goes on
from that of the shorter one, so no run is ever put together. Counters hold what a task
has seen, and only their sums by bucket are shuffled. The logarithm of how much likelier
a bucket is in the target weighs a document; noise from a hash of its id turns the highest
scores into a draw without replacement (Gumbel's trick).
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import byte_list, cut, table, tidy
from .quality_rules import free_name
from .words import word_pieces

NGRAM = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
#: Features that a task keeps by themselves before it adds them to the buckets.
REMEMBERED = 1 << 20
#: Parts of the rows that agree in score and id.
SALTS = 64
FIELDS = ("n_words", "n_features", "weight", "score")


def runs(text: bytes, ngram: int):
    """For each piece of the text: its number of words, and crc32 of all runs of 1 to ``ngram`` words that end in it."""
    tail: list[bytes] = []
    for new in word_pieces(text):
        words = tail + new
        crcs, out = list(map(crc32, words)), []
        for k in range(1, ngram + 1):
            if k > 1:
                crcs = [crc32(b" " + w, c) for c, w in zip(crcs, words[k - 1 :], strict=False)]
            out.extend(crcs[max(0, len(tail) - k + 1) :] if tail else crcs)
        yield len(new), out
        tail = words[len(words) - ngram + 1 :] if 1 < ngram <= len(words) else words if ngram > 1 else []


def feature_counts(texts: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall in each bucket. Null and empty texts have none; an empty table gives zeros."""

    @tidy
    def run(batches):
        total, seen = np.zeros(buckets, np.int64), Counter()

        def put():
            if seen:
                at = np.fromiter(seen, np.int64, len(seen)) % buckets
                np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
                seen.clear()

        for b in batches:
            for text in byte_list(b.column(0)):
                for _, crcs in runs(text, ngram):
                    seen.update(crcs)
                    if len(seen) > REMEMBERED:
                        put()
        put()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in counted.collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of each bucket's share in the target and in the source, each smoothed by one a bucket."""
    s, t = float(sum(source) + len(source)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(source, target, strict=True)]


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256 of seed and id; a null id counts as the empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, seed: int = SEED, out: str = "importance") -> DataFrame:
    """``docs`` and a struct ``out``: n_words, n_features, weight (the floored mean gain), score (weight and noise).

    A text without words, null or empty, weighs 0. Texts of any length are read in
    pieces. Repeated rows are weighed alike. A column named ``out`` is replaced.
    """
    buckets = len(gain)

    @arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in FIELDS[:3]]))
    @tidy
    def run(texts: pa.Array) -> pa.Array:
        known: dict[int, int] = {}
        rows = []
        for text in byte_list(texts):
            words = features = total = 0
            for n, crcs in runs(text, ngram):
                for c in set(crcs).difference(known):
                    known[c] = gain[c % buckets]
                words, features, total = words + n, features + len(crcs), total + sum(map(known.__getitem__, crcs))
            if len(known) > REMEMBERED:
                known.clear()
            rows.append((words, features, total // features if features else 0))
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, names=list(FIELDS[:3]))

    keep = [c for c in docs.columns if c != out]
    raw = free_name(docs, "importance_raw")
    at = docs.withColumn(raw, run(F.col(text_col).cast("string")))
    score = (F.col(raw)["weight"] + noise(id_col, seed)).cast("long")
    return at.select(*keep, F.struct(*(F.col(raw)[c].alias(c) for c in FIELDS[:3]), score.alias("score")).alias(out))


def draw(rows: DataFrame, id_col: str = "doc_id", out: str = "importance", percent: int = PERCENT, min_words: int = MIN_WORDS, rank: str = "rank") -> DataFrame:
    """Rows of ``weigh`` and a column ``rank``: 1, 2, ... for the ``percent`` of highest scores among rows of enough words.

    Ties go to the smaller id, null last; rows alike in score and id come in any order,
    each with a rank of its own. Rows not drawn have null. The rows are written once to
    the shared folder. Scores are counted, so that no task orders more than the ids of
    one score; a column named ``rank`` is replaced.
    """
    s = free_name(rows, "draw_salt")
    kept = [c for c in rows.columns if c != rank]
    held = cut(rows.select(*kept, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int").alias(s)), "importance")
    score, able = F.col(out)["score"], F.col(out)["n_words"] >= min_words
    slim = held.where(able).select(score.alias("score"), F.col(id_col).alias("id"), F.col(s).alias("salt"))
    # scores are whole numbers of a range that the gains bound, whatever the number of rows
    by_score = cut(slim.groupBy("score").agg(F.count("*").alias("n")), "scores")
    drawn = percent * (by_score.agg(F.sum("n")).first()[0] or 0) // 100
    above = by_score.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("above")).where(F.col("above") < drawn)
    least = above.agg(F.min("score")).first()[0]
    if least is None:
        return held.select(*kept, F.lit(None).cast("long").alias(rank))
    in_id = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "salt")
    groups = slim.where(F.col("score") >= least).groupBy("score", "id", "salt").agg(F.count("*").alias("n")).join(F.broadcast(above), "score")
    starts = groups.select(F.col("score").alias("at_score"), F.col("id").alias("at_id"), F.col("salt").alias("at_salt"), (F.col("above") + F.sum("n").over(in_id) - F.col("n")).alias("start"))
    chosen = able & (score >= least)
    meets = (score == F.col("at_score")) & F.col(id_col).eqNullSafe(F.col("at_id")) & (F.col(s) == F.col("at_salt"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("at_score", "at_id", "at_salt").orderBy(F.col(out)["weight"]))
    top = held.where(chosen).join(starts, meets).select(*kept, place.alias(rank))
    top = top.withColumn(rank, F.when(F.col(rank) <= drawn, F.col(rank)))
    return top.unionByName(held.where(~chosen).select(*kept, F.lit(None).cast("long").alias(rank)))


def importance_ranks(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS, texts: bool = True) -> DataFrame:
    """``docs`` with the struct ``importance`` and ``rank``; without their texts if ``texts`` is false."""
    gain = gains(feature_counts(docs, text_col, ngram, buckets), feature_counts(target, target_text_col, ngram, buckets))
    weighed = weigh(docs, gain, id_col, text_col, ngram, seed)
    return draw(weighed if texts else weighed.drop(text_col), id_col, percent=percent, min_words=min_words)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, their columns unchanged."""
    return importance_ranks(docs, target, **options).where(F.col("rank").isNotNull()).select(*(c for c in docs.columns if c not in ("importance", "rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, weight, score and rank of every document, drawn towards ``benchmark``.

    Null, empty and word-less texts have no features, weight 0 and no rank; texts of any
    length are read whole, in pieces. Repeated ids share their noise; rows alike in score
    and id have ranks of their own. An empty ``documents`` gives no rows, an empty
    ``benchmark`` gains of the smoothing alone.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = importance_ranks(docs, table(spark, sf_dir, "benchmark").select("text"), texts=False)
    return got.select("doc_id", *(F.col("importance")[c].alias(c) for c in ("n_features", "weight", "score")), "rank")


SQL = r"""
WITH codes AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM codes),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT r, unnest(words) AS w FROM d),
u AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM b)),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN k USING (w) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000 AS ss, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000 AS tt),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ss / ((s.n + 1)::DOUBLE * tt)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), tot),
m AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, coalesce(m.n, 0)::BIGINT AS n_features, coalesce(m.weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM z
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM y WHERE n_features < 20
"""

QUERIES = {"op11_importance_resampling": op11_importance_resampling}
ORACLES = {"op11_importance_resampling": SQL}
