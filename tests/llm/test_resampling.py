"""Runs of words, gains, noise and the draw against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import resampling
from marlstone.llm.words import word_pieces

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())


def features(text, ngram):
    words = WORD.findall(lower(text))
    return words, [b" ".join(words[i : i + k]) for k in range(1, ngram + 1) for i in range(len(words) - k + 1)]


def expected(docs, target, ngram, buckets, seed, percent, min_words):
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in features(t, ngram)[1])
    s, t = count(x for _, x in docs), count(x for x in target)
    ss, tt = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * ss / ((s[b] + 1) * tt)))
    rows = []
    for i, text in docs:
        words, fs = features(text, ngram)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(fs), weight, score, None, len(words)])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return rows


def made(n, seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "été", "x1", "42", "delta,", "ÉCLAIR", "z"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (None, "alpha beta " * 15), (None, "alpha beta " * 15), (3, "beta " * 25), (n + 2, "--- ... \n"), (n + 3, "w" * 5000 + " alpha" * 30)]
    return docs


@pytest.mark.parametrize("ngram", [1, 2, 3])
def test_against_plain_python(spark, ngram):
    docs, target = made(150, ngram), ["alpha alpha beta", None, "été x1 x1 42"]
    want = expected(docs, target, ngram, 97, 5, 30, 10)
    got = resampling.importance_ranks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), ngram=ngram, buckets=97, seed=5, percent=30, min_words=10)
    rows = [[r["doc_id"], r["importance"]["n_features"], r["importance"]["weight"], r["importance"]["score"], r["rank"]] for r in got.collect()]
    key = lambda r: str(r)
    assert sorted(rows, key=key) == sorted((r[:5] for r in want), key=key)
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, 1 + sum(r[4] is not None for r in rows)))


def test_pieces_keep_words_whole():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab1 .é\n-Z") for _ in range(rng.randint(0, 120))).encode()
        assert [w for p in word_pieces(text, rng.randint(1, 9)) for w in p] == WORD.findall(lower(text.decode()))
        got = Counter(c for _, cs in resampling.runs(text, 3) for c in cs)
        assert got == Counter(zlib.crc32(f) for f in features(text.decode(), 3)[1])


def test_runs_across_pieces(monkeypatch):
    monkeypatch.setattr(resampling, "word_pieces", lambda text: word_pieces(text, 7))
    text = b"one two three four five six seven eight nine ten"
    for n in (1, 2, 3, 4):
        got = Counter(c for _, cs in resampling.runs(text, n) for c in cs)
        assert got == Counter(zlib.crc32(f) for f in features(text.decode(), n)[1])


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([("alpha",)], "text string")
    assert resampling.importance_ranks(none, target).count() == 0
    docs = spark.createDataFrame([(i, "alpha " * 30, "x", 7, 8) for i in range(20)], "doc_id long, text string, importance string, rank int, draw_salt int")
    got = resampling.importance_ranks(docs, none.select("text"))
    assert got.where("rank is not null").count() == 2 and got.select("draw_salt").distinct().count() == 1
    assert resampling.resample(docs.drop("importance", "rank"), target).columns == ["doc_id", "text", "draw_salt"]
    assert resampling.importance_ranks(docs, target, min_words=31).where("rank is not null").count() == 0


def test_hot_id(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("alpha beta gamma " * 8).alias("text"))
    got = resampling.importance_ranks(docs, docs.limit(0), percent=70)
    ranks = sorted(r["rank"] for r in got.where("rank is not null").collect())
    assert ranks == list(range(1, 2101))


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.execute(f"create view {n} as select * from '{sf}/{n}.parquet'")
    rel = con.sql(resampling.SQL)
    got = resampling.op11_importance_resampling(spark, sf).select(*rel.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rel.fetchall(), key=str)
