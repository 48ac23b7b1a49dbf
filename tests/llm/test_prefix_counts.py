import random

import pyarrow as pa
import sentencepiece

from marlstone.llm import prefix_counts as p
from marlstone.llm.common import resource

ODD = [*"aab  ▁▁'''stmd\n\t1é　!.-\x00漢😀٣thhe", "<s>", "</s>", "<unk>", "the", "<0x0A>"]


def test_counts_match_the_library(spark):
    sp, rng = sentencepiece.SentencePieceProcessor(model_file=resource(p.MODEL)), random.Random(2)
    texts = [None, "", " ", "x" * 5000, "word " * 4000, *("".join(rng.choice(ODD) for _ in range(rng.randint(0, 20))) for _ in range(600))]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens int")
    got = df.select("text", p.token_count("text").alias("n")).collect()
    assert [r.n for r in got] == [len(sp.encode(t or "")) for t in texts]


def test_every_prefix_and_truncation(spark):
    sp, rng = sentencepiece.SentencePieceProcessor(model_file=resource(p.MODEL)), random.Random(6)
    texts = [None, "", *("".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(100))]
    df = p.truncate_to(p.prefix_counts(spark.createDataFrame([(t,) for t in texts], "text string")), 6)
    for r in df.collect():
        t = r.text or ""
        want = [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        assert r.prefix_tokens == want
        assert r.truncated == t[: max(i for i, n in enumerate(want) if n <= 6)]


def test_cut_at_a_budget_by_the_library(spark):
    sp, rng = sentencepiece.SentencePieceProcessor(model_file=resource(p.MODEL)), random.Random(9)
    texts = [None, "", " ", "x" * 300, "a", *("".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(150))]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "same same", 1)] * 2, "doc_id long, text string, cut int")
    for budget in (0, 1, 7):
        for r in df.select("text", p.within_budget("text", budget).alias("b")).collect():
            t = r.text or ""
            n = [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
            assert r.b.n_tokens == n[-1]
            assert r.b.prefix_chars == (len(t) if n[-1] <= budget else max(i for i, x in enumerate(n) if x <= budget))


def test_query_on_odd_tables(spark, tmp_path):
    for name, some in (("full", [(None, "a b", 1), (3, None, 2), (3, None, 2), (4, "é" * 9000, 3)]), ("empty", [])):
        spark.createDataFrame(some, "doc_id long, text string, n_tokens int").write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        got = p.op10_prefix_counts(spark, f"file://{tmp_path}/{name}").collect()
        assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(k), len((t or "").encode())) for k, t, _ in some)
        assert all(r.prefix_chars == 9000 or r.over_limit for r in got if r.doc_id == 4) and all(r.n_tokens == 0 and r.prefix_chars == 0 for r in got if r.doc_id == 3)


def test_no_rows():
    assert [len(x) for x in p.count_block(pa.array([], pa.string()), resource(p.MODEL), 5)] == [0, 0]
