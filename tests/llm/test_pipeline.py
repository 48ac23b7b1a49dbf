"""The pipeline against plain Python, stage by stage."""

import hashlib

import duckdb

import corpus_pipeline
from marlstone.llm import bpe, neighbours, quality_rules, simhash
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_simhash import brute_components


def test_against_plain_python(spark):
    d = "/root/testdata/sf0.001"
    docs, names = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        got = stage(spark, docs, d)
        assert got.columns == docs.columns
        got = spark.createDataFrame(got.collect(), got.schema)
        kept = {r.doc_id for r in got.collect()}
        if name == "quality rules":
            con = duckdb.connect()
            con.execute(f"create view documents as select * from '{d}/documents.parquet'")
            want = {r[0] for r in con.sql(quality_rules.SQL).fetchall() if r[-1]}
        elif name == "quality classifier":
            space = neighbours.training_space(docs.select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet"))
            want = {k for k, t in before.items() if space.score(neighbours.terms(*as_arrays(t)))[0] >= neighbours.THRESHOLD}
        elif name == "near duplicates":
            ids = sorted(before)
            lab = brute_components([simhash.fingerprint(before[k]) for k in ids])
            want = {min(ids[j] for j in range(len(ids)) if lab[j] == x) for x in set(lab)}
        else:
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            want = {k for k, _, hit, _ in brute_hits(list(before.items()), bench) if not hit}
        assert kept == want and kept
        names.append(len(kept))
        docs = got
    assert names == sorted(names, reverse=True)
    enc = bpe._encoder(bpe.resource(bpe.RANKS))
    want = {(r.doc_id, hashlib.sha256(",".join(map(str, enc.encode_ordinary(r.text))).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect()}
    assert {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, d).collect()} == want


def as_arrays(text):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])
