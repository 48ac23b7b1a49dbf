import hashlib
import random

import numpy as np
import public_tokenizers
import regex

from marlstone.llm import bpe, pretokens

ODD = "aab  '''stmdrevl\n\t1é 　!.-\x1c\x85漢😀٣"


def test_pretokens_match_the_pattern():
    rule, rng = regex.compile(public_tokenizers.PATTERN), random.Random(3)
    for _ in range(2000):
        docs = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(3)]
        raw = [d.encode() for d in docs]
        data, off = b"".join(raw), np.cumsum([0, *map(len, raw)])
        at = pretokens.starts(np.frombuffer(data, np.uint8), off)
        assert [data[a:b] for a, b in zip(at, [*at[1:], len(data)])] == [w.encode() for d in docs for w in rule.findall(d)]


def test_ids_and_round_trip(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "It's we'll  go\n\n", "word " * 3000, "word " * 3000, *("".join(rng.choice(ODD) for _ in range(rng.randint(1, 60))) for _ in range(40))]
    rows = [(i if i != 7 else None, t, "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, ids string").repartition(3)
    got = bpe.bpe_encode(docs)
    enc = bpe._encoder(bpe.resource(bpe.RANKS))
    want = sorted((-1 if i is None else i, tuple(enc.encode_ordinary(t or ""))) for i, t, _, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    said = {r.doc_id: r for r in bpe.token_digests(got).collect()}
    assert all(said[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t, _, _ in rows)
    assert said[3].ids_sha256 == hashlib.sha256(",".join(map(str, enc.encode_ordinary(texts[3]))).encode()).hexdigest()
    assert {bytes(r.bytes).decode() for r in bpe.bpe_decode(got).collect()} == {t or "" for t in texts}


def test_empty_table(spark):
    assert bpe.token_digests(bpe.bpe_encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
