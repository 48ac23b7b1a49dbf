import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from marlstone.llm import idcoder
from marlstone.llm import idfiles as i
from marlstone.llm.common import new_path, resource
from marlstone.llm.warc import file_system

ODD = [*"aab  '''stmdrevl\n\t1é　!.-\x1c\x85漢😀٣", "<|endoftext|>", "the "]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [None, "", "w " * 30000, *("".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n))]


def test_ids_match_the_library():
    path = resource(i.TOKENIZER)
    tok, rows = i._tokenizer(path)[0], texts(1500)
    ids, off = i.encode_texts(pa.array(rows), path)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [tok.encode(t or "", add_special_tokens=False).ids for t in rows]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 2047, 30000, 200001])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for x in (rng.integers(0, 50257, n), np.full(n, 50256), np.tile(np.arange(7), n)[:n], rng.zipf(1.3, n) % 50257, np.where(rng.random(n) < 1e-3, 65535, 0)):
        x = x.astype(np.uint32)
        assert (idcoder.from_block(idcoder.to_block(x)) == x).all()


def entropy(counts):
    p = counts[counts > 0] / counts.sum()
    return -(p * np.log2(p)).sum()


def test_contexts_beat_the_entropy_of_ids():
    """Ids that depend on two before them cost near what they tell, and real ids clearly less than by themselves."""
    rng = np.random.default_rng(5)
    after = rng.integers(0, 1000, (30, 30, 2))
    x, a, b = np.empty(400_000, np.uint32), 0, 0
    for k, c in enumerate(rng.integers(0, 2, len(x)).tolist()):
        x[k] = after[a, b, c]
        a, b = b, int(x[k]) % 30
    assert 8 * len(idcoder.to_block(x)) < 1.6 * len(x) < 0.3 * entropy(np.bincount(x)) * len(x)
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks()
    ids, _ = i.encode_texts(rows, resource(i.TOKENIZER))
    coded = idcoder.to_block(ids)
    assert 8 * len(coded) < 0.8 * entropy(np.bincount(ids)) * len(ids)


def test_carries_run_through_full_words():
    """A lane of likely ids that ends in unlikely ones moves its bounds across many words."""
    for seed in range(30):
        rng = np.random.default_rng(seed)
        x = np.where(rng.random(3000) < 0.02, rng.integers(0, 3, 3000), 1).astype(np.uint32)
        assert (idcoder.from_block(idcoder.to_block(x)) == x).all()


def test_checksums_catch_damage():
    ids = np.arange(5000, dtype=np.uint32) % 900
    whole = i.to_file([1, None], np.array([2000, 3000]), ids)
    assert (i.from_file(whole)[2] == ids).all() and i.from_file(whole)[0] == [1, None]
    caught, places = 0, range(8, len(whole), 97)
    for at in places:
        data = bytearray(whole)
        data[at] ^= 1
        try:  # the last bits of a lane's last word may be any
            assert (i.from_file(bytes(data))[2] == ids).all()
        except ValueError:
            caught += 1
    assert caught > 0.8 * len(places)


def test_searches_end_at_empty_slots(monkeypatch):
    """Keys that a table lacks cost little more than one look, and the reader makes tables of contexts alone."""
    rng, looks, made = np.random.default_rng(6), [], []
    keys = np.unique(rng.integers(0, 1 << 40, 300_000))
    places, hashed, make = idcoder._Places(keys), idcoder._Places._hash, idcoder._Places.__init__
    monkeypatch.setattr(idcoder._Places, "_hash", staticmethod(lambda k, h: looks.append(len(k)) or hashed(k, h)))
    asked = np.concatenate([keys[::7], rng.integers(1 << 40, 1 << 41, 200_000)])
    rng.shuffle(asked)
    at = places.find(asked)
    inside = asked < 1 << 40
    assert (keys[at[inside]] == asked[inside]).all() and (at[~inside] == len(keys)).all()
    assert sum(looks) < 1.8 * len(asked)
    coded = idcoder.to_block(rng.zipf(1.3, 50_000).astype(np.uint32) % 5000)
    monkeypatch.setattr(idcoder._Places, "__init__", lambda self, k: made.append(len(k)) or make(self, k))
    idcoder.from_block(coded)
    n = idcoder._shape(50_000)[1]
    assert len(made) == len(list(idcoder._spans(n)))


def test_blocks_decode_alone(monkeypatch):
    monkeypatch.setattr(i, "BLOCK_IDS", 1000)
    ids = np.random.default_rng(0).integers(0, 50, 5300).astype(np.uint32)
    data = i.to_file([1], np.array([5300]), ids)
    assert (i.from_file(data)[2] == ids).all()
    parts = np.array_split(ids, 6)
    last = idcoder.to_block(parts[-1])
    assert data.endswith(last) and (idcoder.from_block(last) == parts[-1]).all()


def test_files_in_order(spark):
    rows = [(k if k != 9 else None, t, 0) for k, t in enumerate(texts(60, 4))] + [(5, "twice", 0)]
    random.Random(2).shuffle(rows)
    root, tok = new_path(spark, "ids-test"), i._tokenizer(resource(i.TOKENIZER))[0]
    i.write_ids(spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3), root, file_ids=500)
    got = sorted(i.read_ids(spark, root).collect(), key=lambda r: r.start)
    want = {(k, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (2,)) for k, t, _ in rows}
    assert {(r.doc_id, tuple(r.ids)) for r in got} == want and len(got) == len(rows)
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) for r in got)])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: -1 if x is None else x)
    sums = {(r.start, r.n_tokens, r.ids_crc32) for r in i.read_digests(spark, root).collect()}
    assert sums == {(r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def written(root):
    from pyarrow.fs import FileSelector

    fs, at = file_system(root)
    return {f.base_name: fs.open_input_stream(f.path, compression=None).read() for f in fs.get_file_info(FileSelector(at))}


def test_same_bytes_at_any_partitioning(spark):
    """Thousands of rows, so that bounds come from a sample; null and repeated ids, equal texts."""
    rng = random.Random(8)
    rows = [(None if rng.random() < 0.3 else rng.randint(0, 3000), " ".join(rng.choices(["one", "two", "three"], k=rng.randint(0, 30)))) for _ in range(5000)]
    got = []
    for n in (2, 7):
        rng.shuffle(rows)
        got.append(new_path(spark, "ids-test"))
        i.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), got[-1], part_bytes=40_000)
    assert written(got[0]) == written(got[1]) and len(written(got[0])) > 8
    read = sorted(i.read_ids(spark, got[0]).collect(), key=lambda r: r.start)
    assert [-1 if r.doc_id is None else r.doc_id for r in read] == sorted(-1 if k is None else k for k, _ in rows)


def test_empty(spark):
    root = new_path(spark, "ids-test")
    i.write_ids(spark.createDataFrame([], "doc_id long, text string"), root)
    assert i.read_ids(spark, root).count() == 0
