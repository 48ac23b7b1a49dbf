import random

import numpy as np
import pytest

from marlstone.llm import simhash as s


def brute_components(fps):
    """Component roots by comparing everything."""
    lab = list(range(len(fps)))

    def top(i):
        while lab[i] != i:
            i = lab[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= s.TAU:
                a, b = top(i), top(j)
                lab[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def made(rng, n):
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        out.append(x)
        for _ in range(rng.choice([0, 0, 1, 5])):
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out[:n]


@pytest.mark.parametrize("seed,chunk", [(1, 1024), (2, 4)])
def test_links_join_what_brute_force_joins(spark, seed, chunk):
    rng = random.Random(seed)
    fps = list(dict.fromkeys([*made(rng, 300), 0, 1, 3, *((0xABC << 40) ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(12)) for _ in range(60))]))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").repartition(3)
    got = {r.node: r.root for r in s.roots(s.links(df, chunk=chunk)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = brute_components(fps)
    groups = {}
    for f, w in zip(signed, want):
        groups.setdefault(w, set()).add(f)
    for own in groups.values():
        assert {got.get(f, f) for f in own} == {min(own)}


@pytest.mark.parametrize("n", [10, 10**5, 10**7, 10**10])
def test_thresholds_guarantee_every_link(n):
    rng = random.Random(n)
    sample = np.array([rng.getrandbits(64) for _ in range(200)], np.uint64)
    parts = s.plan(sample, n)
    assert sum(p.threshold + 1 for p in parts) == s.TAU + 1
    assert len({b for p in parts for b in p.bits}) == sum(len(p.bits) for p in parts)


def test_fingerprint_by_hand():
    import xxhash

    assert s.fingerprint(None) == s.fingerprint(" \n") == 0
    assert s.fingerprint("A b\tC") == xxhash.xxh64_intdigest(b"a b c", 42)
    hs = [xxhash.xxh64_intdigest(x, 42) for x in ("É b c d".replace("b", "b").encode(), b"b c d e", b"c d e f")]
    assert s.fingerprint("É b C d\x0be F") == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > 3)


def test_components_and_one_kept(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts = [None, "", "x", *base, *base[:10], *(t + " z" for t in base[:20])]
    rows = [(i if i != 5 else None, t, "a", 1) for i, t in enumerate(texts)] + [(3, texts[3], "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int").repartition(4)
    lab = brute_components([s.fingerprint(t) for _, t, _, _ in rows])
    ids = {}
    for (d, _, _, _), w in zip(rows, lab):
        ids.setdefault(w, []).append(d)
    want = sorted(((d, min((x for x in ids[w] if x is not None), default=None)) for (d, _, _, _), w in zip(rows, lab)), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in s.components(df).collect()), key=str) == want
    kept = s.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for _, c in want})


@pytest.mark.parametrize("least", [None, 7])
def test_one_kept_of_each_component_with_null_and_repeated_ids(spark, least):
    """Unlike texts under one id, or none, lead components of their own."""
    rng = random.Random(12)
    text = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(40)) for _ in range(6)]
    rows = [(least, text[0], "a"), (least, text[1], "b"), (least, text[1], "a"), (least, text[1] + " z", "c"), (least, None, "d"), (least, "", "e")]
    # 9 leads a component once and stands in that of 8, too; 10 has a null beside it
    rows += [(9, text[2], "a"), (9, text[3], "b"), (8, text[3], "c"), (None, text[4], "d"), (10, text[4], "e"), (11, text[5], "f"), (11, text[5], "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, from string").repartition(4)
    lab = brute_components([s.fingerprint(t) for _, t, _ in rows])
    assert len(set(lab)) == 7
    last = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "", r[2])
    want = [min((r for r, k in zip(rows, lab) if k == x), key=last) for x in set(lab)]
    assert sorted(map(tuple, s.keep_one(df).collect()), key=last) == sorted(want, key=last)


def test_empty(spark):
    assert s.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_kept_with_clashing_columns(spark):
    rows = [(1, "a b c d e", 7, 8, 9), (2, "a b c d e", 7, 8, 9), (2, "a b c d e", 7, 8, 9), (None, None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_doc_id int, kept_row int, root int")
    got = s.keep_one(df)
    assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[0], rows[3]]))
