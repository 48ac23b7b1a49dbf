import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import pitman_yor as p
from marlstone.llm import seating


def test_arrays_round_trip():
    xs = [np.array([], np.uint8), np.array([1, 2**40], np.int64), np.array([300], np.uint16), np.array([0.5, -1])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(xs, p.load(p.dump(*xs))))


@pytest.mark.parametrize("d", [p.CONTEXT[0], p.PARENT[0]])
def test_stirling_numbers_of_many_customers(d):
    """The forms for many customers against the recurrence."""
    exact, law = seating.log_stirling(d, 1500), p.law(d)
    for c in (seating.EXACT + 1, 200, 1500):
        assert np.abs(law.log_s(np.full(c, float(c)), np.arange(1.0, c + 1)) - exact[c, 1 : c + 1]).max() < 0.03


@pytest.mark.parametrize("c", [2, 3, 24, 25, 64, 65, 300])
@pytest.mark.parametrize("theta, tables, base", [(4.0, 0, 0.3), (4.0, 900, 1e-4), (10.0, 50, 0.01)])
def test_draws_follow_single_customers(c, theta, tables, base):
    """Means and deviations of draws against Gibbs sampling that moves one customer at a time."""
    d, n, rng = 0.85, 4000, np.random.default_rng(c)
    got = p.law(d).draw(np.full(n, c), np.full(n, tables + theta / d), np.full(n, base), rng)
    size = np.zeros((200, c), np.int64)  # 200 chains
    size[:, 0] = c
    rows, seen = np.arange(200), []
    for k in range(c * (40 if c < 100 else 12)):
        gone = (size.cumsum(axis=1) > (rng.random(200) * c)[:, None]).argmax(axis=1)
        size[rows, gone] -= 1
        weight = np.maximum(size - d, 0) * (size > 0)
        weight[rows, (size == 0).argmax(axis=1)] = (theta + d * (tables + (size > 0).sum(axis=1))) * base
        size[rows, ((cum := weight.cumsum(axis=1)) > (rng.random(200) * cum[:, -1])[:, None]).argmax(axis=1)] += 1
        if k >= 4 * c and k % c == 0:
            seen.append((size > 0).sum(axis=1))
    seen = np.concatenate(seen)
    assert abs(got.mean() - seen.mean()) < 0.05 * seen.mean() and abs(got.std() - seen.std()) < 0.15 * seen.std() + 0.05


class OneTable:
    @staticmethod
    def draw(count, others, base, rng):
        return np.minimum(count, 1)


def test_scores_by_hand(spark, monkeypatch):
    """With one table for each dish everywhere, scores are plain arithmetic on counts; next words add up to 1."""
    texts = ["a b a b c", "b a", "c c c a b", "", "a b", "d"] * 4
    tokens = [t.split() + [""] for t in texts]
    pairs = collections.Counter(x for t in tokens for x in zip(["", *t[:-1]], t))
    count = collections.Counter(w for t in tokens for w in t)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(p, "law", lambda d: OneTable)
    got = {r.doc_id: r.score for r in p.score_texts(df, F.lit(False)).collect()}
    d, theta = p.CONTEXT
    d0, theta0 = p.PARENT
    v, n = len(count), len(pairs)
    of = collections.Counter(w for _, w in pairs)
    context = collections.Counter(u for u, _ in pairs)
    base = {w: (of[w] - d0 + (theta0 + d0 * v) / (v + 1)) / (theta0 + n) for w in count}
    prob = lambda u, w: (pairs[u, w] - d * (pairs[u, w] > 0) + (theta + d * context[u]) * base[w]) / (theta + count[u])
    want = [sum(math.log10(prob(u, w)) for u, w in zip(["", *t[:-1]], t)) for t in tokens]
    assert all(abs(got[k] - x) < 1e-9 for k, x in enumerate(want))
    assert all(abs(sum(prob(u, w) for w in count) + (theta + d * context[u]) / (theta + count[u]) * (theta0 + d0 * v) / (v + 1) / (theta0 + n) - 1) < 1e-12 for u in count)


def brute_base(rows, held):
    toks = [(t or "").encode().lower().split() + [b" "] for _, t in rows]
    c = collections.Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for t in toks]


def test_base_by_brute_force_and_blocks_agree(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(900001, None), (900002, ""), (900003, "ÉA a\x0bÉA"), (None, "the the"), (900004, "solo " * 20000), (900004, "solo " * 20000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(5)
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k, _ in rows]
    got = p.score_texts(df, p.crc_mod("doc_id", 10) == 0).collect()
    key = lambda x: (str(x[0]), x[1])
    a = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) for r in got), key=key)
    b = sorted(((k, *x, h) for (k, _), x, h in zip(rows, brute_base(rows, held), held)), key=key)
    assert [x[:4] for x in a] == [x[:4] for x in b] and all(abs(x[4] - y[4]) < 1e-6 * abs(y[4]) for x, y in zip(a, b))
    assert [x[6] for x in a] == [x[5] for x in b]
    out = [x for x in a if x[6]]
    assert sum(x[5] for x in out) > sum(x[4] for x in out)  # better than the base on rows held out


@pytest.mark.parametrize("parts", [3, 80])
def test_next_words_sum_to_one_at_any_number_of_partitions(spark, parts):
    """Texts of one and two words give p up to factors f(u) / f(w), which leave the greatest eigenvalue at 1."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(20)]
    train = [" ".join(words[min(int(x), 19)] for x in rng.exponential(4, 12)) for _ in range(160)]
    every = [*words, "unseen"]
    texts = ["", *every, *(f"{u} {w}" for u in every for w in every)]
    rows = [(t, False) for t in train] + [(t, True) for t in texts]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, held boolean").repartitionByRange(parts, F.col("doc_id"))
    of = {r.doc_id - len(train): r.score for r in p.score_texts(df, F.col("held")).collect() if r.held_out}
    score = {t: of[k] for k, t in enumerate(texts)}
    m = [[score[""], *[0.0] * len(every)]] + [[score[u], *(score[f"{u} {w}"] - score[w] for w in every)] for u in every]
    assert abs(np.abs(np.linalg.eigvals(10.0 ** np.array(m))).max() - 1) < 1e-9


@pytest.mark.parametrize("buckets", [128, 640, 4 * 65_536])
def test_buckets_are_ranges_of_keys(buckets):
    b = object.__new__(p._Block)
    b.number = np.arange(2000, dtype=np.int64) << 36
    b.seq = np.random.default_rng(1).integers(0, 2000, 50_000)
    b.before, b.held, b.size = np.roll(b.seq, 1), np.zeros(1, bool), np.array([50_000])
    _, _, key, bucket, _, _ = b.pairs(buckets)
    assert (np.diff(key.astype(np.float64)) >= 0).all() and (np.diff(bucket) >= 0).all()
    assert bucket.min() >= 0 and buckets * 0.9 < bucket.max() < buckets


def test_nothing_to_learn_and_empty(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = p.score_texts(df, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)
    assert p.score_texts(df.limit(0), F.lit(True)).count() == 0


class _Restaurant:
    """Customers of dishes at tables, seated one at a time."""

    def __init__(self, discount, strength):
        self.d, self.theta, self.tables, self.all, self.count = discount, strength, collections.defaultdict(list), 0, 0

    def predict(self, dish, base):
        own = self.tables[dish]
        return (max(0.0, sum(own) - self.d * len(own)) + (self.theta + self.d * self.all) * base) / (self.theta + self.count)

    def add(self, dish, base, rng):
        """True if the customer opens a table, which is a customer of the parent."""
        own = self.tables[dish]
        weights = [max(0.0, n - self.d) for n in own] + [(self.theta + self.d * self.all) * base]
        at = rng.choices(range(len(weights)), weights)[0]
        self.count += 1
        if at == len(own):
            own.append(1)
            self.all += 1
            return True
        own[at] += 1
        return False

    def remove(self, dish, rng):
        own = self.tables[dish]
        at = rng.choices(range(len(own)), own)[0]
        own[at] -= 1
        self.count -= 1
        if not own[at]:
            del own[at]
            self.all -= 1
            return True
        return False


def _sequential(train, texts, sweeps, burn, rng):
    """Mean predictive probability of each text's pairs under Gibbs sampling that moves one customer at a time through both levels."""
    parent, contexts = _Restaurant(*p.PARENT), collections.defaultdict(lambda: _Restaurant(*p.CONTEXT))
    pairs = [x for t in train for x in zip(["", *t[:-1]], t)]
    base = 1 / (len({w for _, w in pairs}) + 1)
    seat = lambda u, w: contexts[u].add(w, parent.predict(w, base), rng) and parent.add(w, base, rng)
    for u, w in pairs:
        seat(u, w)
    total = [0.0] * len(texts)
    for k in range(sweeps):
        for u, w in pairs:
            if contexts[u].remove(w, rng):
                parent.remove(w, rng)
            seat(u, w)
        if k >= burn:
            for i, t in enumerate(texts):
                total[i] += sum(math.log10(contexts[u].predict(w, parent.predict(w, base))) for u, w in zip(["", *t[:-1]], t))
    return [x / (sweeps - burn) for x in total]


def test_scores_follow_a_sequential_sampler(spark):
    """Under the real law, scores of a small corpus lie near those of plain Gibbs sampling of both levels."""
    import random

    rng = random.Random(11)
    words = [f"w{k}" for k in range(12)]
    follow = {w: rng.choices(words, k=3) for w in words}
    texts = []
    for _ in range(60):
        t = [rng.choice(words[:4])]
        while len(t) < rng.randint(3, 14):
            t.append(rng.choice(follow[t[-1]] if rng.random() < 0.8 else words))
        texts.append(t)
    texts[7], texts[13] = ["new", "w1", "unseen"], []
    held = [k % 4 == 3 for k in range(60)]
    tokens = [[*t, ""] for t in texts]
    want = _sequential([t for t, h in zip(tokens, held, strict=True) if not h], tokens, 400, 100, rng)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in p.score_texts(df, F.col("doc_id") % 4 == 3).collect()}
    apart = np.array([got[k] - want[k] for k in range(60)]) / [len(t) for t in tokens]
    assert abs(apart.mean()) < 0.02 and np.abs(apart).max() < 0.15
