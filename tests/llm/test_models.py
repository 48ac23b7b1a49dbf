"""Language ID and neighbour quality: edge cases by hand, accuracy on rows held out."""

import numpy as np

from marlstone.llm import langid, neighbours
from marlstone.llm.features import ngram_counts


def test_ngrams_do_not_cross_texts():
    a, b = b"abc", b"abcabc"
    data = np.frombuffer(a + b, np.uint8)
    both = ngram_counts(data, np.array([0, 3, 3, 9]), 4096)
    assert both.sum(axis=1).tolist() == [6, 0, 15]
    assert (both[0] == ngram_counts(data[:3], np.array([0, 3]), 4096)[0]).all()


def test_language_by_hand_and_unknown(spark):
    rows = [("the cat and the dog are here", "en"), ("der hund und die katze sind da", "de"), ("le chat et le chien sont ici", "fr"), ("el gato y el perro son de la casa", "es")]
    train = spark.createDataFrame(rows * 3 + [(None, "en"), ("x", None)], "text string, lang string")
    model = langid.fit_model(train)
    assert model.families.names == ["germanic", "romance"] and model.within["romance"].names == ["es", "fr"]
    docs = spark.createDataFrame([(t, "lang_pred") for t, _ in rows] + [(None, ""), ("", ""), ("12 !", ""), ("the dog " * 20000, "")], "text string, lang string")
    got = langid.identify(docs, model).collect()
    assert [r.language.lang_pred for r in got] == ["en", "de", "fr", "es", "und", "und", "und", "en"]
    assert all(0 <= r.language.score <= 1 for r in got) and got[4].language.score == 0
    one = langid.fit_model(train.where("lang = 'en'"))
    assert langid.identify(docs, one).first().language.lang_pred == "en"
    assert langid.fit_model(train.limit(0)) is None and langid.identify(docs, None).first().language.lang_pred == "und"


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = langid.op2_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98


def test_votes_match_brute_force():
    rng = np.random.default_rng(1)
    x = np.log1p(rng.poisson(1.0, (80, neighbours.WIDTH + len(neighbours.REPEATS) + 1))).astype(np.float32)
    y = (rng.random(80) < 0.5).astype(int)
    space = neighbours.Space.fit(x, y, 16)
    q = x[:20] + 0.5
    own = space.weigh(q, space.idf) @ space.basis
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    want = []
    for v in own:
        cos = space.vectors @ v
        at = np.argsort(-cos)[: neighbours.NEAREST]
        w = np.maximum(cos[at], 1e-3) ** neighbours.SHARPNESS
        want.append((w * y[at]).sum() / w.sum())
    assert np.allclose(space.score(q), want, atol=1e-4)


def test_quality_edges_and_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = neighbours.op5_neighbour_quality(spark, d).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.9
    odd = spark.createDataFrame([(None, 1), ("", 2), ("a " * 50000, 3)], "text string, score int")
    space = neighbours.training_space(docs.select("doc_id", "text"), labels)
    assert all(0 <= r.score <= 1 for r in neighbours.quality_score(odd, space).collect())
    assert neighbours.training_space(docs.select("doc_id", "text"), labels.limit(0)) is None
    assert neighbours.quality_score(odd, None).first().score == 0.5


def test_samples_stay_bounded_under_copies(spark):
    from marlstone.llm.features import bounded_sample

    rows = spark.range(4000).selectExpr("id AS doc_id", "'the same text' AS text", "'en' AS lang")
    n = bounded_sample(rows, {"en": (4000, 400)}, "lang", 2, ["doc_id", "text"]).count()
    assert 250 < n < 550
    docs = spark.createDataFrame([(1, "a b")] * 500 + [(2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (1, 0)], "doc_id long, quality int")
    assert len(neighbours.fit_space(docs, labels).labels) == 2


def test_terms_by_brute_force():
    """Counts of byte n-grams by their hashes, and the term of repeated three-word sequences."""
    texts = ["a b c a b c a b c", "", "one two three four five", "é é é é"]
    raw = [t.encode() for t in texts]
    got = neighbours.terms(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for row, t, text in zip(got, raw, texts):
        want = np.zeros(neighbours.WIDTH)
        for k in (1, 2, 3):
            for i in range(len(t) - k + 1):
                code = 0
                for b in t[i : i + k]:
                    code = (code * 257 + b) % 2**32
                want[((code + k) * 2654435761 % 2**32) >> 22] += 1
        assert np.allclose(row[: neighbours.WIDTH], np.log1p(want), atol=1e-6)
        w = text.split()
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        share = 1 - len(set(three)) / len(three) if three else 0
        at = sum(share >= r for r in neighbours.REPEATS)
        assert row[neighbours.WIDTH :].tolist() == [float(k == at) for k in range(len(neighbours.REPEATS) + 1)]


def test_directions_are_the_latent_ones():
    """The basis spans the leading right singular vectors of the weighted terms."""
    rng = np.random.default_rng(3)
    x = np.log1p(rng.poisson(0.5, (60, neighbours.WIDTH + len(neighbours.REPEATS) + 1))).astype(np.float32)
    space = neighbours.Space.fit(x, np.arange(60) % 2, 8)
    t = neighbours.Space.weigh(x, space.idf)
    _, _, v = np.linalg.svd(t.astype(np.float64), full_matrices=False)
    assert np.allclose(np.abs(v[:8] @ space.basis), np.eye(8), atol=1e-2)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    k = label.sum()
    return (rank[label == 1].sum() - k * (k + 1) / 2) / (k * (len(label) - k))


def test_quality_ranks_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = neighbours.op5_neighbour_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out and quality is not null").toPandas()
    assert len(got) > 500 and auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.95


def test_odd_tables(spark, tmp_path):
    """Empty documents, null and repeated ids, whole repeated rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, language int"
    rows = [(None, "the cat is here", "en", "s", 1, 1, 1), (5, "der hund ist da", "de", "s", 1, 1, 1), (5, "der hund ist da", "de", "s", 1, 1, 1), (5, None, None, None, None, 1, 1)]
    for name, some in (("full", rows), ("empty", [])):
        at = f"file://{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        languages = langid.op2_language_id(spark, at).collect()
        scores = neighbours.op5_neighbour_quality(spark, at).collect()
        assert len(languages) == len(scores) == len(some)
        assert all(0 <= r.score <= 1 for r in [*languages, *scores])
        if some:
            assert [r.lang_pred for r in languages if r.doc_id == 5].count("und") == 1 and len({r.score for r in scores if r.doc_id == 5}) <= 2


def test_many_languages_keep_the_sample_bounded(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "concat('word', id % 3, ' text') AS text", "concat('l', id % 300) AS lang")
    model = langid.fit_model(rows, per_language=600, all_languages=60)
    assert sum(len(m.names) for m in model.within.values()) < 150


def test_machines_reach_the_least_loss():
    """No direction lowers the weighted squared hinge loss, and a plain descent finds none better."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=120) > 0.2, 1.0, -1.0)
    one = np.hstack([x, np.ones((120, 1))])
    each = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    loss = lambda w: 0.5 * w @ w / 20.0 + (each * np.maximum(0, 1 - y * (one @ w)) ** 2).sum()
    got = langid.fit_svm(x, y, cost=20.0, rounds=2000).astype(np.float64)
    w = np.zeros(13)
    for _ in range(20000):
        w -= 0.2 * (w / 20.0 - 2 * one.T @ (each * y * np.maximum(0, 1 - y * (one @ w))))
    assert abs(loss(got) - loss(w)) < 1e-5
    quick = langid.fit_svm(x, y).astype(np.float64)
    assert loss(quick) < 1.01 * loss(w)


def test_votes_of_machines_by_hand():
    """Each pair of names has a machine; the name with most votes wins, margins break ties."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    labels = np.array(["a", "b", "c", "d"])[x[:, :4].argmax(axis=1)]
    m = langid.Machines.fit(x, labels)
    best, sure = m.choose(x)
    import itertools

    for row, at, p in zip(x, best, sure):
        votes, margin, least = dict.fromkeys(m.names, 0), dict.fromkeys(m.names, 0.0), dict.fromkeys(m.names, 1.0)
        for w, (a, b) in zip(m.weights, itertools.combinations(m.names, 2)):
            s = float(row @ w[:-1] + w[-1])
            votes[a if s > 0 else b] += 1
            margin[a] += s
            margin[b] -= s
            q = 1 / (1 + np.exp(-4 * s))
            least[a], least[b] = min(least[a], q), min(least[b], 1 - q)
        top = [n for n in m.names if votes[n] == max(votes.values())]
        want = max(top, key=lambda n: np.tanh(margin[n]))
        assert m.names[at] == want and abs(p - least[want]) < 1e-5
    assert (np.array(m.names)[best] == labels).mean() > 0.9


def test_many_languages_need_few_machines():
    """500 languages, each a family of its own: machines grow with the names, and the tree finds them."""
    import time

    rng = np.random.default_rng(9)
    names = np.array([f"l{k:03d}" for k in range(500)])
    own = langid.unit_rows(rng.exponential(size=(500, 256)).astype(np.float32))
    rows = np.repeat(np.arange(500), 4)
    x = langid.unit_rows(own[rows] + 0.005 * rng.normal(size=(2000, 256)).astype(np.float32))
    began = time.process_time()
    model = langid.Model.fit(x, names[rows], {})
    took = time.process_time() - began

    def machines(m):
        return len(m.weights) if isinstance(m, langid.Machines) else len(m.top.weights) + sum(map(machines, m.below))

    assert machines(model.families) < 5 * 500 and took < 120
    got, score = model.predict(x[::4])
    assert np.mean(np.array(got) == names) > 0.9 and ((score >= 0) & (score <= 1)).all()


def test_weights_in_the_span_of_few_rows():
    rng = np.random.default_rng(3)
    x = langid.unit_rows(rng.normal(size=(30, 200)))
    labels = np.array(["a", "b", "c"])[np.arange(30) % 3]
    plain, inside = langid.Machines.fit(x, labels), langid._fit_in_span(x, labels)
    assert np.allclose(plain.weights, inside.weights, atol=1e-3)


def test_rare_languages_are_left_out(spark):
    rows = [("aa bb cc", "x")] * 5 + [("dd ee ff", "y")] * 4 + [("gg hh", "z")]
    model = langid.fit_model(spark.createDataFrame(rows, "text string, lang string"), most_languages=2)
    assert {n for m in model.within.values() for n in m.names} == {"x", "y"}
