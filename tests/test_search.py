"""The index against a scan, ownership edge cases and a large hub, contradictions against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import contradictions as X
from marlstone.operators import ownership as O
from marlstone.operators.textindex import TextIndex

LETTERS = "abÇİıß 12,-\n."


def scan(docs, term, around):
    marks = str.maketrans("çğıöşüÇĞİÖŞÜâîûÂÎÛ", "cgiosucgiosuaiuaiu")
    hits = []
    for i, text in docs:
        folded = (text or "").translate(marks).lower()
        at = folded.find(term)
        while i is not None and at >= 0:
            hits.append((i, at + 1, " ".join(text[max(0, at - around) : at + len(term) + around].replace("\n", " ").split(" "))))
            at = folded.find(term, at + len(term))
    return hits


def test_search_equals_a_scan(spark, tmp_path):
    rng = random.Random(7)
    docs = [(i, "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 200)))) for i in range(120)] + [(None, "abab"), (900, None), (901, ""), (902, "aaaaaaa aaaa")]
    df = spark.createDataFrame(docs, "k long, t string")
    index = TextIndex(spark, f"file://{tmp_path}/i", 8)
    index.build(df, "k", "t")
    terms = ["aaa", "ab1", "b, a", "a b", "1-2", "-12", "aba", "a.b", "---", "iba", "nowhere", "aaaa", "bc\n2"]
    got = index.search(df, "k", "t", " OR ".join(terms[:-1]), around=5).collect()
    seen = {}
    for r in got:
        seen.setdefault(r["term"], []).append((r["k"], r["at"]))
    for term in terms[:-1]:
        want = sorted((i, at) for i, at, _ in scan(docs, term.strip(), 5))
        assert sorted(seen.get(term.strip(), [])) == want, term
        assert all(r["found"] == len(want) for r in got if r["term"] == term.strip())
    first = index.search(df, "k", "t", "aba OR aaa", most=3).collect()
    counts = {t: len(scan(docs, t, 5)) for t in ("aba", "aaa")}
    assert [r["term"] for r in first] == [min(counts, key=counts.get)] * 3
    for bad in ("ab", "", "abc OR x"):
        with pytest.raises(ValueError):
            index.search(df, "k", "t", bad)


def test_context_is_of_the_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 300 + " \n Kâr  PAYI " + "y" * 300)], "k long, t string")
    index = TextIndex(spark, f"file://{tmp_path}/c", 2)
    index.build(df, "k", "t")
    row = index.search(df, "k", "t", "kar  payi").first()
    assert row["at"] == 304 and row["context"] == "x" * 157 + " Kâr PAYI " + "y" * 159


STAKE = "entity string, kind string, name string, share double"


def graph(spark, rows, aliases=None):
    df = spark.createDataFrame(rows, STAKE)
    alias = spark.createDataFrame(aliases, "key string, is string") if aliases else None
    stakes = O.links(df, "entity", "kind", "name", "share", F.lower(F.trim("name")), alias)
    return stakes, spark.createDataFrame([("bank a", "A"), ("bank b", "B"), ("bank c", "C")], "key string, entity string")


def test_edges(spark):
    stakes, entities = graph(spark, [
        ("A", "holder", "Bank B", 20.0), ("B", "sub", " BANK A", 21.0),  # one stake, filed by both
        ("A", "sub", "Bank B", 5.0),  # the other way round
        ("A", "sub", "Bank C", None), ("A", "sub", "The C", 7.0),  # twice by one side, once without a share
        ("B", "holder", "Fund", 9.0), ("A", "holder", "Fund", 3.0), ("A", "sub", "FUND", 1.0), ("B", "holder", "Lone", 1.0), ("B", "holder", "Lone", 2.0),
        ("C", "holder", None, 1.0), ("C", "holder", " ", 1.0),
    ], [("the c", "bank c")])
    assert {tuple(r) for r in O.edges(stakes, entities).collect()} == {("B", "A", "holder", 20.0), ("A", "B", "sub", 5.0), ("A", "C", "sub", 7.0)}
    assert [(r.key, r.degree, r.stakes) for r in O.shared(stakes, entities).collect()] == [("fund", 2, 3)]
    assert [tuple(r) for r in O.projection(stakes, entities).collect()] == [("A", "B", None, 1.0, 1)]


def test_pairs_add_up_and_hubs_stay(spark):
    rows = [(f"e{k}", "holder", n, 1.0) for n, size in (("x", 4), ("y", 3), ("z", 9)) for k in range(size)]
    stakes, entities = graph(spark, rows)
    got = {(r.a, r.b, r.holder): (r.weight, r.names) for r in O.projection(stakes, entities, up_to=5).collect()}
    assert got["e0", "e1", None] == (pytest.approx(1 / 3 + 1 / 2), 2) and got["e0", "e3", None] == (pytest.approx(1 / 3), 1)
    assert sum(h == "z" for _, _, h in got) == 9 and len(got) == 6 + 9


def test_a_hub_of_a_million_links(spark):
    stakes = spark.range(1_000_000).select(F.concat(F.lit("e"), "id").alias("entity"), F.lit("holder").alias("kind"), F.when(F.col("id") % 1000 == 0, F.concat(F.lit("s"), (F.col("id") / 2000).cast("long"))).otherwise("hub").alias("key"), F.lit("l").alias("label"), F.lit(1.0).alias("share"))
    entities = spark.createDataFrame([("bank a", "A")], "key string, entity string")
    got = O.projection(stakes, entities)
    assert got.where("holder = 'hub'").count() == 999_000 and got.where("holder is null").count() == 500


def test_conflicts_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(s, k, rng.sample("abcdefgh", rng.randint(0, 4))) for s in ("x", "y") for k in range(1000 if s == "x" else 40)]
    rows += [("z", 1, ["a", None, "a"]), ("z", 2, None), ("z", 3, [None]), ("w", 1, ["a"]), ("w", 2, ["b"]), ("w", 2, ["b"])]
    got = X.conflicts(spark.createDataFrame(rows, "s string, k int, v array<string>"), "s", "k", "v")
    sets = [(s, k, {v for v in vs or [] if v}) for s, k, vs in rows if {v for v in vs or [] if v}]
    want = sorted((s, k, sum(a == s and not vs & ws for a, _, ws in sets), sum(a == s for a, _, _ in sets)) for s, k, vs in sets)
    assert sorted(map(tuple, got.collect())) == want
    total = {r.s: r.contradictions for r in X.contradicted(got, "s").collect()}
    assert total["w"] == 2 and total["z"] == 0 and total["x"] == sum(w[2] for w in want if w[0] == "x") // 2
    with pytest.raises(Exception, match="values in a statement"):
        X.conflicts(spark.createDataFrame([("x", 1, [str(i) for i in range(13)])], "s string, k int, v array<string>"), "s", "k", "v").collect()
