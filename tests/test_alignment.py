"""Alignments against all placements, headers in pieces, deduction signs, flows that balance."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import alignment as L
from marlstone.operators import flows as W


def every_placement(fits):
    """The best placement by trying all, ties as the programme has them."""
    names, labels = len(fits), len(fits[0])
    best = None
    for at in itertools.product([*range(labels), None], repeat=names):
        real = [k for k in at if k is not None]
        if any(a >= b for a, b in zip(real[:-1], real[1:], strict=True)) or any(k is not None and not fits[i][k] for i, k in enumerate(at)):
            continue
        key = (-sum(fits[i][k] for i, k in enumerate(at) if k is not None), [labels if k is None else k for k in at])
        best = min(best or (key, at), (key, at))
    return list(best[1])


def test_order_match_equals_all_placements():
    rng = random.Random(4)
    for _ in range(300):
        names, labels = rng.randint(1, 4), rng.randint(1, 5)
        fits = [[rng.choice([0, 0, 1, 2]) * 1.0 for _ in range(labels)] for _ in range(names)]
        assert L.order_match(fits) == every_placement(fits)


BANK = (
    L.Template("conventional", (L.Role("interest income", "^I\\. .*INTEREST INCOME", 1, True), L.Role("interest expense", "INTEREST EXPENSE"), L.Role("net interest", "NET INTEREST", 1, True), L.Role("net profit", "NET PROFIT", 2, True))),
    L.Template("participation", (L.Role("profit share income", "PROFIT SHARE INCOME", 1, True), L.Role("profit share expense", "PROFIT SHARE EXPENSE"), L.Role("net profit", "NET PROFIT", 2, True))),
)


def test_templates(spark):
    rows = [
        (1, ["NOTE", "I. INTEREST INCOME", "II. INTEREST EXPENSE", "NET PROFIT OF SUBSIDIARIES", "NET INTEREST", "XVII. NET PROFIT"]),
        (2, ["PROFIT SHARE INCOME", "PROFIT SHARE EXPENSE", "NET PROFIT", None]),
        (3, ["NET PROFIT", "PROFIT SHARE INCOME"]),  # in the wrong order
        (4, []), (5, None), (6, ["I. INTEREST INCOME", "NET INTEREST"]),
    ]
    got = {r.k: r.a for r in spark.createDataFrame(rows, "k int, l array<string>").select("k", L.aligned("l", BANK).alias("a")).collect()}
    assert got[1].template == "conventional" and got[1].roles == {"interest income": 2, "interest expense": 3, "net interest": 5, "net profit": 6}
    assert got[2].template == "participation" and got[2].score == 4 and got[2].roles["net profit"] == 3
    assert all(got[k].template is None and got[k].score == 0 and got[k].roles == {} for k in (3, 4, 5, 6))


def test_signs_of_deductions(spark):
    rows = [(1, 100.0, -30.0, -20.0, 50.0), (2, 100.0, 30.0, 20.0, 50.0), (3, 100.0, 30.0, -20.0, 50.0), (4, 100.0, 30.0, 20.0, 90.0), (5, 100.0, None, 1.0, 1.0), (6, 100.0, 0.0, 0.0, 100.0)]
    df = spark.createDataFrame(rows, "k int, base double, a double, b double, target double")
    got = {r.k: r.v for r in df.select("k", L.chain_verdict(F.col("base"), [F.col("a"), F.col("b")], F.col("target")).alias("v")).collect()}
    assert got == {1: "filed", 2: "absolute", 3: "absolute", 4: "fail", 5: "skip", 6: "filed"}


BANDS = (("demand", "demand"), ("1m", "up to 1 month"), ("3m", "1 to 3 months"), ("12m", "3 to 12 months"), ("5y", "1 to 5 years"), ("more", "over 5 years"))


def test_headers_in_pieces_and_any_order(spark):
    whole = [(0, "demand"), (10, "up to|1 month"), (20, "1 to|3|months"), (30, "3 to 12|months"), (40, "1 to 5 years"), (50, "over|5 years")]
    parts = [(x + 1.5 * n, float(n), t) for x, text in whole for n, t in enumerate(text.split("|"))]
    random.Random(1).shuffle(parts)
    columns = [30.0, 0.0, 50.0, 10.0, 40.0, 20.0]
    assert L.column_model(columns, parts, BANDS) == ["12m", "demand", "more", "1m", "5y", "3m"]
    assert L.column_model([0, 10, 20, 30, 40, 50], [p for p in parts if p[0] < 20 or p[0] >= 30], BANDS) == ["demand", "1m", "3m", "12m", "5y", "more"]  # one between two known
    assert L.column_model([0, 10, 20, 25, 30, 40, 50], [p for p in parts if p[0] < 20 or p[0] >= 30], BANDS) == ["demand", "1m", None, None, "12m", "5y", "more"]  # two for one band
    assert L.column_model([0, 10, 20], parts, BANDS) is None  # three named are too few
    assert L.column_model([], parts, BANDS) is None and L.column_model([0.0], [], BANDS) is None
    turned = [(50 - x, y, t) for x, y, t in parts]
    assert L.column_model([0, 10, 20, 30, 40, 50], turned, BANDS) is None  # bands in falling order are no model
    df = spark.createDataFrame([(1, columns, parts), (2, None, None)], "k int, c array<double>, f array<struct<x: double, y: double, text: string>>")
    assert [r.b for r in df.orderBy("k").select(L.banded("c", "f", BANDS).alias("b")).collect()] == [["12m", "demand", "more", "1m", "5y", "3m"], None]


def test_flows_balance(spark):
    rng = random.Random(6)
    rows = [(k, *(rng.choice([None, 0.0, rng.uniform(-50, 100)]) for _ in range(5))) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double")
    got = W.balanced(df, ["k"], [W.Hub("h1", ("a", "b"), ("c",)), W.Hub("h2", ("d",), ("e",))]).collect()
    assert all(r.v > 0 for r in got)
    for k, a, b, c, d, e in rows:
        mine = [r for r in got if r.k == k]
        for hub in ("h1", "h2"):
            assert sum(r.v for r in mine if r.sink == hub) == pytest.approx(sum(r.v for r in mine if r.source == hub))
        net = sum(x or 0 for x in (a, b, d)) - sum(x or 0 for x in (c, e))
        assert sum(r.v for r in mine if r.sink == "profit") == pytest.approx(max(net, 0)) and sum(r.v for r in mine if r.source == "loss") == pytest.approx(max(-net, 0))
