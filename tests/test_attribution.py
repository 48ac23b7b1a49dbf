"""Steps, drift, shares of a change, growth legs, next events, changelogs and scores by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.operators import attribution as A


def test_steps_and_drift(spark):
    flat = [("a", k, 10.0) for k in range(5)] + [("a", 5, 20.0)] + [("a", 6 + k, 20.0 + 0.5 * k) for k in range(10)]
    rows = [*flat, ("a", 99, None), *[("short", k, 1.0) for k in range(12)], *[("still", k, 5.0) for k in range(20)], *[("last", k, 1.0 if k < 19 else 3.0) for k in range(20)]]
    got = {r.g: r for r in A.step_and_drift(spark.createDataFrame(rows, "g string, o int, v double"), ["g"], "o", "v").collect()}
    a = got["a"]
    assert (a.total, a.step_at, a.step, a.rest, a.is_break) == (14.5, 5, 10.0, 4.5, True)
    assert (a.since, a.change) == (10, 4.5) and a.drift == pytest.approx(5.4)
    assert "short" not in got and not got["still"].is_break and got["still"].step == 0
    assert got["last"].since == 0 and got["last"].drift is None and got["last"].is_break


def test_parts_of_a_change(spark):
    rows = [("x", 0, 10.0), ("x", 12, 16.0), ("y", 0, 5.0), ("y", 12, 1.0), ("new", 12, 2.0), ("z", 0, None), ("z", 12, 4.0)]
    got = {r.p: (r.delta, r.share) for r in A.attributed(spark.createDataFrame(rows, "p string, o int, v double"), "p", "o", "v", 12).collect()}
    assert got == {"x": (6.0, pytest.approx(75.0)), "y": (-4.0, pytest.approx(-50.0))}
    still = spark.createDataFrame([("x", 0, 1.0), ("x", 12, 1.0)], "p string, o int, v double")
    assert A.attributed(still, "p", "o", "v", 12).first().share is None


def test_legs_add_up_and_wait_for_prices(spark):
    rows = [("a", 1, 30.0, 20.0, 10.0), ("a", 2, 44.0, 32.0, 10.0), ("a", 3, 50.0, 40.0, None), ("none", 1, 1.0, 1.0, None)]
    got = A.growth_legs(spark.createDataFrame(rows, "g string, o int, n double, x double, c double"), ["g"], "o", "n", "x", "c").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.asof, r.nominal, r.currency, r.lagged) == (2, 44.0, 12.0, True) and r.real == pytest.approx(20.0)
    assert r.nominal - r.currency - r.inflation == pytest.approx(r.real)


def test_next_event_of_a_day(spark):
    d = lambda k: dt.date(2024, 1, k)
    days = spark.createDataFrame([(d(k),) for k in (1, 5, 5, 6, 31)], "d date")
    events = spark.createDataFrame([(d(5),), (d(20),)], "e date")
    assert {r.d: r.next for r in A.next_event(days, "d", events, "e").collect()} == {d(1): d(5), d(5): d(5), d(6): d(20), d(31): None}


def test_changelog_is_dated_by_the_newest_source(spark):
    bullets = spark.createDataFrame([(1, "cap raised", [10, 11, 99]), (2, "no source", [99]), (3, "cap and floor", [12, 12]), (4, "other", [11]), (5, "cap", None)], "k int, t string, ids array<int>")
    sources = spark.createDataFrame([(10, "2024-01-01", "ok"), (11, "2024-03-01", "bad"), (12, "2024-02-01", "ok")], "id int, d string, title string")
    good, bad = F.col("title") == "ok", F.col("title") == "bad"
    got = {r.k: (r.date, r.source, r.agrees, r.conflicts) for r in A.changelog(bullets, "k", "t", "ids", sources, "id", "d", "title", [("cap", good, bad), ("floor", bad, good)]).collect()}
    assert got == {1: ("2024-03-01", 11, None, "cap"), 3: ("2024-02-01", 12, None, "floor"), 4: ("2024-03-01", 11, None, None)}


def test_scores(spark):
    quiet = [("e", "calm", k, 10.0 + (k % 2)) for k in range(12)] + [("e", "calm", 12, 90.0)]
    rows = [*quiet, ("e", "flip", 11, -5.0), ("e", "flip", 12, 5.0), ("e", "new", 12, 3.0), ("e", "TOTAL", 11, 1.0), ("e", "TOTAL", 12, 98.0), ("e", "gap", 10, 1.0), ("e", "gap", 12, 50.0)]
    got = {(r["item"], r["o"]): r for r in A.movement_scores(spark.createDataFrame(rows, "e string, item string, o int, v double"), "e", "item", "o", "v", "TOTAL", least=0.0).collect()}
    calm, flip, new, total, gap = (got[i, 12] for i in ("calm", "flip", "new", "TOTAL", "gap"))
    assert calm.z == 8.0 and calm.score == pytest.approx(12 + 3 * calm.share + 2)
    assert flip.flip and flip.z is None and flip.score == pytest.approx(3 * flip.share + 2 + 2)
    assert new.appeared and new.score == 1.5 and gap.score == 0 and not gap.appeared
    assert total.score == pytest.approx(0.4 * (3 * total.share + 2))


def test_implied_ratio_needs_a_book(spark):
    s = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0), (4, 5.0)], "d int, v double")
    b = spark.createDataFrame([(1, 50.0), (2, 50.0), (3, 0.0)], "d int, v double")
    assert [tuple(r) for r in A.implied_ratio(s, b, ["d"], "v").collect()] == [(1, 10.0)]
