"""Faults seeded in small tables are found, clean ones are silent; specs, gateway and streams by hand."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import dsl
from marlstone.functions import text as X
from marlstone.operators import checks as C
from marlstone.operators import keyed as K
from marlstone.operators import panel as P
from marlstone.operators import series as S
from marlstone.plans import catalog, gateway
from marlstone.sources import html
from marlstone.sources.tables import table, without_nan, write_csv


def test_gap_does_not_stretch_the_window(spark):
    start = dt.date(2020, 1, 6)
    rows = [("a", start + dt.timedelta(weeks=k), 100.0 + k) for k in range(80)] + [("b", start + dt.timedelta(weeks=k), 100.0) for k in range(80) if not 8 <= k <= 20]
    got = {(r.g, r.d): r.growth for r in S.tolerant_growth(spark.createDataFrame(rows, "g string, d date, v double"), ["g"], "d", "v").collect()}
    assert got["a", start + dt.timedelta(weeks=52)] == pytest.approx(52)
    assert ("b", start + dt.timedelta(weeks=66)) not in got and ("b", start + dt.timedelta(weeks=60)) in got
    zero = spark.createDataFrame([("a", start, 0.0), ("a", start + dt.timedelta(weeks=52), 5.0)], "g string, d date, v double")
    assert S.tolerant_growth(zero, ["g"], "d", "v").count() == 0


def test_year_to_date_and_trailing_sums(spark):
    rows = [(o, float(v)) for o, v in [(8000, 10), (8001, 25), (8002, 45), (8003, 70), (8004, 15), (8006, 60)]]
    at = S.trailing_sum(S.decumulate(spark.createDataFrame([("x", *r) for r in rows], "g string, o int, ytd double"), ["g"], "o", "ytd"), ["g"], "o", "single")
    got = {r.o: (r.single, r.ttm) for r in at.collect()}
    assert got == {8000: (10, None), 8001: (15, None), 8002: (20, None), 8003: (25, 70), 8004: (15, 75), 8006: (None, None)}


def test_asof_lookback(spark):
    d = dt.date
    left = spark.createDataFrame([("k", d(2020, 1, 10)), ("k", d(2020, 2, 20)), ("z", d(2020, 1, 10))], "k string, d date")
    right = spark.createDataFrame([("k", d(2020, 1, 1), 5.0), ("k", d(2020, 1, 10), None), ("k", d(2020, 1, 11), 7.0)], "k string, d date, v double")
    assert {(r.k, r.d): r.v for r in S.asof(left, right, ["k"], "d", "v", 12).collect()} == {("k", d(2020, 1, 10)): 5.0, ("k", d(2020, 2, 20)): None, ("z", d(2020, 1, 10)): None}


def test_runs_and_steps(spark):
    at = spark.createDataFrame([("a", k, v) for k, v in enumerate([1.0, 5.0, None, 5.0, 6.0])] + [("b", 0, 0.0)], "g string, o int, v double")
    assert {r.g: r.run for r in S.tail_run(at, ["g"], "o", F.col("v") > 2).collect()} == {"a": 2, "b": 0}
    jump = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate([1, 2, 1, 2, 30, 31])], "g string, o int, v double")
    r = S.largest_step(jump, ["g"], "o", "v").first()
    assert (r["at"], r.step, r.rest, r.breaks) == (4, 28.0, 2.0, True)


def test_midranks_and_peers(spark):
    at = spark.createDataFrame([(k, 1, v) for k, v in enumerate([1.0, 2.0, 2.0, 2.0, None])] + [(9, 2, 7.0)], "k int, f int, v double")
    got = {r.k: r.score for r in P.midrank_score(at, ["f"], "v").collect()}
    assert got == {0: 0.0, 1: pytest.approx(2 / 3), 2: pytest.approx(2 / 3), 3: pytest.approx(2 / 3), 4: None, 9: 0.5}
    few = spark.createDataFrame([(k, "a" if k < 8 else "b", float(k)) for k in range(10)], "e int, c string, v double")
    ranks = {r.e: (r.field, r["rank"]) for r in P.peer_rank(few, "e", "c", "v").collect()}
    assert ranks[7] == ("a", 1) and ranks[9] == ("all", 1) and ranks[8] == ("all", 2)


def test_validators_find_seeded_faults(spark):
    good = [("I", None, 30.0), ("I.1", "I", 10.0), ("I.2", "I", 20.0), ("II", None, 5.0), ("II.1", "II", None)]
    nodes = spark.createDataFrame(good, "n string, p string, v double")
    assert {r.n: r.verdict for r in C.parent_sums(nodes, "n", "p", "v").collect()} == {"I": "pass", "II": "skip"}
    assert C.parent_sums(nodes.where("n != 'I.2'"), "n", "p", "v").where("verdict = 'fail'").count() == 1
    flows = spark.createDataFrame([("a", k, 100.0 * (1000 if k == 3 else 1)) for k in range(6)], "g string, o int, v double")
    assert sorted(r.o for r in C.ratio_breaks(flows, ["g"], "o", "v").collect()) == [3, 4]
    assert C.ratio_breaks(flows.where("o < 3"), ["g"], "o", "v").count() == 0
    lis = spark.createDataFrame([("a", k, v) for k, v in enumerate([1, 9, 2, 3, None, 4, 1])], "g string, o int, v int")
    assert [r.v for r in C.increasing_spine(lis, ["g"], "o", "v").orderBy("o").collect()] == [1, 2, 3, 4]


def test_numbers_and_text(spark):
    given = ["1.234,56", "1,234.56", "(12)", "-3,5", "1.234", "1.234.567", "—", "abc", None, "12%", "0,5", ""]
    got = [r.v for r in spark.createDataFrame([(x,) for x in given], "s string").select(X.parse_number(F.col("s")).alias("v")).collect()]
    assert got == [1234.56, 1234.56, -12.0, -3.5, 1234.0, 1234567.0, 0.0, None, None, 12.0, 0.5, None]
    r = spark.createDataFrame([("XIV", "iIıİ", "a, b;;c ")], "r string, i string, l string").select(X.roman(F.col("r")).alias("r"), X.upper_dotted(F.col("i")).alias("i"), X.split_list(F.col("l")).alias("l"), X.fold(F.col("i")).alias("f")).first()
    assert (r.r, r.i, r.l, r.f) == (14, "İIIİ", ["A", "B", "C"], "iiii")
    assert html.blocks_of("<nav>x</nav><p>a <b>b</b></p><script>1</script><ul><li>c&amp;d<li>e</ul>tail") == ["a b", "c&d", "e", "tail"] and html.blocks_of(None) == []


def test_blocks_of_pages_with_open_tags():
    from marlstone.sources.html import blocks_of

    assert blocks_of("<head><title>t</title><body><p>first</p><p>second</p>") == ["first", "second"]
    assert blocks_of("<html><head><meta charset=x><title>t</title><p>first<p>second") == ["first", "second"]
    assert blocks_of("<body><nav><a>menu</a><p>first</p></body>") == ["menu", "first"]  # never closed: hides nothing
    assert blocks_of("<div><nav><a>menu</a></div><p>first</p>") == ["first"]  # its parent's end closes it
    assert blocks_of("<nav><ul><li>a<li>b</ul></nav><p>first</p><footer>f</footer>x") == ["first", "x"]
    assert blocks_of("<head><script>var a = '<p>';</script></head><body>one<br>two<b>three</b>") == ["one", "twothree"]
    assert blocks_of("<p>a</p><script>never closed <p>b</p>") == ["a"]
    assert blocks_of("</div></p>a<style>x</style>b<title>in an svg</title>c") == ["a", "b", "c"]
    assert blocks_of("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]


def test_wrong_specs_are_told(spark):
    bad = {"id": "x", "title": "t", "series": [{"key": "a", "source": "nope"}, {"key": "b", "transform": "ratio", "of": ["a"]}, {"key": "c", "transform": "formula", "formula": {"ref": "d"}}, {"key": "d", "transform": "boil", "of": ["a"]}]}
    assert len(dsl.problems(bad, {"s"})) == 4
    s = spark.createDataFrame([(dt.date(2020, 1, k), float(k - 1)) for k in range(1, 5)], "d date, v double")
    spec = {"id": "x", "title": "t", "series": [{"key": "a", "source": "s"}, {"key": "q", "transform": "formula", "formula": {"op": "div", "args": [{"const": 6}, {"ref": "a"}]}}], "verify": [{"series": "q", "date": "2020-01", "value": 2.01, "tolerance": 1, "tolerance_unit": "percent"}]}
    done = dsl.resolve(spec, {"s": s})
    assert [r.v for r in done["q"].orderBy("d").collect()] == [6.0, 3.0, 2.0] and dsl.checks(spec, done)[0][3]


def test_gateway(spark):
    spark.createDataFrame([("a", "T", 1.0), ("a", "P", 1.0)], "e string, code string, v double").createOrReplaceTempView("gate_t")
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("gate_secret")
    policy = gateway.Policy(frozenset({"gate_t"}), {"code": {"T": "total", "P": "part", "Q": "part"}}, frozenset({"e"}), cap=1)
    ask = lambda q, question="": gateway.ask(spark, q, policy, question)
    assert ask("SELECT e FROM gate_t -- note\n").reason is None and ask("SELECT e FROM gate_t").rows.count() == 2
    for q in ("DROP TABLE gate_t", "SELECT 1; SELECT 2", "SELECT * FROM gate_secret", "SELECT * FROM gate_t WHERE v IN (SELECT x FROM gate_secret)", "INSERT INTO gate_t SELECT 1", "SELECT " + "1," * 2000 + "1", "nonsense"):
        assert ask(q).reason
    assert ask("SELECT sum(v) FROM gate_t").reason and ask("SELECT sum(v) FROM gate_t WHERE code IN ('T', 'P')").reason
    assert ask("SELECT sum(v) FROM gate_t WHERE code IN ('P', 'Q')").reason is None and ask("SELECT code, sum(v) FROM gate_t GROUP BY code").reason is None
    two = "SELECT v FROM gate_t WHERE e IN ('alpha', 'beta')"
    assert ask(two, "how is alpha?").reason and ask(two, "alpha or beta?").reason is None


def test_catalogue_slots_stay(spark):
    facts = spark.createDataFrame([("x", 1, dt.date(2020, 1, 1), 1.0), ("a", 1, dt.date(2021, 1, 1), 1.0)], "item string, g int, d date, v double")
    first = {r.item: r.slot for r in catalog.build(facts.where("item = 'a'"), "D", "M", "g").collect()}
    stored = spark.createDataFrame([("a", 1)], "item string, slot int")
    again = {r.item: r.slot for r in catalog.build(facts, "D", "M", "g", stored).collect()}
    assert first == {"a": 1} and again == {"a": 1, "x": 2}
    cat = catalog.build(facts, "D", "M", "g")
    assert [r.series_code for r in catalog.lookup(cat, ["MS.D.M.002.1", "MS.D.M.009.1", "MS.D.M.001.1"]).collect()] == ["MS.D.M.002.1", "MS.D.M.009.1", "MS.D.M.001.1"]
    with pytest.raises(ValueError):
        catalog.lookup(cat, ["x'; drop"])
    assert catalog.search(cat, "A", 0, 1)[1] == 1


def test_repeated_writes_change_nothing(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, None, 1)], "k int, v string, stamp int")
    assert K.changes(t, t.withColumn("stamp", F.lit(9)), ["k"], ("stamp",)).count() == 0
    up = K.upsert(t, spark.createDataFrame([(1, None, 2), (2, "z", 0)], "k int, v string, stamp int"), ["k"], "stamp", ("v",))
    assert {(r.k, r.v) for r in up.collect()} == {(1, "a"), (2, "z")}
    a, b = K.partition_digest(t, ["k"], ("stamp",)), K.partition_digest(t.unionByName(t), ["k"], ("stamp",))
    assert K.unchanged(a, a, ["k"]).count() == 2 and K.unchanged(b, a, ["k"]).count() == 0
    assert K.emptied(t, t.where("k = 1"), ["k"]).count() == 1
    old = spark.createDataFrame([(1, "x" * 500)], "k int, t string")
    assert K.shrink_guard(old, spark.createDataFrame([(1, "x" * 300), (2, "y")], "k int, t string"), ["k"], "t").count() == 1


def test_sinks_and_columns(spark, sf, tmp_path):
    write_csv(spark.createDataFrame([('a"b', 1)], "s string, n int"), f"file://{tmp_path}/c")
    assert spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/c").first().s == 'a"b'
    assert without_nan(spark.createDataFrame([(float("nan"),)], "x double")).first().x is None
    with pytest.raises(ValueError):
        table(spark, sf, "orders", ["o_nothing"])


def test_steps_hold_to_the_last_day_asked_for(spark):
    rates = spark.createDataFrame([(dt.date(2004, 1, 1), 1.0), (dt.date(2005, 1, 1), 2.0)], "d date, v double")
    got = {r.d: r.v for r in S.daily_steps(rates, "d", "v", dt.date(2031, 5, 1)).collect()}
    assert got[dt.date(2031, 5, 1)] == 2.0 and got[dt.date(2004, 12, 31)] == 1.0 and len(got) == (dt.date(2031, 5, 1) - dt.date(2004, 1, 1)).days + 1
    assert max(r.d for r in S.daily_steps(rates, "d", "v", dt.date(2003, 1, 1)).collect()) == dt.date(2005, 1, 1)


def test_asof_carries_over_months(spark):
    d = dt.date
    left = spark.createDataFrame([("k", d(2021, 7, 3)), ("k", d(2020, 1, 31)), (None, d(2021, 1, 1))], "k string, d date")
    right = spark.createDataFrame([("k", d(2020, 1, 1), 5.0), ("k", d(2020, 3, 1), 7.0), ("k", d(2021, 7, 4), 9.0), (None, d(2020, 12, 5), 1.0)], "k string, d date, v double")
    assert {(r.k, r.d): r.v for r in S.asof(left, right, ["k"], "d", "v").collect()} == {("k", d(2021, 7, 3)): 7.0, ("k", d(2020, 1, 31)): 5.0, (None, d(2021, 1, 1)): 1.0}


def test_codes_beyond_a_thousand_items_stay_apart(spark):
    rows = spark.range(1200).selectExpr("concat('i', id) AS item", "'g' AS g", "date'2020-01-01' AS d", "1.0D AS v")
    got = catalog.build(rows, "SQ", "Q", "g")
    assert got.select("series_code").distinct().count() == 1200 and all(catalog.CODE.match(r.series_code) for r in got.collect())


def test_gateway_keeps_to_allowed_views(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("seen_orders")
    policy = gateway.Policy(frozenset({"seen_orders"}))
    for sql in (
        f"SELECT o_orderkey FROM seen_orders UNION ALL SELECT l_orderkey FROM parquet.`{sf}/lineitem.parquet`",
        f"WITH x AS (SELECT * FROM parquet.`{sf}/nation.parquet`) SELECT 1 FROM seen_orders, x",
        f"SELECT o_orderkey FROM seen_orders WHERE o_custkey IN (SELECT c_custkey FROM parquet.`{sf}/customer.parquet`)",
        "SELECT java_method('java.lang.System', 'nanoTime') FROM seen_orders",
    ):
        assert gateway.ask(spark, sql, policy).reason
    ok = "WITH x AS (SELECT o_custkey, 2 AS two FROM seen_orders) SELECT a.o_custkey, two FROM x AS a JOIN x AS b USING (two, o_custkey) WHERE o_custkey IN (SELECT o_custkey FROM seen_orders)"
    assert gateway.ask(spark, ok, policy).reason is None


def test_digest_tells_null_from_text(spark):
    digest = lambda v: K.partition_digest(spark.createDataFrame([(1, v)], "k int, v string"), ["k"]).first().digest
    assert len({digest(v) for v in (None, "", "\x00", "null")}) == 4


def test_quantiles_and_ranks_of_odd_values(spark):
    rows = [("a", v) for v in (-1e300, -2.5, -2.5, 0.0, 1e-300, 3.0, 7e12)] + [("b", None), ("c", 4.0)]
    at = spark.createDataFrame(rows, "g string, v double")
    got = {r.v: (r.below, r.ties, r.there) for r in P.value_ranks(at, ["g"], "v").where("g = 'a'").collect()}
    assert got == {-1e300: (0, 1, 7), -2.5: (1, 2, 7), 0.0: (3, 1, 7), 1e-300: (4, 1, 7), 3.0: (5, 1, 7), 7e12: (6, 1, 7)}
    assert sorted(map(tuple, P.value_ranks(at, ["g"], "v", large=2).collect())) == sorted(map(tuple, P.value_ranks(at, ["g"], "v").collect()))
    q = {r.g: (r.low, r.mid) for r in P.quantiles(at, ["g"], "v", [1 / 12, 0.5], ["low", "mid"]).collect()}
    assert q == {"a": ((-1e300 - 2.5) / 2, 0.0), "c": (4.0, 4.0)}


def test_specs_name_bad_nodes():
    base = {"id": "x", "title": "t", "series": [{"key": "a", "source": "A"}]}
    for node in ({"op": "pow", "args": [{"ref": "a"}, {"const": 2}]}, {"op": "add", "args": [{"ref": "a"}, {"text": 1}]}, {"const": 3}, {"op": "add", "args": [{"ref": "a"}]}, {}):
        spec = {**base, "series": [*base["series"], {"key": "b", "transform": "formula", "formula": node}]}
        assert dsl.problems(spec, {"A"}), node


def test_near_values_are_ranked_in_pieces(spark):
    """A million values between 100 and 101, with far ones beside them: pieces are even, ranks exact."""
    near = spark.range(1_000_000).select(F.lit("hot").alias("g"), (100 + F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("v"))
    at = near.unionByName(spark.createDataFrame([("hot", 1e300), ("hot", -1e300), ("hot", None), ("cold", 1.0)], "g string, v double"))
    got = P.value_ranks(at, ["g"], "v").where("g = 'hot'").persist()
    assert got.agg(F.sum("ties"), F.max("there"), F.min("below"), F.max("below")).first() == (1_000_002, 1_000_002, 0, 1_000_001)
    w = Window.partitionBy("g").orderBy("v")
    assert got.withColumn("next", F.lead("below").over(w)).where("next is not null and next != below + ties").count() == 0
    plan = P.value_ranks(at, ["g"], "v")
    pieces = at.where("v is not null and g = 'hot'").select("v").distinct()
    cuts = pieces.agg(F.percentile_approx("v", [k / P.PIECES for k in range(1, P.PIECES)], 1000)).first()[0]
    largest = pieces.select(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v"))).alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert largest < 3 * pieces.count() / P.PIECES and plan.columns == ["g", "v", "ties", "below", "there"]
    got.unpersist()
