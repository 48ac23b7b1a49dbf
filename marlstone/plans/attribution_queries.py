"""Where changes come from, what comes next, what cites what, and specs kept as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators.panel import exact_sum
from ..sources.tables import money, table, weekly_orders
from .registry import WEEKLY, query


def r4(c, name):
    return F.round(c, 4).alias(name)


@query(f"""WITH {WEEKLY} SELECT s.d, round(100 * s.v / b.v, 4) AS ratio FROM weekly s JOIN weekly b ON s.d = b.d WHERE s.g = 'P' AND b.g = 'F' AND b.v > 0""")
def implied_ratio(spark, sf):
    """A stock in percent of its book, week by week."""
    at = weekly_orders(spark, sf)
    return A.implied_ratio(at.where("g = 'P'"), at.where("g = 'F'"), ["d"], "v").select("d", r4(F.col("ratio"), "ratio"))


NATION_MONTHS = "nx AS (SELECT c_nationkey AS g, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS o, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), nm AS (SELECT * FROM nx WHERE o < (SELECT max(o) FROM nx))"


def _nation_months(spark, sf):
    """Order value by nation and month, without the last month, which isn't over."""
    orders, customers = table(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_totalprice"]), table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    at = orders.join(customers, orders.o_custkey == customers.c_custkey)
    got = at.groupBy(F.col("c_nationkey").alias("g"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int").alias("o")).agg(F.sum(money("o_totalprice")).cast("double").alias("v"))
    return got.join(F.broadcast(got.agg(F.max("o").alias("last"))), F.col("o") < F.col("last")).drop("last")


@query(f"""WITH {NATION_MONTHS}, m AS (SELECT g, o, v, v - lag(v) OVER w AS mv, row_number() OVER (PARTITION BY g ORDER BY o DESC) AS k FROM nm WINDOW w AS (PARTITION BY g ORDER BY o)),
    t AS (SELECT g, o AS step_at, k, mv AS step, v AS at_step FROM m WHERE k <= 12 QUALIFY row_number() OVER (PARTITION BY g ORDER BY abs(mv) DESC, o) = 1),
    e AS (SELECT g, max(v) FILTER (k = 13) AS a, max(v) FILTER (k = 1) AS b, avg(abs(mv)) FILTER (k <= 12) AS mean FROM m GROUP BY g)
    SELECT g, round(b - a, 2) AS total, step_at, round(step, 2) AS step, round(b - a - step, 2) AS rest, abs(step) > 3 * (12 * mean - abs(step)) / 11 AS is_break, (k - 1)::INT AS since, CASE WHEN k > 1 THEN round(b - at_step, 2) END AS change, CASE WHEN k > 1 THEN round((b - at_step) / (k - 1) * 12, 2) END AS drift FROM e JOIN t USING (g) WHERE a IS NOT NULL""")
def step_and_drift(spark, sf):
    """A year's change of each nation's orders: the largest step, the rest, and the drift since."""
    got = A.step_and_drift(_nation_months(spark, sf), ["g"], "o", "v")
    return got.select("g", *(F.round(c, 2).alias(c) if c in ("total", "step", "rest", "change", "drift") else F.col(c) for c in got.columns[1:]))


@query(f"""WITH {NATION_MONTHS}, t AS (SELECT o, sum(v::DECIMAL(38,6))::DOUBLE AS v FROM nm GROUP BY o), l AS (SELECT max(o) AS o FROM t), w AS (SELECT (SELECT v FROM t JOIN l USING (o)) - (SELECT t.v FROM t JOIN l ON t.o = l.o - 12) AS whole)
    SELECT a.g, round(a.v - b.v, 2) AS delta, round(100 * (a.v - b.v) / whole, 4) AS share FROM nm a JOIN l ON a.o = l.o JOIN nm b ON a.g = b.g AND b.o = l.o - 12, w""")
def stock_attribution(spark, sf):
    """Each nation's share in the year's change of all orders."""
    return A.attributed(_nation_months(spark, sf), "g", "o", "v", 12).select("g", F.round("delta", 2).alias("delta"), r4(F.col("share"), "share"))


@query("""WITH o AS (SELECT c_mktsegment AS g, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS o, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderpriority = '1-URGENT'), 0)::DOUBLE AS f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    p AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate) - 1)::INT AS o, avg(l_extendedprice) AS price, avg(1 + l_tax) AS rate FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01' GROUP BY 1),
    y AS (SELECT a.g, a.o, 100 * (a.v / b.v - 1) AS n, 100 * ((a.v - a.f + a.f * q.rate / p.rate) / b.v - 1) AS x, 100 * (p.price / q.price - 1) AS c FROM o a JOIN o b ON a.g = b.g AND b.o = a.o - 12 LEFT JOIN p ON p.o = a.o LEFT JOIN p q ON q.o = a.o - 12),
    r AS (SELECT *, ((1 + x / 100) / (1 + c / 100) - 1) * 100 AS real FROM y), l AS (SELECT g, max(o) FILTER (real IS NOT NULL) AS o, max(o) AS newest FROM r GROUP BY g)
    SELECT g, o AS asof, round(n, 4) AS nominal, round(n - x, 4) AS currency, round(x - real, 4) AS inflation, round(real, 4) AS real, newest > o AS lagged FROM r JOIN l USING (g, o)""")
def growth_legs(spark, sf):
    """From nominal growth to real growth: what the currency of a part and what prices take, where prices are published late."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    ordinal = lambda c: (F.year(c) * 12 + F.month(c) - 1).cast("int")
    zero = F.lit(0).cast("decimal(18,2)")
    at = orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy(F.col("c_mktsegment").alias("g"), ordinal("o_orderdate").alias("o")).agg(F.sum(money("o_totalprice")).cast("double").alias("v"), F.coalesce(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", money("o_totalprice"))), zero).cast("double").alias("f"))
    prices = table(spark, sf, "lineitem", ["l_shipdate", "l_extendedprice", "l_tax"]).where("l_shipdate < timestamp'2001-01-01'").groupBy(ordinal("l_shipdate").alias("o")).agg(F.avg("l_extendedprice").alias("price"), F.avg(1 + F.col("l_tax")).alias("rate"))
    before = at.select("g", (F.col("o") + 12).alias("o"), F.col("v").alias("was"))
    past = prices.select((F.col("o") + 12).alias("o"), F.col("price").alias("price_was"), F.col("rate").alias("rate_was"))
    # a row for each month
    rows = at.join(before, ["g", "o"]).join(F.broadcast(prices), "o", "left").join(F.broadcast(past), "o", "left")
    held = F.col("v") - F.col("f") + F.col("f") * F.col("rate_was") / F.col("rate")
    rows = rows.select("g", "o", (100 * (F.col("v") / F.col("was") - 1)).alias("n"), (100 * (held / F.col("was") - 1)).alias("x"), (100 * (F.col("price") / F.col("price_was") - 1)).alias("c"))
    got = A.growth_legs(rows, ["g"], "o", "n", "x", "c")
    return got.select("g", "asof", *(r4(F.col(c), c) for c in ("nominal", "currency", "inflation", "real")), "lagged")


@query("""WITH e AS (SELECT min(o_orderdate)::DATE AS e FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY date_trunc('month', o_orderdate)), d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) SELECT d, (SELECT min(e) FROM e WHERE e >= d) AS next, date_diff('day', d, (SELECT min(e) FROM e WHERE e >= d))::INT AS days FROM d""")
def next_events(spark, sf):
    """The next event on or after each day: the first urgent order of a month."""
    orders = table(spark, sf, "orders", ["o_orderdate", "o_orderpriority"]).withColumn("d", F.to_date("o_orderdate"))
    events = orders.where("o_orderpriority = '1-URGENT'").groupBy(F.date_trunc("month", "o_orderdate")).agg(F.min("d").alias("e"))
    return A.next_event(orders, "d", events, "e").select("d", "next", F.datediff("next", "d").alias("days"))


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, max(l_shipdate)::DATE AS date, min(l_returnflag) AS flag FROM lineitem WHERE l_quantity > 10 GROUP BY 1),
    x AS (SELECT o_orderkey AS k, o_orderpriority AS text, id, date, flag FROM orders JOIN s ON id BETWEEN o_orderkey * 10 + 1 AND o_orderkey * 10 + 7), n AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY date DESC, id) = 1)
    SELECT k, date, id AS source, CASE WHEN NOT ((text LIKE '%URGENT' AND flag = 'A') OR (text LIKE '%H%' AND flag = 'R')) THEN CASE WHEN text LIKE '%URGENT' AND flag = 'R' THEN 'URGENT$' WHEN text LIKE '%H%' AND flag = 'A' THEN 'H' END END AS agrees, CASE WHEN text LIKE '%URGENT' AND flag = 'A' THEN 'URGENT$' WHEN text LIKE '%H%' AND flag = 'R' THEN 'H' END AS conflicts FROM n""")
def changelog(spark, sf):
    """Statements dated by the newest source that each cites, and whether data agrees; unsourced ones are left out."""
    sources = table(spark, sf, "lineitem").where("l_quantity > 10").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.to_date(F.max("l_shipdate")).alias("date"), F.min("l_returnflag").alias("title"))
    k = F.col("o_orderkey")
    bullets = table(spark, sf, "orders", ["o_orderkey", "o_orderpriority"]).select(k.alias("k"), F.col("o_orderpriority").alias("text"), F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: k * 10 + i).alias("ids"))
    is_ = lambda flag: F.col("title") == flag
    return A.changelog(bullets, "k", "text", "ids", sources, "id", "date", "title", [("URGENT$", is_("R"), is_("A")), ("H", is_("A"), is_("R"))])


SUBJECTS = {"license": r"licen[cs]e", "contact": r"@", "words": r"idiot|stupid"}


@query("""WITH s(subject, p) AS (VALUES ('license', 'licen[cs]e'), ('contact', '@'), ('words', 'idiot|stupid')), h AS (SELECT subject, doc_id, source FROM documents, s WHERE doc_id IS NOT NULL AND regexp_matches(text, '(?is)(' || p || ').{0,90}\\d|\\d.{0,90}(' || p || ')'))
    SELECT subject, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source, count(*) - 1 AS superseded FROM h GROUP BY subject""")
def latest_sources(spark, sf):
    """The newest document that says something of each subject with a figure near it, and how many it supersedes."""
    docs = table(spark, sf, "documents", ["doc_id", "text", "source"]).where("doc_id is not null")
    says = [F.when(F.col("text").rlike(rf"(?is)({p}).{{0,90}}\d|\d.{{0,90}}({p})"), F.lit(s)) for s, p in SUBJECTS.items()]
    said = docs.select("doc_id", "source", F.explode(F.array_compact(F.array(*says))).alias("subject"))
    return said.groupBy("subject").agg(F.max("doc_id").alias("doc_id"), F.max_by("source", "doc_id").alias("source"), (F.count("*") - 1).alias("superseded"))


@query("""WITH i AS (SELECT l_suppkey AS g, l_returnflag AS item, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::INT AS o, sum(l_extendedprice::DECIMAL(18,2) * (l_discount - 0.05)::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY ALL), a AS (SELECT * FROM i UNION ALL SELECT g, 'TOTAL', o, sum(v::DECIMAL(38,6))::DOUBLE FROM i GROUP BY ALL),
    b AS (SELECT a.*, p.v AS before, row_number() OVER (PARTITION BY a.g, a.item ORDER BY a.o) = 1 AS first FROM a LEFT JOIN a p ON p.g = a.g AND p.item = a.item AND p.o = a.o - 1), d AS (SELECT *, v - before AS delta FROM b),
    h AS (SELECT d.g, d.item, d.o, avg(e.delta) AS mu, stddev_pop(e.delta) AS sd, count(e.delta) AS n FROM d JOIN d e ON e.g = d.g AND e.item = d.item AND e.o BETWEEN d.o - 16 AND d.o - 1 GROUP BY ALL),
    t AS (SELECT g, o, sum(abs(delta)::DECIMAL(38,6))::DOUBLE AS moved, max(abs(v)) AS size FROM d GROUP BY ALL),
    z AS (SELECT d.*, moved, size, CASE WHEN delta IS NOT NULL AND n >= 6 THEN least(CASE WHEN sd > 0 THEN abs((delta - mu) / sd) WHEN delta = mu THEN 0 ELSE 8 END, 8) END AS z, before IS NOT NULL AND sign(before) * sign(v) < 0 AS flip, first AND v <> 0 AS appeared FROM d JOIN t USING (g, o) LEFT JOIN h USING (g, item, o)),
    s AS (SELECT g, item, o, z, CASE WHEN moved > 0 THEN abs(delta) / moved END AS share, flip, appeared, (coalesce(z, 0) * 1.5 + least(coalesce(CASE WHEN moved > 0 THEN abs(delta) / moved END, 0), 0.6) * 3 + least(coalesce(CASE WHEN size > 0 THEN abs(delta) / size END, 0), 0.05) * 40 + CASE WHEN flip THEN 2 ELSE 0 END + CASE WHEN appeared THEN 1.5 ELSE 0 END) * CASE WHEN item = 'TOTAL' THEN 0.4 ELSE 1 END AS score FROM z)
    SELECT g, item, o, round(z, 4) AS z, round(share, 4) AS share, flip, appeared, round(score, 4) AS score FROM s WHERE score >= 4.00001""")
def movement_scores(spark, sf):
    """Movements of each supplier's items by how unusual they are; totals are damped."""
    net = money("l_extendedprice") * (F.col("l_discount") - 0.05).cast("decimal(18,2)")
    items = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("item"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int").alias("o")).agg(F.sum(net).cast("double").alias("v"))
    total = items.groupBy("g", F.lit("TOTAL").alias("item"), "o").agg(exact_sum(F.col("v")).cast("double").alias("v"))
    got = A.movement_scores(items.unionByName(total), "g", "item", "o", "v", "TOTAL", least=4.00001)
    return got.select("g", "item", "o", r4(F.col("z"), "z"), r4(F.col("share"), "share"), "flip", "appeared", r4(F.col("score"), "score"))


SPEC_SCHEMA = "id string, title string, series array<struct<key: string, source: string, locator: string, transform: array<struct<op: string, args: array<string>>>>>, verify array<struct<series: string, value: double>>"


@query("""SELECT p_partkey AS k, list_sort(list_filter([CASE WHEN p_size % 7 = 0 THEN 'missing title' END, CASE WHEN p_size % 5 = 0 THEN 'missing verify' END, CASE WHEN p_size % 3 = 0 THEN 'a needs a locator' END, CASE WHEN p_size % 11 = 0 THEN 'b refers to zz' END, CASE WHEN p_size % 5 <> 0 AND p_size % 4 = 0 THEN 'verify refers to q' END], lambda x: x IS NOT NULL)) AS problems FROM part WHERE p_size % 7 = 0 OR p_size % 5 = 0 OR p_size % 3 = 0 OR p_size % 11 = 0 OR p_size % 4 = 0""")
def spec_validation(spark, sf):
    """Specs stored as JSON, one for each part, and what is wrong with each: missing fields, locators and references."""
    at = table(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_size"])
    n = F.col("p_size")
    source = F.struct(F.lit("a").alias("key"), F.col("p_brand").alias("source"), F.when(n % 3 != 0, F.col("p_name")).alias("locator"), F.lit(None).cast("array<struct<op: string, args: array<string>>>").alias("transform"))
    derived = F.struct(F.lit("b").alias("key"), F.lit("derived").alias("source"), F.lit(None).cast("string").alias("locator"), F.array(F.struct(F.lit("ratio").alias("op"), F.array(F.lit("a"), F.when(n % 11 == 0, "zz").otherwise("a")).alias("args"))).alias("transform"))
    verify = F.when(n % 5 != 0, F.array(F.struct(F.when(n % 4 == 0, "q").otherwise("b").alias("series"), F.lit(1.0).alias("value"))))
    stored = at.select("p_partkey", F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.when(n % 7 != 0, F.col("p_name")).alias("title"), F.array(source, derived).alias("series"), verify.alias("verify"))).alias("spec"))
    spec = stored.select(F.col("p_partkey").alias("k"), F.from_json("spec", SPEC_SCHEMA).alias("s"))
    keys = F.transform("s.series", lambda x: x["key"])
    missing = F.array_compact(F.array(*(F.when(F.col(f"s.{c}").isNull(), F.lit(f"missing {c}")) for c in ("id", "title", "series", "verify"))))
    no_place = F.transform(F.filter("s.series", lambda x: (x["source"] != "derived") & x["locator"].isNull()), lambda x: F.concat(x["key"], F.lit(" needs a locator")))
    unknown = F.flatten(F.transform(F.filter("s.series", lambda x: x["transform"].isNotNull()), lambda x: F.transform(F.filter(F.array_distinct(F.flatten(F.transform(x["transform"], lambda t: t["args"]))), lambda a: ~F.array_contains(keys, a)), lambda a: F.concat(x["key"], F.lit(" refers to "), a))))
    points = F.coalesce(F.transform(F.filter("s.verify", lambda v: ~F.array_contains(keys, v["series"])), lambda v: F.concat(F.lit("verify refers to "), v["series"])), F.array().cast("array<string>"))
    return spec.select("k", F.array_sort(F.concat(missing, no_place, unknown, points)).alias("problems")).where(F.size("problems") > 0)
