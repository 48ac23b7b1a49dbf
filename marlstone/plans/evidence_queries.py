"""Checks whose two sides come from different tables or periods, and what evidence says of those that fail."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import triage as T
from ..operators.checks import mismatch
from ..sources.tables import money, table
from .registry import query

QUARTERS = """oq AS (SELECT c_nationkey AS g, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::INT AS o, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS booked FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    lq AS (SELECT c_nationkey AS g, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::INT AS o, coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag <> 'R'), 0)::DOUBLE AS come, coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag = 'R'), 0)::DOUBLE AS gone FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def _quarter(c):
    return (F.year(c) * 4 + F.quarter(c) - 1).cast("int")


def _booked(spark, sf):
    """What orders say, by nation and quarter of the order."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    at = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return at.groupBy(F.col("c_nationkey").alias("g"), _quarter("o_orderdate").alias("o")).agg(F.sum(money("o_totalprice")).cast("double").alias("booked"))


def _moved(spark, sf):
    """What lines say, by nation and quarter of shipping."""
    lines, orders, customers = table(spark, sf, "lineitem"), table(spark, sf, "orders", ["o_orderkey", "o_custkey"]), table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    at = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    price, back = money("l_extendedprice"), F.col("l_returnflag") == "R"
    of = lambda c: F.coalesce(F.sum(F.when(c, price)), F.lit(0)).cast("double")
    return at.groupBy(F.col("c_nationkey").alias("g"), _quarter("l_shipdate").alias("o")).agg(of(~back).alias("come"), of(back).alias("gone"))


def _before(df, column, name, back=1):
    return df.select("g", (F.col("o") + back).alias("o"), F.col(column).alias(name))


@query(f"""WITH {QUARTERS} SELECT a.g, a.o, CASE WHEN b.booked IS NULL OR come IS NULL THEN 'skip' WHEN abs(b.booked + come / 4 - gone / 2 - a.booked) <= greatest(10, 0.1 * abs(a.booked)) THEN 'pass' ELSE 'fail' END AS verdict, round(b.booked + come / 4 - gone / 2 - a.booked, 4) AS gap FROM oq a LEFT JOIN oq b ON b.g = a.g AND b.o = a.o - 1 LEFT JOIN lq ON lq.g = a.g AND lq.o = a.o""")
def roll_forward_check(spark, sf):
    """Last quarter's orders, moved by what lines say came and went, against this quarter's orders, within a tenth."""
    at = _booked(spark, sf)
    met = at.join(_before(at, "booked", "opening"), ["g", "o"], "left").join(_moved(spark, sf), ["g", "o"], "left")
    gap = F.col("opening") + F.col("come") / 4 - F.col("gone") / 2 - F.col("booked")
    room = F.greatest(F.lit(10.0), 0.1 * F.abs("booked"))
    return met.select("g", "o", F.when(gap.isNull(), "skip").when(F.abs(gap) <= room, "pass").otherwise("fail").alias("verdict"), F.round(gap, 4).alias("gap"))


@query("""WITH e AS (SELECT l_orderkey AS k, l_linenumber AS n, sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(18,2))::DOUBLE AS d, sum(l_extendedprice::DECIMAL(18,2) * l_tax::DECIMAL(18,2))::DOUBLE AS t, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS p FROM lineitem GROUP BY ALL), s AS (SELECT k, sum((p - d + t)::DECIMAL(38,6))::DOUBLE AS net, count(*) AS n FROM e GROUP BY k),
    c AS (SELECT o_custkey AS g, o_orderkey AS k, o_orderdate, o_totalprice AS total, net, n, sum(o_totalprice::DECIMAL(18,2)) OVER w AS run, sum(net::DECIMAL(38,6)) OVER w AS net_run FROM orders LEFT JOIN s ON s.k = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT g, k, CASE WHEN net IS NULL THEN 'skip' WHEN abs(total - net) <= greatest(10, 0.25 * greatest(abs(total), abs(net))) THEN 'pass' ELSE 'fail' END AS own, CASE WHEN net_run IS NULL THEN 'skip' WHEN abs(run::DOUBLE - net_run::DOUBLE) <= greatest(10, 0.25 * greatest(abs(run::DOUBLE), abs(net_run::DOUBLE))) THEN 'pass' ELSE 'fail' END AS chain FROM c""")
def equity_change(spark, sf):
    """A customer's orders as movements: each order's total against its lines less discount and with tax, and the closing after each against the lines of all so far."""
    p = money("l_extendedprice")
    each = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").agg(F.sum(p).cast("double").alias("p"), F.sum(p * money("l_discount")).cast("double").alias("d"), F.sum(p * money("l_tax")).cast("double").alias("t"))
    net = each.groupBy("k").agg(F.sum((F.col("p") - F.col("d") + F.col("t")).cast("decimal(38,6)")).cast("double").alias("net"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), "o_orderdate", F.col("o_totalprice").alias("total"))
    w = Window.partitionBy("g").orderBy("o_orderdate", "k").rowsBetween(Window.unboundedPreceding, 0)
    at = orders.join(net, "k", "left").withColumn("run", F.sum(money("total")).over(w).cast("double")).withColumn("net_run", F.sum(F.col("net").cast("decimal(38,6)")).over(w).cast("double"))
    judge = lambda a, b: F.when(F.col(b).isNull(), "skip").when(T.near(F.col(a), F.col(b), 10.0, 0.25), "pass").otherwise("fail")
    return at.select("g", "k", judge("total", "net").alias("own"), judge("run", "net_run").alias("chain"))


@query(f"""WITH {QUARTERS}, y AS (SELECT g, o // 4 AS y, sum(booked::DECIMAL(38,6))::DOUBLE AS told FROM oq GROUP BY ALL), z AS (SELECT g, o // 4 AS y, sum((come + gone)::DECIMAL(38,6))::DOUBLE AS parts FROM lq GROUP BY ALL)
    SELECT g, y::INT AS y, CASE WHEN told IS NULL OR parts IS NULL OR greatest(told, parts) < 1000 THEN 'skip' WHEN abs(told - parts) / greatest(told, parts) > 0.05 THEN 'fail' ELSE 'pass' END AS verdict, round(abs(told - parts) / greatest(told, parts), 6) AS gap FROM y FULL JOIN z USING (g, y)""")
def anchor_total(spark, sf):
    """A year's total as booked against the one restated from its lines; over five percent apart is a mismatch."""
    year = F.floor(F.col("o") / 4).cast("int").alias("y")
    total = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    told = _booked(spark, sf).groupBy("g", year).agg(total(F.col("booked")).alias("told"))
    parts = _moved(spark, sf).groupBy("g", year).agg(total(F.col("come") + F.col("gone")).alias("parts"))
    gap = mismatch(F.col("told"), F.col("parts"))
    raw = F.abs(F.col("told") - F.col("parts")) / F.greatest("told", "parts")
    both = told.join(parts, ["g", "y"], "full")
    return both.select("g", "y", F.when(gap.isNull(), "skip").when(gap > 0.05, "fail").otherwise("pass").alias("verdict"), F.when(F.col("told").isNotNull() & F.col("parts").isNotNull(), F.round(raw, 6)).alias("gap"))


@query("""WITH t AS (SELECT l_suppkey AS g, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::INT AS o, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS whole, sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag <> 'R')::DOUBLE AS own FROM lineitem GROUP BY ALL), r AS (SELECT g, o, CASE WHEN own > 0 THEN whole / own - 1 END AS gap FROM t)
    SELECT a.g, a.o, round(a.gap - b.gap, 6) AS move FROM r a JOIN r b ON a.g = b.g AND b.o = a.o - 1 WHERE abs(a.gap - b.gap) > 0.03""")
def perimeter_gap(spark, sf):
    """The gap between consolidated figures (all lines) and own ones (lines not returned) moves by over 3 points from one quarter to the next."""
    p = money("l_extendedprice")
    at = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g"), _quarter("l_shipdate").alias("o")).agg(F.sum(p).cast("double").alias("whole"), F.sum(F.when(F.col("l_returnflag") != "R", p)).cast("double").alias("own"))
    at = at.select("g", "o", F.when(F.col("own") > 0, F.col("whole") / F.col("own") - 1).alias("gap"))
    met = at.join(_before(at, "gap", "was"), ["g", "o"])
    return met.where(F.abs(F.col("gap") - F.col("was")) > 0.03).select("g", "o", F.round(F.col("gap") - F.col("was"), 6).alias("move"))


@query("""WITH e AS (SELECT l_orderkey AS k, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v, max(l_shipdate)::DATE AS d FROM lineitem GROUP BY 1), f AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS told, o_orderdate::DATE AS stamp FROM orders), o AS (SELECT e.k, e.v, f.c FROM e JOIN f USING (k)),
    m AS (SELECT DISTINCT f.k FROM f JOIN o ON o.c = f.c AND o.k <> f.k AND abs(f.told - o.v) <= 0.005 * o.v)
    SELECT f.k, CASE WHEN e.v IS NULL THEN CASE WHEN m.k IS NOT NULL THEN 'MISFILED' ELSE 'MISSING' END WHEN abs(told - e.v) > 0.2 * e.v THEN CASE WHEN m.k IS NOT NULL THEN 'MISFILED' ELSE 'CONTRADICTED' END WHEN date_diff('day', e.d, stamp) > 7 THEN 'STALE' ELSE 'PASS' END AS verdict FROM f LEFT JOIN e USING (k) LEFT JOIN m USING (k)""")
def fact_scoring(spark, sf):
    """What orders claim against what their lines say: missing, misfiled (it is what another order of the customer says), contradicted, stale, or passed."""
    log = table(spark, sf, "lineitem", ["l_orderkey", "l_extendedprice", "l_shipdate"]).groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(money("l_extendedprice")).cast("double").alias("v"), F.to_date(F.max("l_shipdate")).alias("d"))
    claims = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("told"), F.to_date("o_orderdate").alias("asof"))
    # near values share a step of the logarithm or stand in neighbouring ones: a join by equality
    step = lambda v: F.floor(F.log(v) / 0.006).cast("long")
    others = claims.select("k", "c").join(log, "k").where("v > 0").select("c", F.col("k").alias("other"), "v", F.explode(F.array(*(step(F.col("v")) + i for i in (-1, 0, 1)))).alias("s"))
    said = claims.where("told > 0").select("k", "c", "told", step(F.col("told")).alias("s"))
    misfiled = said.join(others, ["c", "s"]).where("k != other and abs(told - v) <= 0.005 * v").select("k").distinct().withColumn("misfiled", F.lit(True))
    both = claims.join(log, "k", "left").join(misfiled, "k", "left")
    elsewhere = F.col("misfiled").isNotNull()
    verdict = F.when(F.col("v").isNull(), F.when(elsewhere, "MISFILED").otherwise("MISSING")).when(F.abs(F.col("told") - F.col("v")) > 0.2 * F.col("v"), F.when(elsewhere, "MISFILED").otherwise("CONTRADICTED")).when(F.datediff("asof", "d") > 7, "STALE").otherwise("PASS")
    return both.select("k", verdict.alias("verdict"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY ALL), g AS (SELECT k, list(v ORDER BY n) AS page, k % 9 AS h, count(*) AS n FROM l GROUP BY k),
    f AS (SELECT k, page, list_sum(page) AS whole, h, CASE h WHEN 1 THEN page[2:] WHEN 2 THEN list_prepend(-page[1], page[2:]) WHEN 3 THEN list_append(page, page[1]) WHEN 6 THEN [] ELSE page END AS parts FROM g),
    t AS (SELECT k, parts, CASE h WHEN 5 THEN list_append(page, whole) ELSE page END AS page, CASE h WHEN 4 THEN whole * 1000 WHEN 5 THEN NULL WHEN 7 THEN whole + 7.5 ELSE whole END AS told, coalesce(list_sum(parts), 0) AS s FROM f),
    r AS (SELECT k, told, s, len(parts) AS n, [p FOR p IN parts IF abs(told - (s - 2 * p)) <= greatest(0.5, 1e-9 * greatest(abs(told), abs(s - 2 * p)))] AS sign, [p FOR p IN parts IF abs(told - (s - p)) <= 0.5 AND len([q FOR q IN parts IF abs(p - q) <= 0.5]) > 1] AS twice,
        [v FOR v IN page IF abs(told - (s + v)) <= 0.5 AND len([q FOR q IN parts IF abs(v - q) <= 0.5]) = 0] AS lost, [v FOR v IN page IF abs(v - s) <= 0.5] AS there FROM t)
    SELECT k, CASE WHEN n = 0 THEN 'not captured' WHEN told IS NULL THEN CASE WHEN len(there) > 0 THEN 'total not read' ELSE 'source' END WHEN abs(told - s) <= 0.5 THEN 'clean' WHEN abs(told - s * 1000) <= 0.5 OR abs(told * 1000 - s) <= 0.5 OR abs(told - s * 1e6) <= 0.5 OR abs(told * 1e6 - s) <= 0.5 THEN 'unit' WHEN len(sign) > 0 THEN 'sign' WHEN len(twice) > 0 THEN 'double' WHEN len(lost) > 0 THEN 'missing row' ELSE 'source' END AS cause FROM r""")
def broken_checks_triage(spark, sf):
    """Why an order's total and its captured lines disagree, told from the amounts on the page; a row is lost, turned, doubled or out of unit in some."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.sum(money("l_extendedprice")).cast("double").alias("v"))
    at = lines.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("x")).select("k", F.transform("x", lambda x: x["v"]).alias("page"))
    h, page, none = F.col("k") % 9, F.col("page"), F.array().cast("array<double>")
    first, rest = page[0], F.slice("page", F.lit(2), F.size("page"))
    whole = F.aggregate("page", F.lit(0.0), lambda a, p: a + p)
    parts = F.when(h == 1, rest).when(h == 2, F.concat(F.array(-first), rest)).when(h == 3, F.concat(page, F.array(first))).when(h == 6, none).otherwise(page)
    told = F.when(h == 4, whole * 1000).when(h == 7, whole + 7.5).when(h != 5, whole)
    seen = F.when(h == 5, F.concat(page, F.array(whole))).otherwise(page)
    got = at.select("k", told.alias("told"), parts.alias("parts"), seen.alias("page"))
    return got.select("k", T.cause(F.col("told"), F.col("parts"), F.col("page")).alias("cause"))
