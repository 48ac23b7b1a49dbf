"""Families of metrics with their own guards: flows and stocks by month, real terms, bridges, runs, ladders, positions, snapshots, totals, matrices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import panel as P
from ..operators import series as S
from ..operators.checks import verdict
from ..sources.tables import money, supplier_quarters, table
from .bundle_queries import PRICES, _months_back, _prices, _totals
from .identity_queries import STATEMENT, _statement
from .metric_queries import ORD, _ord
from .registry import MONTHLY, SUPPLIER, query
from .series_queries import r6

FLAGS = "fl AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate) - 1)::INT AS o, " + ", ".join(f"coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag = '{f}'), 0)::DOUBLE AS {f.lower()}" for f in "ANR") + " FROM lineitem WHERE NOT (year(l_shipdate) = 1997 AND month(l_shipdate) = 6) GROUP BY 1)"
YTD = f"{FLAGS}, yt AS (SELECT o, " + ", ".join(f"(sum({f}::DECIMAL(38,6)) OVER w)::DOUBLE AS {f}" for f in "anr") + " FROM fl WINDOW w AS (PARTITION BY o // 12 ORDER BY o ROWS UNBOUNDED PRECEDING))"


def _flags(spark, sf):
    """``o, a, n, r``: three flows by month, one month missing."""
    o = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("int")
    lines = table(spark, sf, "lineitem", ["l_shipdate", "l_returnflag", "l_extendedprice"]).where(~((F.year("l_shipdate") == 1997) & (F.month("l_shipdate") == 6)))
    flow = lambda f: F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, money("l_extendedprice"))), F.lit(0)).cast("double").alias(f.lower())
    return lines.groupBy(o.alias("o")).agg(*(flow(f) for f in "ANR"))


def _ytd(spark, sf):
    w = Window.partitionBy(F.floor(F.col("o") / 12)).orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    return _flags(spark, sf).select("o", *(F.sum(F.col(f).cast("decimal(38,6)")).over(w).cast("double").alias(f) for f in "anr"))


@query(f"""WITH {YTD}, s AS (SELECT o, lag(o) OVER w AS po, {", ".join(f"{f} - coalesce(CASE WHEN o % 12 > 0 THEN lag({f}) OVER w END, 0) AS {f}" for f in "anr")} FROM yt WINDOW w AS (ORDER BY o))
    SELECT o, round(r, 2) AS income, round(a, 2) AS cost, round(n, 2) AS other, round(r - a - n, 2) AS net, round(CASE WHEN r <> 0 THEN abs(a) / abs(r) END, 6) AS cost_income FROM s WHERE o % 12 = 0 OR po = o - 1""")
def profit_bridge(spark, sf):
    """Single months out of sums since January, no month after a hole; what income is left after two costs; cost by income."""
    w = Window.orderBy("o")  # one row per month
    at = _ytd(spark, sf)
    single = [(F.col(f) - F.coalesce(F.when(F.col("o") % 12 > 0, F.lag(f).over(w)), F.lit(0.0))).alias(f) for f in "anr"]
    got = at.select("o", *single, F.lag("o").over(w).alias("po")).where("o % 12 = 0 or po = o - 1")
    return got.select("o", F.round("r", 2).alias("income"), F.round("a", 2).alias("cost"), F.round("n", 2).alias("other"), F.round(F.col("r") - F.col("a") - F.col("n"), 2).alias("net"), r6(F.when(F.col("r") != 0, F.abs("a") / F.abs("r")), "cost_income"))


@query(f"""WITH {YTD}, t AS (SELECT c.o, c.r + d.r - p.r AS flow FROM yt c JOIN yt d ON d.o = c.o - c.o % 12 - 1 JOIN yt p ON p.o = c.o - 12), m AS (SELECT o, (sum(n::DECIMAL(38,6)) OVER w)::DOUBLE / 13 AS stock, count(*) OVER w AS k FROM yt WINDOW w AS (ORDER BY o RANGE BETWEEN 12 PRECEDING AND CURRENT ROW))
    SELECT o, round(flow, 2) AS flow, round(stock, 4) AS stock, round(CASE WHEN stock > 0 THEN 100 * flow / stock END, 6) AS margin FROM t JOIN m USING (o) WHERE k = 13""")
def margin_twelve_months(spark, sf):
    """This year's sum, last December's and less the same month's a year ago, over the mean of thirteen month-ends, all of which are required."""
    at = _ytd(spark, sf)
    december = at.where("o % 12 = 11").select((F.col("o") + 1).alias("january"), F.col("r").alias("dec"))
    ago = at.select((F.col("o") + 12).alias("o"), F.col("r").alias("ago"))
    w = Window.orderBy("o").rangeBetween(-12, 0)  # one row per month
    stocks = at.withColumn("january", F.col("o") - F.col("o") % 12).withColumn("k", F.count("*").over(w)).withColumn("stock", F.sum(F.col("n").cast("decimal(38,6)")).over(w).cast("double") / 13).where("k = 13")
    got = stocks.join(december, "january").join(ago, "o").withColumn("flow", F.col("r") + F.col("dec") - F.col("ago"))
    return got.select("o", F.round("flow", 2).alias("flow"), F.round("stock", 4).alias("stock"), r6(S.safe_div(100 * F.col("flow"), F.col("stock")), "margin"))


@query(f"""WITH {MONTHLY}, {ORD}, tot AS (SELECT o, sum(v::DECIMAL(38,6))::DOUBLE AS v FROM t GROUP BY o), {PRICES}, f AS (SELECT arg_min(tot.v, o) AS v0, arg_min(pr.v, o) AS p0 FROM tot JOIN pr USING (o)), x AS (SELECT o, 100 * tot.v / v0 AS nominal, 100 * (tot.v / v0) / (pr.v / p0) AS real FROM tot JOIN pr USING (o), f),
    i AS (SELECT a.o, (a.v / b.v - 1) * 100 AS i FROM pr a JOIN pr b ON b.o = a.o - 12), g AS (SELECT a.o, ((a.v / c.v) / (b.v / d.v) - 1) * 100 AS growth FROM tot a JOIN tot b ON b.o = a.o - 12 JOIN pr c ON c.o = a.o JOIN pr d ON d.o = b.o)
    SELECT o, kind, round(v, 4) AS v FROM (SELECT o, 'nominal' AS kind, nominal AS v FROM x UNION ALL SELECT o, 'real', real FROM x UNION ALL SELECT o, 'growth', growth FROM g UNION ALL SELECT o, 'ex ante', (1.3 / (1 + i / 100) - 1) * 100 FROM i WHERE i > -100)""")
def real_long(spark, sf):
    """Nominal and real indices, real growth from levels, and a rate less expected inflation, as one long table."""
    prices = _prices(spark, sf)
    both = _totals(spark, sf).join(prices.withColumnRenamed("v", "p"), "o")
    first = both.agg(F.min_by("v", "o").alias("v0"), F.min_by("p", "o").alias("p0"))  # one row
    index = both.crossJoin(F.broadcast(first)).select("o", (100 * F.col("v") / F.col("v0")).alias("nominal"), (100 * (F.col("v") / F.col("v0")) / (F.col("p") / F.col("p0"))).alias("real"))
    ago = both.select((F.col("o") + 12).alias("o"), F.col("v").alias("v1"), F.col("p").alias("p1"))
    growth = both.join(ago, "o").select("o", (((F.col("v") / F.col("p")) / (F.col("v1") / F.col("p1")) - 1) * 100).alias("v"))
    inflation = _months_back(prices, 12).select("o", ((F.col("v") / F.col("base") - 1) * 100).alias("i"))
    ante = inflation.select("o", S.fisher(F.lit(30.0), F.col("i")).alias("v")).where("v is not null")
    long = index.unpivot(["o"], ["nominal", "real"], "kind", "v")
    rest = growth.select("o", F.lit("growth").alias("kind"), "v").unionByName(ante.select("o", F.lit("ex ante").alias("kind"), "v"))
    return long.unionByName(rest).select("o", "kind", F.round("v", 4).alias("v"))


@query(f"""WITH {SUPPLIER}, x AS (SELECT a.g, a.o, a.flow, b.flow AS was, a.qty, b.qty AS qty0, a.flow / a.qty AS p, b.flow / b.qty AS p0 FROM sq a JOIN sq b ON b.g = a.g AND b.o = a.o - 1 WHERE a.qty > 0 AND b.qty > 0)
    SELECT g, o, round(was, 2) AS opening, round((qty - qty0) * p0, 4) AS volume, round((p - p0) * qty0, 4) AS price, round(flow - was - (qty - qty0) * p0 - (p - p0) * qty0, 4) AS mix, round(flow, 2) AS closing FROM x""")
def growth_bridge(spark, sf):
    """From one quarter's sum to the next one's by volume, price, and what both make together."""
    back = lambda c: F.max(c).over(Window.partitionBy("g").orderBy("o").rangeBetween(-1, -1))
    at = supplier_quarters(spark, sf).withColumn("was", back("flow")).withColumn("qty0", back("qty")).where("qty > 0 and qty0 > 0")
    p, p0 = F.col("flow") / F.col("qty"), F.col("was") / F.col("qty0")
    volume, price = (F.col("qty") - F.col("qty0")) * p0, (p - p0) * F.col("qty0")
    return at.select("g", "o", F.round("was", 2).alias("opening"), F.round(volume, 4).alias("volume"), F.round(price, 4).alias("price"), F.round(F.col("flow") - F.col("was") - volume - price, 4).alias("mix"), F.round("flow", 2).alias("closing"))


@query(f"""WITH {MONTHLY}, {ORD}, x AS (SELECT a.g, a.o, a.v, b.v AS other, a.v > b.v AS over, a.v >= 0.98 * lag(a.v) OVER (PARTITION BY a.g ORDER BY a.o) AS holds FROM t a JOIN t b ON b.o = a.o AND b.g = 'BUILDING' WHERE a.g <> 'BUILDING'),
    y AS (SELECT *, sum(CASE WHEN over THEN 0 ELSE 1 END) OVER w AS e1, sum(CASE WHEN holds THEN 0 ELSE 1 END) OVER w AS e2 FROM x WINDOW w AS (PARTITION BY g ORDER BY o DESC)) SELECT g, count(*) FILTER (e1 = 0) AS above_other, count(*) FILTER (e2 = 0) AS holding FROM y GROUP BY g""")
def run_variants(spark, sf):
    """Last months in a row above another series, and last months in a row that fell by 2 % at most."""
    at = _ord(spark, sf)
    base = at.where("g = 'BUILDING'").select("o", F.col("v").alias("other"))
    both = at.where("g != 'BUILDING'").join(base, "o").withColumn("was", F.lag("v").over(Window.partitionBy("g").orderBy("o")))
    return S.tail_run(both, ["g"], "o", F.col("v") > F.col("other"), "above_other").join(S.tail_run(both, ["g"], "o", F.col("v") >= 0.98 * F.col("was"), "holding"), "g")


@query(f"""WITH {MONTHLY}, {ORD} SELECT a.g, a.o, round(a.v, 2) AS now, round(m.v, 2) AS month_ago, round(y.v, 2) AS year_ago, round(a.v - q.v, 2) AS quarter_change FROM t a LEFT JOIN t m ON m.g = a.g AND m.o = a.o - 1 LEFT JOIN t y ON y.g = a.g AND y.o = a.o - 12 LEFT JOIN t q ON q.g = a.g AND q.o = a.o - 3""")
def comparison_cells(spark, sf):
    """Each month beside the month and the year before, and its change over a quarter."""
    back = lambda n: F.max("v").over(Window.partitionBy("g").orderBy("o").rangeBetween(-n, -n))
    return _ord(spark, sf).select("g", "o", F.round("v", 2).alias("now"), F.round(back(1), 2).alias("month_ago"), F.round(back(12), 2).alias("year_ago"), F.round(F.col("v") - back(3), 2).alias("quarter_change"))


CLASSES = {"STANDARD": "core", "SMALL": "core", "MEDIUM": "core", "LARGE": "growth", "ECONOMY": "growth"}


@query("""WITH t AS (SELECT p_brand AS g, CASE p_type WHEN 'STANDARD' THEN 'core' WHEN 'SMALL' THEN 'core' WHEN 'MEDIUM' THEN 'core' WHEN 'LARGE' THEN 'growth' WHEN 'ECONOMY' THEN 'growth' ELSE 'other' END AS c, sum(p_retailprice::DECIMAL(18,2))::DOUBLE AS v FROM part GROUP BY ALL), w AS (SELECT g, sum(v::DECIMAL(38,6))::DOUBLE AS total, coalesce(max(v) FILTER (c = 'core'), 0) AS core, coalesce(max(v) FILTER (c = 'growth'), 0) AS growth, coalesce(max(v) FILTER (c = 'other'), 0) AS other FROM t GROUP BY g)
    SELECT g, round(100 * core / total, 6) AS core, round(100 * growth / total, 6) AS growth, round(100 * other / total, 6) AS other FROM w WHERE total > 0""")
def allocation_mix(spark, sf):
    """Two stages: kinds to classes by a map with a default, then classes as columns of shares."""
    of = F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv))
    sums = table(spark, sf, "part", ["p_brand", "p_type", "p_retailprice"]).groupBy(F.col("p_brand").alias("g"), F.coalesce(F.try_element_at(of, F.col("p_type")), F.lit("other")).alias("c")).agg(F.sum(money("p_retailprice")).cast("double").alias("v"))
    part = lambda c: F.coalesce(F.max(F.when(F.col("c") == c, F.col("v"))), F.lit(0.0)).alias(c)
    wide = sums.groupBy("g").agg(P.exact_sum(F.col("v")).cast("double").alias("total"), part("core"), part("growth"), part("other")).where("total > 0")
    return wide.select("g", *(r6(100 * F.col(c) / F.col("total"), c) for c in ("core", "growth", "other")))


@query(f"""WITH {STATEMENT}, b AS (SELECT g, o, coalesce(v1, 0) - coalesce(v5, 0) AS g1, coalesce(v2, 0) - coalesce(v6, 0) AS g2, coalesce(v3, 0) - coalesce(v7, 0) AS g3, coalesce(v4, 0) AS s FROM st)
    SELECT g, o, round(g1, 2) AS to_month, round(g1 + g2, 2) AS to_quarter, round(g1 + g2 + g3, 2) AS to_year, round(g1 * 0.01 * (1 - 1 / 24) + g2 * 0.01 * (1 - 2 / 12) + g3 * 0.01 * (1 - 7.5 / 12), 9) AS shock, round(CASE WHEN g % 3 > 0 THEN 0.1 * s * (0.45::DOUBLE - 0.12::DOUBLE) END, 9) AS migration FROM b""")
def repricing_ladder(spark, sf):
    """Gaps added up along the ladder, a shock of a hundred points on them, and a tenth of a stage moving to one that is better covered."""
    v = lambda k: F.coalesce(F.col(f"v{k}"), F.lit(0.0))
    g1, g2, g3 = v(1) - v(5), v(2) - v(6), v(3) - v(7)
    shock = g1 * 0.01 * (1 - F.lit(1 / 24)) + g2 * 0.01 * (1 - F.lit(2 / 12)) + g3 * 0.01 * (1 - F.lit(7.5 / 12))
    low, high = F.lit(0.12), F.when(F.col("g") % 3 > 0, 0.45).otherwise(0.1)
    return _statement(spark, sf).select("g", "o", F.round(g1, 2).alias("to_month"), F.round(g1 + g2, 2).alias("to_quarter"), F.round(g1 + g2 + g3, 2).alias("to_year"), F.round(shock, 9).alias("shock"), F.round(F.when(high > low, 0.1 * v(4) * (high - low)), 9).alias("migration"))


@query(f"""WITH l AS (SELECT l_suppkey AS g, sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag = 'A')::DOUBLE AS usd, sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag = 'N')::DOUBLE AS eur, sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag = 'R')::DOUBLE AS capital FROM lineitem GROUP BY 1)
    SELECT g, round(100 * usd / capital, 6) AS usd, round(100 * eur / capital, 6) AS eur, round(100 * abs(usd - eur) / capital, 6) AS net FROM l WHERE capital > 0""")
def currency_positions(spark, sf):
    """Currencies as columns in percent of capital, and the net position, whatever its sign."""
    part = lambda f, name: F.sum(F.when(F.col("l_returnflag") == f, money("l_extendedprice"))).cast("double").alias(name)
    at = table(spark, sf, "lineitem", ["l_suppkey", "l_returnflag", "l_extendedprice"]).groupBy(F.col("l_suppkey").alias("g")).agg(part("A", "usd"), part("N", "eur"), part("R", "capital")).where("capital > 0")
    of = lambda c: 100 * c / F.col("capital")
    return at.select("g", r6(of(F.col("usd")), "usd"), r6(of(F.col("eur")), "eur"), r6(of(F.abs(F.col("usd") - F.col("eur"))), "net"))


@query(f"""WITH {STATEMENT}, s AS (SELECT o, v1 / (v1 + v2) AS share FROM st WHERE v1 IS NOT NULL AND v2 IS NOT NULL) SELECT o, count(*) AS n, round(median(share), 6) AS share, round(min(share), 6) AS low, round(max(share), 6) AS high FROM s GROUP BY o HAVING count(*) >= 3""")
def line_share_profile(spark, sf):
    """The median share of a line in its family by period, with the range, where three members have both."""
    s = _statement(spark, sf).where("v1 is not null and v2 is not null").select("o", (F.col("v1") / (F.col("v1") + F.col("v2"))).alias("share"))
    q = P.quantiles(s, ["o"], "share", [0.0, 0.5, 1.0], ["low", "mid", "high"]).where("there >= 3")
    return q.select("o", F.col("there").alias("n"), r6(F.col("mid"), "share"), r6(F.col("low"), "low"), r6(F.col("high"), "high"))


@query(f"""WITH {SUPPLIER}, e AS (SELECT g, o, stock FROM sq WHERE o % 4 = 3) SELECT a.g, a.o, round(a.stock, 2) AS now, round(e.stock, 2) AS year_end, round(y.stock, 2) AS year_before, round(a.stock - e.stock, 2) AS since FROM sq a LEFT JOIN e ON e.g = a.g AND e.o = a.o - a.o % 4 - 1 LEFT JOIN sq y ON y.g = a.g AND y.o = a.o - 4""")
def anchor_joins(spark, sf):
    """Each quarter beside the last year-end and the same quarter a year before."""
    at = supplier_quarters(spark, sf).select("g", "o", "stock").withColumn("year", F.floor(F.col("o") / 4))
    ends = at.where("o % 4 = 3").select("g", (F.col("year") + 1).alias("year"), F.col("stock").alias("e"))
    before = F.max("stock").over(Window.partitionBy("g").orderBy("o").rangeBetween(-4, -4))
    got = at.withColumn("b", before).join(ends, ["g", "year"], "left")
    return got.select("g", "o", F.round("stock", 2).alias("now"), F.round("e", 2).alias("year_end"), F.round("b", 2).alias("year_before"), F.round(F.col("stock") - F.col("e"), 2).alias("since"))


@query("""WITH d AS (SELECT o_orderstatus AS g, o_orderdate::DATE AS d, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY ALL), l AS (SELECT g, date_trunc('month', d)::DATE AS m, max(d) AS d FROM d GROUP BY ALL) SELECT l.g, l.m AS month, d.d, round(d.v, 2) AS v FROM l JOIN d ON d.g = l.g AND d.d = l.d""")
def month_end_snapshots(spark, sf):
    """The last observation of each month."""
    at = table(spark, sf, "orders", ["o_orderstatus", "o_orderdate", "o_totalprice"]).groupBy(F.col("o_orderstatus").alias("g"), F.to_date("o_orderdate").alias("d")).agg(F.sum(money("o_totalprice")).cast("double").alias("v"))
    return at.groupBy("g", F.to_date(F.date_trunc("month", "d")).alias("month")).agg(F.max("d").alias("last"), F.round(F.max_by("v", "d"), 2).alias("v")).select("g", "month", F.col("last").alias("d"), "v")


@query("""WITH s AS (SELECT s_nationkey AS k, sum(s_acctbal::DECIMAL(18,2)) AS total, count(*) AS n FROM supplier GROUP BY 1) SELECT s_suppkey AS g, n - 1 AS peers, round(CASE WHEN n > 1 THEN (total - s_acctbal::DECIMAL(18,2))::DOUBLE / (n - 1) END, 6) AS others, round(s_acctbal - CASE WHEN n > 1 THEN (total - s_acctbal::DECIMAL(18,2))::DOUBLE / (n - 1) END, 4) AS gap FROM supplier JOIN s ON k = s_nationkey""")
def peers_without_self(spark, sf):
    """Each member against the mean of the others of its class."""
    at = table(spark, sf, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    sums = at.groupBy("s_nationkey").agg(F.sum(money("s_acctbal")).alias("total"), F.count("*").alias("n"))
    others = F.when(F.col("n") > 1, (F.col("total") - money("s_acctbal")).cast("double") / F.nullif(F.col("n") - 1, F.lit(0)))
    return at.join(sums, "s_nationkey").select(F.col("s_suppkey").alias("g"), (F.col("n") - 1).alias("peers"), r6(others, "others"), F.round(F.col("s_acctbal") - others, 4).alias("gap"))


@query("""SELECT o_orderkey AS k, date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders))::INT AS age FROM orders WHERE o_orderdate::DATE > (SELECT max(o_orderdate)::DATE FROM orders) - 90""")
def recent_rows(spark, sf):
    """Rows of the ninety days up to the table's last one."""
    orders = table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    last = orders.agg(F.to_date(F.max("o_orderdate")).alias("last"))  # one row
    age = F.datediff("last", F.to_date("o_orderdate"))
    return orders.crossJoin(F.broadcast(last)).select(F.col("o_orderkey").alias("k"), age.alias("age")).where("age < 90")


@query("""SELECT p_brand AS g, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS deviation, round(stddev_samp(p_retailprice) / sqrt(count(*)), 6) AS error, round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 6) AS spread FROM part GROUP BY 1 HAVING count(*) >= 2""")
def sample_statistics(spark, sf):
    at = table(spark, sf, "part", ["p_brand", "p_retailprice"]).select(F.col("p_brand").alias("g"), F.col("p_retailprice").alias("x"))
    q = P.quantiles(at, ["g"], "x", [0.25, 0.75], ["low", "high"]).select("g", (F.col("high") - F.col("low")).alias("spread"))
    sums = at.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("deviation")).where("n >= 2")
    return sums.join(q, "g").select("g", "n", r6(F.col("mean"), "mean"), r6(F.col("deviation"), "deviation"), r6(F.col("deviation") / F.sqrt("n"), "error"), r6(F.col("spread"), "spread"))


@query("""SELECT o_orderpriority AS part, count(*) AS rows, sum(('0x' || substr(md5(o_orderkey::VARCHAR || '|' || o_orderstatus || '|' || o_custkey::VARCHAR), 1, 8))::BIGINT)::BIGINT AS digest FROM orders GROUP BY 1""")
def content_digests(spark, sf):
    """A digest of each part of a table from its rows' hashes, whatever their order."""
    row = F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", F.col("o_custkey").cast("string")))
    part = F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("part")).agg(F.count("*").alias("rows"), F.sum(part).alias("digest"))


@query(f"""WITH {STATEMENT}, c AS (SELECT g, o, v1, v2, v3, v1 + v2 + CASE WHEN g % 5 = 0 THEN 100 ELSE 0 END AS total, v1 + v2 + v3 + CASE WHEN g % 7 = 0 THEN 1000 ELSE 0 END AS grand FROM st)
    SELECT g, o, CASE WHEN v1 IS NULL OR v2 IS NULL THEN 'skip' WHEN g % 5 = 0 AND 100 > greatest(3, abs(total) * 1e-5) THEN 'fail' ELSE 'pass' END AS currencies, CASE WHEN v1 IS NULL OR v2 IS NULL OR v3 IS NULL THEN 'skip' WHEN g % 7 = 0 AND 1000 > greatest(10, abs(grand) * 5e-5) THEN 'fail' ELSE 'pass' END AS sections FROM c""")
def totals_identities(spark, sf):
    """Two currencies make the total, and all sections the grand total, each at its own tolerance."""
    v1, v2, v3 = (F.col(f"v{k}") for k in (1, 2, 3))
    total = v1 + v2 + F.when(F.col("g") % 5 == 0, 100).otherwise(0)
    grand = v1 + v2 + v3 + F.when(F.col("g") % 7 == 0, 1000).otherwise(0)
    return _statement(spark, sf).select("g", "o", verdict(v1 + v2, total, 3.0, 1e-5).alias("currencies"), verdict(v1 + v2 + v3, grand, 10.0, 5e-5).alias("sections"))


@query("""WITH l AS (SELECT l_suppkey AS g, l_returnflag AS a, l_linestatus AS b, l_linenumber AS c, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY ALL), m AS (SELECT g, a, b, sum(v::DECIMAL(38,6))::DOUBLE + max(CASE WHEN g % 11 = 0 THEN 500 ELSE 0 END) AS v FROM l GROUP BY g, a, b), t AS (SELECT g, a, sum(v::DECIMAL(38,6))::DOUBLE AS v FROM m GROUP BY ALL), d AS (SELECT g, a, sum(v::DECIMAL(38,6))::DOUBLE AS v FROM l GROUP BY ALL)
    SELECT t.g, t.a, CASE WHEN abs(t.v - d.v) <= greatest(5, abs(t.v) * 5e-5) THEN 'pass' ELSE 'fail' END AS deep FROM t JOIN d ON d.g = t.g AND d.a = t.a""")
def deep_sums(spark, sf):
    """A total, made of middle lines, against the sum of the lines two levels below."""
    lines = table(spark, sf, "lineitem", ["l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice"]).groupBy(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.sum(money("l_extendedprice")).cast("double").alias("v"))
    middle = F.col("v") + F.when(F.col("g") % 11 == 0, 500).otherwise(0)
    got = lines.groupBy("g", "a").agg(P.exact_sum(middle).cast("double").alias("t"), P.exact_sum(F.col("v")).cast("double").alias("d"))
    return got.select("g", "a", verdict(F.col("d"), F.col("t"), 5.0, 5e-5).alias("deep"))


BANDS = [("capital", "v1", 1e3, 5e6), ("liquidity", "v2", 1e3, 4e5), ("position", "v3", 5e4, 5e6), ("repricing", "v4", 0.0, 1e9)]


@query(f"""WITH {STATEMENT}, r AS (SELECT g, o, unnest(['capital', 'liquidity', 'position', 'repricing']) AS rule, unnest([v1, v2, v3, v4]) AS v, unnest([1e3, 1e3, 5e4, 0]) AS low, unnest([5e6, 4e5, 5e6, 1e9]) AS high FROM st) SELECT rule, CASE WHEN v IS NULL THEN 'skip' WHEN v BETWEEN low AND high THEN 'pass' ELSE 'fail' END AS verdict, count(*) AS n FROM r GROUP BY ALL""")
def statement_bands(spark, sf):
    """Each statement's figure against its own band, and how many passed."""
    rules = F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(c).alias("v"), F.lit(low).alias("low"), F.lit(high).alias("high")) for name, c, low, high in BANDS)))
    at = _statement(spark, sf).select("g", "o", rules)
    return at.select("rule", F.when(F.col("v").isNull(), "skip").when(F.col("v").between(F.col("low"), F.col("high")), "pass").otherwise("fail").alias("verdict")).groupBy("rule", "verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {STATEMENT}, p AS (SELECT DISTINCT o FROM st), k AS (SELECT o, row_number() OVER (ORDER BY o DESC) AS k FROM p), x AS (SELECT g, k, unnest(['v1', 'v2', 'v3']) AS line, unnest([v1, v2, v3]) AS v FROM st JOIN k USING (o) WHERE k <= 4) SELECT g, line, round(max(v) FILTER (k = 1), 2) AS p1, round(max(v) FILTER (k = 2), 2) AS p2, round(max(v) FILTER (k = 3), 2) AS p3, round(max(v) FILTER (k = 4), 2) AS p4 FROM x GROUP BY ALL""")
def period_matrix(spark, sf):
    """Lines of a statement over the last four periods as columns."""
    at = _statement(spark, sf).select("g", "o", "v1", "v2", "v3")
    periods = at.select("o").distinct().orderBy(F.col("o").desc()).limit(4)
    number = periods.withColumn("k", F.row_number().over(Window.orderBy(F.col("o").desc())))  # four rows
    long = at.join(F.broadcast(number), "o").unpivot(["g", "k"], ["v1", "v2", "v3"], "line", "v")
    return long.groupBy("g", "line").agg(*(F.round(F.max(F.when(F.col("k") == k, F.col("v"))), 2).alias(f"p{k}") for k in range(1, 5)))


SHARES = {"finished": ("F", "FOP"), "open_part": ("O", "OP"), "pending": ("P", "FOP")}


@query("""WITH m AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS o, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F') AS f, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'O') AS op, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'P') AS p, sum(o_totalprice::DECIMAL(18,2)) AS t FROM orders GROUP BY 1)
    SELECT o, round(100 * f::DOUBLE / t::DOUBLE, 6) AS finished, round(100 * op::DOUBLE / (coalesce(op, 0) + coalesce(p, 0))::DOUBLE, 6) AS open_part, round(100 * p::DOUBLE / t::DOUBLE, 6) AS pending FROM m""")
def share_family(spark, sf):
    """Shares by a table of numerators and denominators, all from one scan."""
    total = lambda codes: F.sum(F.when(F.col("o_orderstatus").isin(*codes), money("o_totalprice"))).cast("double")
    o = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int")
    sums = table(spark, sf, "orders", ["o_orderstatus", "o_orderdate", "o_totalprice"]).groupBy(o.alias("o")).agg(*(x for name, (num, den) in SHARES.items() for x in (total(num).alias(f"{name}_n"), total(den).alias(f"{name}_d"))))
    return sums.select("o", *(r6(S.safe_div(100 * F.col(f"{name}_n"), F.col(f"{name}_d")), name) for name in SHARES))


@query("""SELECT p_partkey AS k, (CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN -(p_size * 1000 + 5) ELSE p_size * 1000 + 5 END)::DOUBLE AS amount, [p_size::DOUBLE, 12.5] AS figures, (CASE WHEN p_partkey % 2 = 0 THEN p_size * 1000.0 ELSE p_size * 1000000.0 END)::DOUBLE AS scaled FROM part""")
def amounts_in_prose(spark, sf):
    """Amounts with dashes, parentheses and grouped digits; figures of a sentence; amounts by their unit's word."""
    size = F.col("p_size")
    shown = F.format_number(size * 1000 + 5, 0)
    text = F.when(F.col("p_partkey") % 4 == 0, "—").when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    prose = F.concat(F.lit("rose by "), size.cast("string"), F.lit(" to 12.5 over the year"))
    unit = F.when(F.col("p_partkey") % 2 == 0, "thousand").otherwise("million")
    factor = F.create_map(F.lit("thousand"), F.lit(1e3), F.lit("million"), F.lit(1e6))
    return table(spark, sf, "part", ["p_partkey", "p_size"]).select(F.col("p_partkey").alias("k"), X.parse_number(text).alias("amount"), X.numbers_in(prose).alias("figures"), (size * F.try_element_at(factor, unit)).alias("scaled"))


@query(f"""WITH {SUPPLIER}, s AS (SELECT g, max(o) AS o FROM sq GROUP BY g), x AS (SELECT s.g, s.o, flow FROM s JOIN sq USING (g, o)) SELECT g, (o + k)::INT AS o, round(flow * pow(1.02, k), 4) AS path FROM x, range(1, 9) t(k)""")
def projection_paths(spark, sf):
    """An entity's last flow carried eight quarters on."""
    last = P.latest(supplier_quarters(spark, sf), ["g"], ["o"], ["o", "flow"])
    return last.select("g", "o", "flow", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).select("g", (F.col("o") + F.col("k")).cast("int").alias("o"), F.round(F.col("flow") * F.pow(F.lit(1.02), F.col("k")), 4).alias("path"))
