"""Bundles of macro series, capital and funds stacks, ladders of findings, calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bundles as B
from ..operators import panel as P
from ..operators import series as S
from ..sources.tables import daily_orders, money, monthly_orders, supplier_quarters, table, weekly_orders
from .metric_queries import ORD, _ord
from .registry import DAILY, MONTHLY, SUPPLIER, WEEKLY, query
from .series_queries import RATES, _last_day, _rates, r6

TOTALS = f"{MONTHLY}, {ORD}, tot AS (SELECT o, sum(v::DECIMAL(38,6))::DOUBLE AS v FROM t GROUP BY o)"
PRICES = "pr AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate) - 1)::INT AS o, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY 1)"


def _totals(spark, sf):
    return _ord(spark, sf).groupBy("o").agg(P.exact_sum(F.col("v")).cast("double").alias("v"))


def _prices(spark, sf):
    o = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("int")
    lines = table(spark, sf, "lineitem", ["l_shipdate", "l_extendedprice", "l_quantity"])
    return lines.groupBy(o.alias("o")).agg((F.sum(money("l_extendedprice")).cast("double") / F.sum(money("l_quantity")).cast("double")).alias("v"))


def _months_back(df, n, out="base"):
    """The value n positions before, by position."""
    return df.join(df.select((F.col("o") + n).alias("o"), F.col("v").alias(out)), "o")


@query(f"""WITH {PRICES}, y AS (SELECT a.o, (a.v / b.v - 1) * 100 AS v FROM pr a JOIN pr b ON a.o = b.o + 12), m AS (SELECT a.o, (a.v / b.v - 1) * 100 AS v FROM pr a JOIN pr b ON a.o = b.o + 1),
    a12 AS (SELECT o, avg(v) OVER w AS v FROM y WINDOW w AS (ORDER BY o RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 12)
    SELECT 'yearly' AS series, o, round(v, 4) AS v FROM y UNION ALL SELECT 'monthly', o, round(v, 4) FROM m UNION ALL SELECT 'mean12', o, round(v, 4) FROM a12""")
def inflation_bundle(spark, sf):
    """Monthly and yearly change of prices, and the mean of twelve yearly ones."""
    prices = _prices(spark, sf)
    change = lambda n: _months_back(prices, n).select("o", ((F.col("v") / F.col("base") - 1) * 100).alias("v"))
    yearly = change(12)
    w = Window.orderBy("o").rangeBetween(-11, 0)  # one row per month
    mean = yearly.select("o", F.when(F.count("*").over(w) == 12, F.avg("v").over(w)).alias("v"))
    return B.stacked([("yearly", yearly), ("monthly", change(1)), ("mean12", mean)], ["o"], "v").withColumn("v", F.round("v", 4))


@query(f"""WITH {TOTALS}, imp AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate) - 1)::INT AS o, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY 1), n AS (SELECT tot.o, tot.v - imp.v AS net, tot.v AS x, imp.v AS m FROM tot JOIN imp USING (o)),
    r AS (SELECT o, net, x, m, (sum(net::DECIMAL(38,6)) OVER w)::DOUBLE AS net12, (sum(m::DECIMAL(38,6)) OVER w)::DOUBLE AS m12, count(*) OVER w AS k FROM n WINDOW w AS (ORDER BY o RANGE BETWEEN 11 PRECEDING AND CURRENT ROW))
    SELECT o, round(net, 2) AS net, round(net12, 2) AS net12, round(100 * x / m, 4) AS coverage, round(5e6 / (m12 / 12), 4) AS cover_months FROM r WHERE k = 12""")
def external_bundle(spark, sf):
    """Balance of two flows, its twelve-month sum, their coverage, and the months of imports that a reserve covers."""
    o = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("int")
    out = table(spark, sf, "lineitem", ["l_shipdate", "l_extendedprice"]).groupBy(o.alias("o")).agg(F.sum(money("l_extendedprice")).cast("double").alias("m"))
    both = _totals(spark, sf).join(out, "o").withColumn("net", F.col("v") - F.col("m"))
    w = Window.orderBy("o").rangeBetween(-11, 0)  # one row per month
    total = lambda c: F.sum(F.col(c).cast("decimal(38,6)")).over(w).cast("double")
    got = both.select("o", "v", "m", "net", total("net").alias("net12"), total("m").alias("m12"), F.count("*").over(w).alias("k")).where("k = 12")
    return got.select("o", F.round("net", 2).alias("net"), F.round("net12", 2).alias("net12"), F.round(100 * F.col("v") / F.col("m"), 4).alias("coverage"), F.round(F.lit(5e6) / (F.col("m12") / 12), 4).alias("cover_months"))


@query(f"""WITH {TOTALS}, {PRICES}, s AS (SELECT o, (sum(v::DECIMAL(38,6)) OVER w)::DOUBLE AS s, count(*) OVER w AS k FROM tot WINDOW w AS (ORDER BY o RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)), g AS (SELECT a.o, (a.s / b.s - 1) * 100 AS nominal FROM s a JOIN s b ON a.o = b.o + 12 WHERE a.k = 12 AND b.k = 12),
    i AS (SELECT a.o, (a.v / b.v - 1) * 100 AS inflation FROM pr a JOIN pr b ON a.o = b.o + 12)
    SELECT g.o, round(nominal, 4) AS nominal, round(((1 + nominal / 100) / (1 + inflation / 100) - 1) * 100, 4) AS real, round(100 * s.s / (pr.v * 1e4), 4) AS share FROM g JOIN i USING (o) JOIN s USING (o) JOIN pr USING (o)""")
def budget_bundle(spark, sf):
    """Growth of a twelve-month flow in nominal and real terms, and the flow as a share of a base."""
    w = Window.orderBy("o").rangeBetween(-11, 0)  # one row per month
    sums = _totals(spark, sf).select("o", F.when(F.count("*").over(w) == 12, F.sum(F.col("v").cast("decimal(38,6)")).over(w).cast("double")).alias("v")).where("v is not null")
    prices = _prices(spark, sf)
    nominal = _months_back(sums, 12).select("o", ((F.col("v") / F.col("base") - 1) * 100).alias("nominal"))
    inflation = _months_back(prices, 12).select("o", F.col("v").alias("p"), ((F.col("v") / F.col("base") - 1) * 100).alias("inflation"))
    base = prices.select("o", (F.col("v") * 1e4).alias("v"))
    share = B.share_of_trailing(_totals(spark, sf), base, "o", "v", 12)
    return nominal.join(inflation, "o").join(share, "o").select("o", F.round("nominal", 4).alias("nominal"), F.round(S.fisher(F.col("nominal"), F.col("inflation")), 4).alias("real"), F.round("share", 4).alias("share"))


@query(f"""WITH {TOTALS}, q AS (SELECT o // 3 AS q, sum(v::DECIMAL(38,6))::DOUBLE AS v FROM tot GROUP BY 1 HAVING count(*) = 3), gq AS (SELECT t.g, t.o // 3 AS q, sum(t.v::DECIMAL(38,6))::DOUBLE AS v FROM t GROUP BY ALL HAVING count(*) = 3)
    SELECT 'all' AS g, a.q::INT AS q, round((a.v / b.v - 1) * 100, 4) AS v FROM q a JOIN q b ON a.q = b.q + 4 UNION ALL SELECT a.g, a.q::INT, round(100 * (a.v - b.v) / c.v, 4) FROM gq a JOIN gq b ON a.g = b.g AND a.q = b.q + 4 JOIN q c ON c.q = b.q""")
def growth_bundle(spark, sf):
    """Yearly growth by complete quarters, and what each group contributes to it."""
    quarter = F.floor(F.col("o") / 3).cast("int").alias("q")
    sums = _ord(spark, sf).groupBy("g", quarter).agg(P.exact_sum(F.col("v")).cast("double").alias("v"), F.count("*").alias("n")).where("n = 3")
    whole = _totals(spark, sf).groupBy(quarter).agg(P.exact_sum(F.col("v")).cast("double").alias("v"), F.count("*").alias("n")).where("n = 3")
    base = whole.select((F.col("q") + 4).alias("q"), F.col("v").alias("all0"))
    growth = whole.join(base, "q").select(F.lit("all").alias("g"), "q", F.round((F.col("v") / F.col("all0") - 1) * 100, 4).alias("v"))
    before = sums.select("g", (F.col("q") + 4).alias("q"), F.col("v").alias("v0"))
    parts = sums.join(before, ["g", "q"]).join(base, "q").select("g", "q", F.round(100 * (F.col("v") - F.col("v0")) / F.col("all0"), 4).alias("v"))
    return growth.unionByName(parts)


@query(f"""WITH p AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate) - 1)::INT AS o, CASE WHEN l_returnflag = 'R' THEN 'x' ELSE 'm' END AS side, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS q FROM lineitem GROUP BY ALL), w AS (SELECT o, max(v) FILTER (side = 'x') AS xv, max(v) FILTER (side = 'm') AS mv, max(q) FILTER (side = 'x') AS xq, max(q) FILTER (side = 'm') AS mq FROM p GROUP BY o)
    SELECT o, round(100 * xv / mv, 4) AS coverage, round(100 * (xv / xq) / (mv / mq), 4) AS terms FROM w WHERE xv IS NOT NULL AND mv IS NOT NULL""")
def trade_bundle(spark, sf):
    """Coverage of imports by exports, and the terms of trade (ratio of unit values)."""
    o = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("int")
    side = F.col("l_returnflag") == "R"
    part = lambda cond, c, name: F.sum(F.when(cond, money(c))).cast("double").alias(name)
    got = table(spark, sf, "lineitem", ["l_shipdate", "l_returnflag", "l_extendedprice", "l_quantity"]).groupBy(o.alias("o")).agg(part(side, "l_extendedprice", "xv"), part(~side, "l_extendedprice", "mv"), part(side, "l_quantity", "xq"), part(~side, "l_quantity", "mq")).where("xv is not null and mv is not null")
    return got.select("o", F.round(100 * F.col("xv") / F.col("mv"), 4).alias("coverage"), F.round(100 * (F.col("xv") / F.col("xq")) / (F.col("mv") / F.col("mq")), 4).alias("terms"))


@query(f"""WITH {WEEKLY}, s AS (SELECT g, d, v, (sum(v::DECIMAL(38,6)) OVER (PARTITION BY g ORDER BY d ROWS UNBOUNDED PRECEDING))::DOUBLE AS stock, (sum(v::DECIMAL(38,6)) OVER w4)::DOUBLE AS flow4, count(*) OVER w4 AS k FROM weekly WINDOW w4 AS (PARTITION BY g ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT g, d, round(v, 2) AS flow, round(stock, 2) AS stock, round(CASE WHEN k = 4 THEN flow4 END, 2) AS flow4 FROM s""")
def portfolio_bundle(spark, sf):
    """Weekly flows, the stock that they add up to, and sums of four weeks."""
    w = Window.partitionBy("g").orderBy("d")
    total = lambda over: F.sum(F.col("v").cast("decimal(38,6)")).over(over).cast("double")
    four = w.rowsBetween(-3, 0)
    return weekly_orders(spark, sf).select("g", "d", F.round("v", 2).alias("flow"), F.round(total(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("stock"), F.round(F.when(F.count("*").over(four) == 4, total(four)), 2).alias("flow4"))


@query(f"""WITH {MONTHLY}, {ORD}, l AS (SELECT max(o) AS o FROM t), b AS (SELECT a.g, a.v, m.v AS m1, y.v AS y12 FROM t a JOIN l USING (o) LEFT JOIN t m ON m.g = a.g AND m.o = a.o - 1 LEFT JOIN t y ON y.g = a.g AND y.o = a.o - 12)
    SELECT g, round((v / m1 - 1) * 100, 4) AS monthly, round(v, 2) AS now, round(y12, 2) AS year_before, row_number() OVER (ORDER BY v / m1 DESC, g) AS place FROM b""")
def month_bars(spark, sf):
    """The last month of every group against the month and the year before, in order."""
    at = _ord(spark, sf)
    back = lambda n: F.max("v").over(Window.partitionBy("g").orderBy("o").rangeBetween(-n, -n))
    last = at.agg(F.max("o").alias("o"))  # one row
    got = at.withColumn("m1", back(1)).withColumn("y12", back(12)).join(F.broadcast(last), "o")
    place = F.row_number().over(Window.orderBy((F.col("v") / F.col("m1")).desc(), "g"))  # one row per group
    return got.select("g", F.round((F.col("v") / F.col("m1") - 1) * 100, 4).alias("monthly"), F.round("v", 2).alias("now"), F.round("y12", 2).alias("year_before"), place.cast("bigint").alias("place"))


@query(f"""WITH {MONTHLY}, {ORD}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o DESC) AS k FROM t) SELECT g, round(arg_min(v, o), 2) AS first, round(arg_max(v, o), 2) AS last, round(min(v), 2) AS low, arg_min(o, (v, o)) AS low_at, round(max(v), 2) AS high, arg_max(o, (v, -o)) AS high_at FROM n WHERE k <= 12 GROUP BY g""")
def series_findings(spark, sf):
    """What a chart of the last twelve months says: first, last, extremes and where they stand."""
    got = B.finding(_ord(spark, sf), ["g"], "o", "v", 12)
    return got.select("g", *(F.round(c, 2).alias(c) for c in ("first", "last", "low", "high")), "low_at", "high_at")


@query(f"""WITH {SUPPLIER} SELECT g, o, round(greatest(stock, 0), 5) AS core, round(greatest(flow / 10 - stock, 0), 5) AS additional, round(greatest(qty * 1000 - flow / 10, 0), 5) AS second, round(CASE WHEN qty / 100 <= 1 THEN 0.0 WHEN stock < 100000 THEN (qty / 100 - 1) / 0.5 END, 4) AS runway FROM sq""")
def capital_stack(spark, sf):
    """Nested capital as layers floored at nothing, and the quarters that a falling ratio has until the floor."""
    layers = B.by_difference([F.col("stock"), F.col("flow") / 10, F.col("qty") * 1000], ["core", "additional", "second"])
    step = F.when(F.col("stock") < 100000, -0.5).otherwise(0.5)
    got = supplier_quarters(spark, sf).select("g", "o", *layers, B.runway(F.col("qty") / 100, step, 1.0).alias("runway"))
    return got.select("g", "o", *(F.round(c, 5).alias(c) for c in ("core", "additional", "second")), F.round("runway", 4).alias("runway"))


@query("""WITH t AS (SELECT n_name AS label, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::INT AS o, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL), k AS (SELECT label FROM t GROUP BY label ORDER BY sum(v::DECIMAL(38,6)) DESC, label LIMIT 5)
    SELECT o, CASE WHEN label IN (SELECT label FROM k) THEN label ELSE 'rest' END AS label, round(sum(v::DECIMAL(38,6))::DOUBLE / 1e6, 6) AS v FROM t GROUP BY ALL""")
def category_stack(spark, sf):
    """The five largest categories by quarter in millions, the others as the rest."""
    lines = table(spark, sf, "lineitem", ["l_suppkey", "l_shipdate", "l_extendedprice"]).groupBy("l_suppkey", (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int").alias("o")).agg(F.sum(money("l_extendedprice")).alias("v"))
    named = lines.join(table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"]), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(table(spark, sf, "nation", ["n_nationkey", "n_name"])), F.col("s_nationkey") == F.col("n_nationkey"))
    at = named.groupBy("o", F.col("n_name").alias("label")).agg(F.sum("v").cast("double").alias("v"))
    return B.top_and_rest(at, ["o"], "label", "v", 5).select("o", "label", r6(F.col("v") / 1e6, "v"))


@query(f"""WITH {WEEKLY}, r AS (SELECT a.g, a.d, a.v / b.v AS r FROM weekly a JOIN weekly b ON a.d = b.d AND b.g = 'P' AND a.g <> 'P' WHERE b.v > 0), l AS (SELECT g, max(d) AS d FROM r GROUP BY g),
    c AS (SELECT l.g, l.d, n.r AS now, b.r AS base, row_number() OVER (PARTITION BY l.g ORDER BY CASE date_diff('day', b.d, l.d) WHEN 364 THEN 0 WHEN 371 THEN 1 ELSE 2 END) AS k FROM l JOIN r n ON n.g = l.g AND n.d = l.d JOIN r b ON b.g = l.g AND date_diff('day', b.d, l.d) IN (364, 371, 357))
    SELECT g, d, round(now, 6) AS now, round(base, 6) AS base, round(now - base, 6) AS change FROM c WHERE k = 1""")
def segment_ratio_change(spark, sf):
    """A ratio by segment at its last date, and against a year before with a week's tolerance."""
    at = weekly_orders(spark, sf)
    base = at.where("g = 'P' and v > 0").select("d", F.col("v").alias("b"))
    ratios = at.where("g != 'P'").join(base, "d").select("g", "d", (F.col("v") / F.col("b")).alias("r"))
    got = _against_last(ratios)
    return got.select("g", "d", r6(F.col("r"), "now"), r6(F.col("base"), "base"), r6(F.col("r") - F.col("base"), "change"))


def _against_last(ratios):
    """The last ratio of each segment with its tolerant base."""
    last = ratios.groupBy("g").agg(F.max("d").alias("d"))
    return S.tolerant_base(ratios, ["g"], "d", "r", 364).join(last, ["g", "d"], "left_semi")


@query(f"""WITH {DAILY}, {RATES}, r AS (SELECT d, rate, lead(d) OVER (ORDER BY d) AS e FROM rates), a AS (SELECT d, v FROM daily WHERE g = 'F'), b AS (SELECT d, v FROM daily WHERE g = 'O'), c AS (SELECT d, v FROM daily WHERE g = 'P')
    SELECT a.d, round(a.v + b.v - c.v * rate, 2) AS buffer FROM a JOIN b USING (d) JOIN c USING (d) JOIN r ON a.d >= r.d AND (r.e IS NULL OR a.d < r.e)""")
def reserve_buffer(spark, sf):
    """Two stocks less a third at the rate that holds, on dates that all have."""
    steps = S.daily_steps(_rates(spark, sf), "d", "rate", _last_day(spark, sf))
    wide = daily_orders(spark, sf).groupBy("d").pivot("g", ["F", "O", "P"]).agg(F.first("v")).where("F is not null and O is not null and P is not null")
    return wide.join(F.broadcast(steps), "d").select("d", F.round(F.col("F") + F.col("O") - F.col("P") * F.col("rate"), 2).alias("buffer"))


@query(f"""WITH {RATES}, l AS (SELECT row_number() OVER (ORDER BY d) AS n, d, round(rate, 2) AS rate FROM rates), x AS (SELECT max(d) AS last, arg_max(rate, d) AS held FROM l)
    SELECT (SELECT held FROM x) AS rate, count(*) FILTER (d > coalesce((SELECT max(d) FROM l WHERE rate <> (SELECT held FROM x)), DATE '0001-01-01')) AS meetings, max(rate) - min(rate) AS corridor, max(d) AS last, date_diff('day', (SELECT max(o_orderdate)::DATE FROM orders), max(d))::INT AS runway FROM l""")
def policy_calendar(spark, sf):
    """The rate that holds, for how many meetings, the corridor of all rates, and the days that the calendar still covers."""
    at = _rates(spark, sf).withColumn("rate", F.round("rate", 2)).withColumn("k", F.lit(1))
    held = B.unchanged_tail(at, ["k"], "d", "rate")
    whole = at.groupBy("k").agg(F.max_by("rate", "d").alias("rate"), (F.max("rate") - F.min("rate")).alias("corridor"), F.max("d").alias("last"))
    return whole.join(held, "k").select("rate", F.col("held").alias("meetings"), "corridor", "last", F.datediff("last", F.lit(_last_day(spark, sf))).alias("runway"))


@query(f"""WITH {SUPPLIER}, n AS (SELECT o, s_nationkey AS k, flow, stock, qty FROM sq JOIN supplier ON s_suppkey = g), a AS (SELECT o, k, sum(flow::DECIMAL(38,6))::DOUBLE AS flow, sum(stock::DECIMAL(38,6))::DOUBLE AS stock, sum(qty::DECIMAL(38,6))::DOUBLE AS qty, count(*) AS n FROM n GROUP BY ALL)
    SELECT o, k, round(flow / qty, 7) AS ratio, round(CASE WHEN n >= 5 THEN stock / qty END, 7) AS coverage, n FROM a""")
def sector_ratios(spark, sf):
    """Ratios of sums by sector and quarter; coverage only where five members make it."""
    at = supplier_quarters(spark, sf).join(table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"]), F.col("g") == F.col("s_suppkey"))
    sums = at.groupBy("o", F.col("s_nationkey").alias("k")).agg(*(P.exact_sum(F.col(c)).cast("double").alias(c) for c in ("flow", "stock", "qty")), F.count("*").alias("n"))
    return sums.select("o", "k", F.round(F.col("flow") / F.col("qty"), 7).alias("ratio"), F.round(F.when(F.col("n") >= 5, F.col("stock") / F.col("qty")), 7).alias("coverage"), "n")


@query(f"""WITH {SUPPLIER}, l AS (SELECT g, max(o) AS o, count(*) AS periods FROM sq GROUP BY g) SELECT s_name AS entity, l.periods, (l.o // 4)::VARCHAR || 'Q' || (l.o % 4 + 1)::VARCHAR AS latest, round(coalesce(CASE WHEN g % 4 <> 0 THEN stock END, qty * 10), 2) AS core, round(flow, 2) AS flow FROM l JOIN sq USING (g, o) JOIN supplier ON s_suppkey = g""")
def entity_profile(spark, sf):
    """Each entity's periods, its last one, and that one's figures; core capital falls back to a formula where it isn't filed."""
    at = supplier_quarters(spark, sf)
    top = at.groupBy("g").agg(F.count("*").alias("periods"), F.max_by(F.struct("o", "stock", "qty", "flow"), "o").alias("x"))
    named = top.join(table(spark, sf, "supplier", ["s_suppkey", "s_name"]), F.col("g") == F.col("s_suppkey"))
    core = F.coalesce(F.when(F.col("g") % 4 != 0, F.col("x.stock")), F.col("x.qty") * 10)
    latest = F.concat((F.col("x.o") / 4).cast("int").cast("string"), F.lit("Q"), (F.col("x.o") % 4 + 1).cast("string"))
    return named.select(F.col("s_name").alias("entity"), "periods", latest.alias("latest"), F.round(core, 2).alias("core"), F.round("x.flow", 2).alias("flow"))


@query(f"""WITH {SUPPLIER}, b AS (SELECT o, CASE WHEN qty < 100 THEN 'short' WHEN qty < 300 THEN 'middle' ELSE 'long' END AS bucket, sum(flow::DECIMAL(38,6))::DOUBLE AS v FROM sq GROUP BY ALL), t AS (SELECT o, sum(v::DECIMAL(38,6))::DOUBLE AS v FROM b GROUP BY o) SELECT o, bucket, round(100 * b.v / t.v, 4) AS share FROM b JOIN t USING (o) WHERE t.v > 0""")
def bucket_shares(spark, sf):
    """Maturity buckets as shares of the whole."""
    bucket = F.when(F.col("qty") < 100, "short").when(F.col("qty") < 300, "middle").otherwise("long")
    sums = supplier_quarters(spark, sf).groupBy("o", bucket.alias("bucket")).agg(P.exact_sum(F.col("flow")).cast("double").alias("v"))
    total = P.exact_sum(F.col("v")).over(Window.partitionBy("o")).cast("double")
    return sums.withColumn("t", total).where("t > 0").select("o", "bucket", F.round(100 * F.col("v") / F.col("t"), 4).alias("share"))


@query("""WITH c AS (SELECT c_custkey AS g, (c_acctbal > 0)::INT AS a, (c_mktsegment IN ('BUILDING', 'MACHINERY'))::INT AS b, (c_nationkey % 2 = 0)::INT AS d FROM customer) SELECT g, a + b + d AS shelf, round((a + b + d) / 3, 6) AS coverage, a * 4 + b * 2 + d AS pattern FROM c""")
def product_scores(spark, sf):
    """How many products an entity's attributes name, as a share of the shelf."""
    c = table(spark, sf, "customer", ["c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey"])
    cells = [F.col("c_acctbal") > 0, F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_nationkey") % 2 == 0]
    a, b, d = (x.cast("int") for x in cells)
    return c.select(F.col("c_custkey").alias("g"), (a + b + d).alias("shelf"), r6((a + b + d) / 3, "coverage"), (a * 4 + b * 2 + d).alias("pattern"))


LABELS = [(1, "^(red|blue|green)"), (2, "^(old|new)"), (3, "^(hot|cold)"), (4, "(ring|bolt)$")]


@query("""WITH t AS (SELECT p_brand AS g, p_partkey AS k, p_retailprice AS v, CASE WHEN regexp_matches(p_name, '^(red|blue|green)') THEN 1 WHEN regexp_matches(p_name, '^(old|new)') THEN 2 WHEN regexp_matches(p_name, '^(hot|cold)') THEN 3 WHEN regexp_matches(p_name, '(ring|bolt)$') THEN 4 END AS line FROM part)
    SELECT g, arg_min(v, k) FILTER (line = 1) AS l1, arg_min(v, k) FILTER (line = 2) AS l2, arg_min(v, k) FILTER (line = 3) AS l3, arg_min(v, k) FILTER (line = 4) AS l4, count(*) FILTER (line IS NULL) AS unplaced FROM t GROUP BY g""")
def label_template(spark, sf):
    """A template whose lines are found by label, first match first; and the rows that no line takes."""
    line = F.lit(None).cast("int")
    for number, pattern in reversed(LABELS):
        line = F.when(F.col("p_name").rlike(pattern), number).otherwise(line)
    at = table(spark, sf, "part", ["p_brand", "p_partkey", "p_name", "p_retailprice"]).withColumn("line", line)
    cell = lambda n: F.min_by("p_retailprice", F.when(F.col("line") == n, F.col("p_partkey"))).alias(f"l{n}")
    return at.groupBy(F.col("p_brand").alias("g")).agg(*(cell(n) for n, _ in LABELS), F.count_if(F.col("line").isNull()).alias("unplaced"))


@query(f"""WITH {MONTHLY}, {ORD}, g AS (SELECT a.g, a.o, (a.v / b.v - 1) * 100 AS y FROM t a JOIN t b ON a.g = b.g AND a.o = b.o + 12), l AS (SELECT g, arg_max(y, o) AS y, max(o) AS o FROM g GROUP BY g), h AS (SELECT g.g, count(*) FILTER (g.y < l.y) AS below, count(*) AS n FROM g JOIN l USING (g) GROUP BY g.g)
    SELECT g, round(y, 4) AS growth, CASE WHEN y >= 10 THEN 'grows fast' WHEN y >= 0 THEN 'grows' WHEN y > -10 THEN 'shrinks' ELSE 'shrinks fast' END AS headline, round(below / n, 4) AS place FROM l JOIN h USING (g)""")
def headlines(spark, sf):
    """A headline for each group by rules on its last growth, and where that stands among all before."""
    growth = S.year_ago(monthly_orders(spark, sf), ["g", "m"], "y", "v").select("g", (F.col("y") * 12 + F.col("m") - 1).alias("o"), ((F.col("v") / F.col("base") - 1) * 100).alias("r"))
    last = growth.groupBy("g").agg(F.max_by("r", "o").alias("last"))
    got = growth.join(last, "g").groupBy("g", "last").agg(F.count_if(F.col("r") < F.col("last")).alias("below"), F.count("*").alias("n"))
    y = F.col("last")
    return got.select("g", F.round(y, 4).alias("growth"), F.when(y >= 10, "grows fast").when(y >= 0, "grows").when(y > -10, "shrinks").otherwise("shrinks fast").alias("headline"), F.round(F.col("below") / F.col("n"), 4).alias("place"))


@query(f"""WITH {SUPPLIER}, r AS (SELECT g, o, stock FROM sq), c AS (SELECT s_suppkey AS g, s_nationkey AS k FROM supplier), q AS (SELECT k, o, avg(stock) AS mean FROM r JOIN c USING (g) GROUP BY ALL)
    SELECT r.g, r.o, round(r.stock, 2) AS own, round(q.mean, 4) AS peers, round(c2.inflation, 4) AS inflation FROM r JOIN c USING (g) JOIN q ON q.k = c.k AND q.o = r.o LEFT JOIN (SELECT a.o, 100 * (a.p - b.p) / b.p AS inflation FROM (SELECT o, sum(flow::DECIMAL(38,6))::DOUBLE / sum(qty::DECIMAL(38,6))::DOUBLE AS p FROM sq GROUP BY o) a JOIN (SELECT o, sum(flow::DECIMAL(38,6))::DOUBLE / sum(qty::DECIMAL(38,6))::DOUBLE AS p FROM sq GROUP BY o) b ON a.o = b.o + 4) c2 ON c2.o = r.o""")
def analyst_bundle(spark, sf):
    """What an analyst reads of an entity's quarter: its own figure, its peers' mean, and inflation of that quarter."""
    at = supplier_quarters(spark, sf)
    level = at.groupBy("o").agg((P.exact_sum(F.col("flow")).cast("double") / P.exact_sum(F.col("qty")).cast("double")).alias("v"))
    inflation = _months_back(level, 4).select("o", (100 * (F.col("v") - F.col("base")) / F.col("base")).alias("inflation"))
    rows = at.join(table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"]), F.col("g") == F.col("s_suppkey")).select("g", "o", F.col("s_nationkey").alias("k"), "stock")
    peers = rows.groupBy("k", "o").agg((P.exact_sum(F.col("stock")).cast("double") / F.count("*")).alias("mean"))
    return rows.join(peers, ["k", "o"]).join(inflation, "o", "left").select("g", "o", F.round("stock", 2).alias("own"), F.round("mean", 4).alias("peers"), F.round("inflation", 4).alias("inflation"))
