"""Growth, accumulation, joins in time, streaks and steps over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import series as S
from ..sources.tables import daily_orders, money, monthly_orders, supplier_quarters, table, weekly_orders
from .registry import DAILY, MONTHLY, SUPPLIER, WEEKLY, query


def r6(c, name):
    return F.round(c, 6).alias(name)


@query(f"""WITH {MONTHLY} SELECT a.y, a.m, a.g, round(CASE WHEN b.v > 0 THEN 100 * (a.v - b.v) / b.v END, 6) AS growth
    FROM monthly a JOIN monthly b ON a.g = b.g AND a.m = b.m AND a.y = b.y + 1""")
def yoy_self_join(spark, sf):
    got = S.year_ago(monthly_orders(spark, sf), ["g", "m"], "y", "v")
    return got.select("y", "m", "g", r6(S.safe_div(100 * (F.col("v") - F.col("base")), F.col("base")), "growth"))


@query(f"""WITH {WEEKLY}, t AS (SELECT a.g, a.d, a.v, b.v AS base, date_diff('day', b.d, a.d) AS e,
      row_number() OVER (PARTITION BY a.g, a.d ORDER BY CASE date_diff('day', b.d, a.d) WHEN 364 THEN 0 WHEN 371 THEN 1 ELSE 2 END) AS r
      FROM weekly a JOIN weekly b ON a.g = b.g AND date_diff('day', b.d, a.d) IN (364, 371, 357))
    SELECT g, d, round((pow(v / base, 364 / e) - 1) * 100, 4) AS growth FROM t WHERE r = 1 AND base > 0""")
def tolerant_growth(spark, sf):
    return S.tolerant_growth(weekly_orders(spark, sf), ["g"], "d", "v").select("g", "d", F.round("growth", 4).alias("growth"))


@query(f"""WITH {WEEKLY}, holes AS (SELECT * FROM weekly WHERE NOT (g = 'F' AND d BETWEEN DATE '1996-02-26' AND DATE '1996-05-20')),
    t AS (SELECT a.g, a.d, a.v, b.v AS base, date_diff('day', b.d, a.d) AS e,
      row_number() OVER (PARTITION BY a.g, a.d ORDER BY CASE date_diff('day', b.d, a.d) WHEN 91 THEN 0 WHEN 98 THEN 1 ELSE 2 END) AS r
      FROM holes a JOIN holes b ON a.g = b.g AND date_diff('day', b.d, a.d) IN (91, 98, 84))
    SELECT g, d, round((pow(v / base, 364 / e) - 1) * 100, 2) AS growth FROM t WHERE r = 1 AND base > 0""")
def tolerant_growth_with_gap(spark, sf):
    hole = (F.col("g") == "F") & F.col("d").between("1996-02-26", "1996-05-20")
    return S.tolerant_growth(weekly_orders(spark, sf).where(~hole), ["g"], "d", "v", 13).select("g", "d", F.round("growth", 2).alias("growth"))


@query(f"""WITH {MONTHLY}, t AS (SELECT *, y * 12 + m - 1 AS o, lag(v, 12) OVER (PARTITION BY g ORDER BY y, m) AS base FROM monthly)
    SELECT g, o::INT AS o, round((v / base - 1) * 100, 6) AS growth FROM t WHERE base > 0""")
def lag_growth(spark, sf):
    at = monthly_orders(spark, sf).withColumn("o", (F.col("y") * 12 + F.col("m") - 1).cast("int"))
    return S.lag_growth(at, ["g"], "o", "v", 12).select("g", "o", r6(F.col("growth"), "growth"))


YTD = f"""{SUPPLIER}, ytd AS (SELECT g, o, stock, sum(flow::DECIMAL(38,6)) OVER (PARTITION BY g, o // 4 ORDER BY o)::DOUBLE AS ytd FROM sq),
    single AS (SELECT *, CASE WHEN o % 4 = 0 THEN ytd WHEN lag(o) OVER w = o - 1 THEN ytd - lag(ytd) OVER w END AS single FROM ytd WINDOW w AS (PARTITION BY g ORDER BY o)),
    ttm AS (SELECT *, CASE WHEN count(single) OVER w4 = 4 THEN (sum(single::DECIMAL(38,6)) OVER w4)::DOUBLE END AS ttm,
      CASE WHEN count(CASE WHEN stock > 0 THEN stock END) OVER w5 >= 2 THEN (sum(CASE WHEN stock > 0 THEN stock END::DECIMAL(38,6)) OVER w5)::DOUBLE / count(CASE WHEN stock > 0 THEN stock END) OVER w5 END AS average
      FROM single WINDOW w4 AS (PARTITION BY g ORDER BY o RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY g ORDER BY o RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def _ytd(spark, sf):
    year = (F.col("o") / 4).cast("int")
    w = Window.partitionBy("g", year).orderBy("o")
    at = supplier_quarters(spark, sf).repartition("g")  # one shuffle serves all windows of an entity
    return at.withColumn("ytd", F.sum(F.col("flow").cast("decimal(38,6)")).over(w).cast("double"))


def _panel(spark, sf):
    got = S.trailing_sum(S.decumulate(_ytd(spark, sf), ["g"], "o", "ytd"), ["g"], "o", "single")
    return S.average_stock(got, ["g"], "o", "stock")


@query(f"WITH {YTD} SELECT g, o, round(ytd, 2) AS ytd, round(single, 2) AS single, round(ttm, 2) AS ttm FROM ttm")
def decumulate_ttm(spark, sf):
    return _panel(spark, sf).select("g", "o", *(F.round(c, 2).alias(c) for c in ("ytd", "single", "ttm")))


@query(f"WITH {YTD} SELECT g, o, round(average, 4) AS average FROM ttm")
def trailing_avg_stock(spark, sf):
    return _panel(spark, sf).select("g", "o", F.round("average", 4).alias("average"))


@query(f"""WITH {YTD} SELECT concat((t.o // 4)::VARCHAR, 'Q', (t.o % 4 + 1)::VARCHAR) AS period, s_name AS entity, n_name AS class,
      round(single, 2) AS flow, round(ttm, 2) AS ttm, round(average, 4) AS stock, round(CASE WHEN average > 0 THEN ttm / average END, 6) AS turnover,
      round(CASE WHEN ttm4 <> 0 THEN (ttm - ttm4) * 100 / abs(ttm4) END, 6) AS ttm_growth
    FROM ttm t JOIN supplier ON s_suppkey = t.g JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT g AS g4, o + 4 AS o4, ttm AS ttm4 FROM ttm) lag4 ON g4 = t.g AND o4 = t.o""")
def bank_period_panel(spark, sf):
    """Entity by period: single-quarter and trailing flows over average stocks, and growth against a year ago."""
    year_ago = F.max("ttm").over(Window.partitionBy("g").orderBy("o").rangeBetween(-4, -4))
    at = _panel(spark, sf).withColumn("before", year_ago)
    names = table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_nationkey"]).join(F.broadcast(table(spark, sf, "nation", ["n_nationkey", "n_name"])), F.col("s_nationkey") == F.col("n_nationkey"))
    got = at.join(names, F.col("g") == F.col("s_suppkey"))
    period = F.concat((F.col("o") / 4).cast("int").cast("string"), F.lit("Q"), (F.col("o") % 4 + 1).cast("string"))
    return got.select(period.alias("period"), F.col("s_name").alias("entity"), F.col("n_name").alias("class"), F.round("single", 2).alias("flow"), F.round("ttm", 2).alias("ttm"), F.round("average", 4).alias("stock"), r6(S.safe_div(F.col("ttm"), F.col("average")), "turnover"), r6(S.magnitude_growth(F.col("ttm"), F.col("before")), "ttm_growth"))


@query(f"""WITH {MONTHLY}, t AS (SELECT g, (y * 12 + m - 1)::INT AS o, v FROM monthly)
    SELECT g, o, round((sum(v::DECIMAL(38,6)) OVER w12)::DOUBLE, 2) AS sum12, round((sum(v::DECIMAL(38,6)) OVER w12)::DOUBLE / 12, 4) AS mean12 FROM t
    WINDOW w12 AS (PARTITION BY g ORDER BY o ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) QUALIFY count(v) OVER w12 = 12""")
def rolling_windows(spark, sf):
    at = monthly_orders(spark, sf).select("g", (F.col("y") * 12 + F.col("m") - 1).cast("int").alias("o"), "v")
    sums = S.rolling(at, ["g"], "o", "v", 12, "sum", "sum12")
    return sums.withColumn("mean12", F.col("sum12") / 12).select("g", "o", F.round("sum12", 2).alias("sum12"), F.round("mean12", 4).alias("mean12"))


@query(f"""WITH {MONTHLY}, t AS (SELECT g, (y * 12 + m - 1)::INT AS o, v FROM monthly WHERE NOT (g = 'BUILDING' AND y = 1997 AND m = 5))
    SELECT g, o, round((sum(v::DECIMAL(38,6)) OVER w)::DOUBLE, 2) AS sum3 FROM t WINDOW w AS (PARTITION BY g ORDER BY o RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) QUALIFY count(v) OVER w = 3""")
def complete_3m_window(spark, sf):
    at = monthly_orders(spark, sf).where("not (g = 'BUILDING' and y = 1997 and m = 5)").select("g", (F.col("y") * 12 + F.col("m") - 1).cast("int").alias("o"), "v")
    return S.rolling(at, ["g"], "o", "v", 3, "sum", "sum3", contiguous=True).select("g", "o", F.round("sum3", 2).alias("sum3"))


@query(f"""WITH {MONTHLY}, a AS (SELECT a.g, a.y, a.m, CASE WHEN b.v > 0 THEN 100 * (a.v - b.v) / b.v END AS nominal FROM monthly a JOIN monthly b ON a.g = b.g AND a.m = b.m AND a.y = b.y + 1),
    p AS (SELECT year(l_shipdate)::INT AS y, month(l_shipdate)::INT AS m, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS p FROM lineitem WHERE NOT (year(l_shipdate) = 1998 AND month(l_shipdate) = 3) GROUP BY ALL),
    i AS (SELECT a.y, a.m, 100 * (a.p - b.p) / b.p AS inflation FROM p a JOIN p b ON a.m = b.m AND a.y = b.y + 1)
    SELECT g, y, m, round(nominal, 4) AS nominal, round(CASE WHEN inflation > -100 THEN ((1 + nominal / 100) / (1 + inflation / 100) - 1) * 100 END, 4) AS real FROM a JOIN i USING (y, m)""")
def real_terms(spark, sf):
    at = S.year_ago(monthly_orders(spark, sf), ["g", "m"], "y", "v")
    at = at.select("g", "y", "m", S.safe_div(100 * (F.col("v") - F.col("base")), F.col("base")).alias("nominal"))
    lines = table(spark, sf, "lineitem", ["l_shipdate", "l_extendedprice", "l_quantity"]).where(~((F.year("l_shipdate") == 1998) & (F.month("l_shipdate") == 3)))
    level = lines.groupBy(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg((F.sum(money("l_extendedprice")).cast("double") / F.sum(money("l_quantity")).cast("double")).alias("p"))
    prices = S.year_ago(level, ["m"], "y", "p").select("y", "m", (100 * (F.col("p") - F.col("base")) / F.col("base")).alias("inflation"))
    return at.join(prices, ["y", "m"]).select("g", "y", "m", F.round("nominal", 4).alias("nominal"), F.round(S.fisher(F.col("nominal"), F.col("inflation")), 4).alias("real"))


RATES = "rates AS (SELECT date_trunc('month', l_shipdate)::DATE AS d, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE / 1000 AS rate FROM lineitem WHERE month(l_shipdate) % 2 = 0 GROUP BY ALL)"


def _rates(spark, sf):
    """A price level that changes every second month."""
    lines = table(spark, sf, "lineitem", ["l_shipdate", "l_extendedprice", "l_quantity"]).where(F.month("l_shipdate") % 2 == 0)
    return lines.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("d")).agg((F.sum(money("l_extendedprice")).cast("double") / F.sum(money("l_quantity")).cast("double") / 1000).alias("rate"))


def _last_day(spark, sf):
    """The last day of any order; the calendar of days up to it is small at any number of orders."""
    return table(spark, sf, "orders", ["o_orderdate"]).agg(F.to_date(F.max("o_orderdate"))).first()[0]


@query(f"""WITH {RATES}, r AS (SELECT d, rate, lead(d) OVER (ORDER BY d) AS e FROM rates)
    SELECT o_orderkey, round(rate, 6) AS rate, round(CASE WHEN rate > 0 THEN o_totalprice / rate END, 6) AS converted
    FROM orders LEFT JOIN r ON o_orderdate::DATE >= r.d AND (r.e IS NULL OR o_orderdate::DATE < r.e)""")
def asof_rate(spark, sf):
    """Orders at the last rate on or before their day: steps become days, so the join is by equality."""
    orders = table(spark, sf, "orders", ["o_orderkey", "o_orderdate", "o_totalprice"]).withColumn("d", F.to_date("o_orderdate"))
    steps = S.daily_steps(_rates(spark, sf), "d", "rate", _last_day(spark, sf))
    return orders.join(F.broadcast(steps), "d", "left").select("o_orderkey", r6(F.col("rate"), "rate"), r6(S.safe_div(F.col("o_totalprice"), F.col("rate")), "converted"))


@query(f"""WITH {DAILY}, l AS (SELECT DISTINCT o_orderstatus AS g, o_orderdate::DATE AS d FROM orders),
    j AS (SELECT l.g, l.d, max(k.d) AS at FROM l LEFT JOIN (SELECT * FROM daily WHERE v > 400000) k ON k.g = l.g AND k.d <= l.d GROUP BY ALL)
    SELECT j.g, j.d, CASE WHEN date_diff('day', j.at, j.d) <= 12 THEN round(daily.v, 2) END AS v FROM j LEFT JOIN daily ON daily.g = j.g AND daily.d = j.at""")
def asof_bounded(spark, sf):
    left = table(spark, sf, "orders", ["o_orderstatus", "o_orderdate"]).select(F.col("o_orderstatus").alias("g"), F.to_date("o_orderdate").alias("d")).distinct()
    return S.asof(left, daily_orders(spark, sf).where("v > 400000"), ["g"], "d", "v", 12).select("g", "d", F.round("v", 2).alias("v"))


@query(f"""WITH {DAILY} SELECT a.d, round(a.v - b.v, 2) AS diff, round(CASE WHEN b.v > 0 THEN a.v / b.v END, 6) AS ratio FROM daily a JOIN daily b ON a.d = b.d AND a.g = 'F' AND b.g = 'O'""")
def series_inner_combine(spark, sf):
    at = daily_orders(spark, sf)
    both = at.groupBy("d").pivot("g", ["F", "O"]).agg(F.first("v")).where("F is not null and O is not null")
    return both.select("d", F.round(F.col("F") - F.col("O"), 2).alias("diff"), r6(S.safe_div(F.col("F"), F.col("O")), "ratio"))


@query(f"""WITH {DAILY} SELECT d, round(max(v) FILTER (g = 'F'), 2) AS F, round(max(v) FILTER (g = 'O'), 2) AS O, round(max(v) FILTER (g = 'P'), 2) AS P FROM daily GROUP BY d""")
def series_outer_csv(spark, sf):
    """One column per series over all dates that any has."""
    return daily_orders(spark, sf).groupBy("d").pivot("g", ["F", "O", "P"]).agg(F.round(F.first("v"), 2))


@query(f"""WITH {MONTHLY}, t AS (SELECT g, (y * 12 + m - 1)::INT AS o, v, v > lag(v) OVER (PARTITION BY g ORDER BY y, m) AS up, v > 1000000 AS big FROM monthly),
    n AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER w AS e1, sum(CASE WHEN big THEN 0 ELSE 1 END) OVER w AS e2 FROM t WINDOW w AS (PARTITION BY g ORDER BY o DESC))
    SELECT g, count(*) FILTER (e1 = 0) AS rising, count(*) FILTER (e2 = 0) AS above FROM n GROUP BY g""")
def streaks(spark, sf):
    at = S.with_change(monthly_orders(spark, sf).select("g", (F.col("y") * 12 + F.col("m") - 1).cast("int").alias("o"), "v"), ["g"], "o", "v")
    rising = S.tail_run(at, ["g"], "o", F.col("change") > 0, "rising")
    return rising.join(S.tail_run(at, ["g"], "o", F.col("v") > 1000000, "above"), "g")


@query(f"""WITH {MONTHLY}, t AS (SELECT g, (y * 12 + m - 1)::INT AS o, v, row_number() OVER (PARTITION BY g ORDER BY y DESC, m DESC) AS n FROM monthly),
    c AS (SELECT *, v - lag(v) OVER (PARTITION BY g ORDER BY o) AS ch FROM t WHERE n <= 13),
    s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(ch) DESC, o) AS k FROM c WHERE ch IS NOT NULL),
    a AS (SELECT g, sum(abs(ch)::DECIMAL(38,6))::DOUBLE AS total, count(*) AS n FROM s GROUP BY g),
    e AS (SELECT g, arg_max(v, o) - arg_min(v, o) AS every FROM c GROUP BY g)
    SELECT g, s.o AS at, round(ch, 2) AS step, round(every - ch, 2) AS rest, coalesce(abs(ch) > 3 * (total - abs(ch)) / (a.n - 1), false) AS breaks FROM s JOIN a USING (g) JOIN e USING (g) WHERE k = 1""")
def step_break(spark, sf):
    at = monthly_orders(spark, sf).select("g", (F.col("y") * 12 + F.col("m") - 1).cast("int").alias("o"), "v")
    return S.largest_step(at, ["g"], "o", "v").select("g", "at", F.round("step", 2).alias("step"), F.round("rest", 2).alias("rest"), "breaks")


@query(f"""WITH {MONTHLY}, t AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY y DESC, m DESC) AS n FROM monthly)
    SELECT g, round(max(v), 2) AS top, arg_max(y * 100 + m, v)::INT AS top_at, round(min(v), 2) AS low, arg_min(y * 100 + m, v)::INT AS low_at FROM t WHERE n <= 24 GROUP BY g""")
def extremes(spark, sf):
    w = Window.partitionBy("g").orderBy(F.col("y").desc(), F.col("m").desc())
    at = monthly_orders(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 24").withColumn("at", F.col("y") * 100 + F.col("m"))
    return at.groupBy("g").agg(F.round(F.max("v"), 2).alias("top"), F.max_by("at", "v").alias("top_at"), F.round(F.min("v"), 2).alias("low"), F.min_by("at", "v").alias("low_at"))


@query(f"""WITH {MONTHLY}, a AS (SELECT a.y, a.m, a.g, a.v, b.v AS base FROM monthly a JOIN monthly b ON a.g = b.g AND a.m = b.m AND a.y = b.y + 1),
    t AS (SELECT y, m, sum(base::DECIMAL(38,6))::DOUBLE AS base, sum(v::DECIMAL(38,6))::DOUBLE AS v FROM a GROUP BY ALL)
    SELECT y, m, g, round(100 * (a.v - a.base) / t.base, 6) AS contribution, round(CASE WHEN t.v <> t.base THEN (a.v - a.base) / (t.v - t.base) END, 4) AS part FROM a JOIN t USING (y, m) WHERE t.base > 0""")
def contribution(spark, sf):
    at = S.year_ago(monthly_orders(spark, sf), ["g", "m"], "y", "v")
    total = at.groupBy("y", "m").agg(P.exact_sum(F.col("base")).cast("double").alias("b"), P.exact_sum(F.col("v")).cast("double").alias("t")).where("b > 0")
    change = F.col("v") - F.col("base")
    return at.join(total, ["y", "m"]).select("y", "m", "g", r6(100 * change / F.col("b"), "contribution"), F.round(F.when(F.col("t") != F.col("b"), change / (F.col("t") - F.col("b"))), 4).alias("part"))


@query(f"""WITH {MONTHLY}, a AS (SELECT a.y, a.m, a.g, a.v / b.v - 1 AS r, a.v, b.v AS base FROM monthly a JOIN monthly b ON a.g = b.g AND a.m = b.m AND a.y = b.y + 1),
    h AS (SELECT y, m, sum(v::DECIMAL(38,6))::DOUBLE / sum(base::DECIMAL(38,6))::DOUBLE - 1 AS r FROM a GROUP BY ALL)
    SELECT y, m, count(*) AS n, round((count(*) FILTER (a.r > h.r)) / count(*), 6) AS diffusion FROM a JOIN h USING (y, m) GROUP BY y, m HAVING count(*) = 5""")
def diffusion(spark, sf):
    """Share of groups that grow faster than the whole, in months where all are there."""
    at = S.year_ago(monthly_orders(spark, sf), ["g", "m"], "y", "v").withColumn("r", F.col("v") / F.col("base") - 1)
    head = at.groupBy("y", "m").agg((P.exact_sum(F.col("v")).cast("double") / P.exact_sum(F.col("base")).cast("double") - 1).alias("h"))
    got = at.join(head, ["y", "m"]).groupBy("y", "m").agg(F.count("*").alias("n"), F.sum((F.col("r") > F.col("h")).cast("int")).alias("k"))
    return got.where("n = 5").select("y", "m", "n", r6(F.col("k") / F.col("n"), "diffusion"))


@query(f"""WITH {RATES}, {DAILY}, r AS (SELECT d, rate, lead(d) OVER (ORDER BY d) AS e FROM rates), x AS (SELECT g, daily.d, v, rate FROM daily JOIN r ON daily.d >= r.d AND (r.e IS NULL OR daily.d < r.e)),
    tl AS (SELECT d, v FROM x WHERE g = 'O'), fx AS (SELECT d, v, rate FROM x WHERE g = 'F'),
    now AS (SELECT tl.d, tl.v AS tl, fx.v AS fx, fx.rate FROM tl JOIN fx USING (d))
    SELECT a.d, round(((a.tl + a.fx / a.rate * b.rate) / (b.tl + b.fx) - 1) * 100, 4) AS adjusted, round(((a.tl + a.fx) / (b.tl + b.fx) - 1) * 100, 4) AS nominal FROM now a JOIN now b ON a.d = b.d + 364""")
def fx_adjusted(spark, sf):
    """Growth with the foreign leg restated at the base date's rate."""
    steps = S.daily_steps(_rates(spark, sf), "d", "rate", _last_day(spark, sf))
    at = daily_orders(spark, sf).join(F.broadcast(steps), "d")
    now = at.where("g = 'O'").select("d", F.col("v").alias("tl")).join(at.where("g = 'F'").select("d", F.col("v").alias("fx"), "rate"), "d")
    base = now.select(F.date_add("d", 364).alias("d"), F.col("tl").alias("tl0"), F.col("fx").alias("fx0"), F.col("rate").alias("rate0"))
    both = F.col("tl0") + F.col("fx0")
    return now.join(base, "d").select("d", F.round(((F.col("tl") + F.col("fx") / F.col("rate") * F.col("rate0")) / both - 1) * 100, 4).alias("adjusted"), F.round(((F.col("tl") + F.col("fx")) / both - 1) * 100, 4).alias("nominal"))


@query(f"""WITH {MONTHLY}, t AS (SELECT y, m, sum(v::DECIMAL(38,6))::DOUBLE AS v FROM monthly GROUP BY ALL)
    SELECT a.y, a.m, round(a.v, 2) AS now, round(a.v / d.v, 6) AS since_december, round(100 * a.v / f.v, 6) AS indexed FROM t a JOIN t d ON d.y = a.y - 1 AND d.m = 12 CROSS JOIN (SELECT arg_min(v, y * 12 + m) AS v FROM t) f""")
def since_december(spark, sf):
    at = monthly_orders(spark, sf).groupBy("y", "m").agg(P.exact_sum(F.col("v")).cast("double").alias("v"))
    december = at.where("m = 12").select((F.col("y") + 1).alias("y"), F.col("v").alias("dec"))
    first = at.agg(F.min_by("v", F.col("y") * 12 + F.col("m")).alias("first"))  # one row
    return at.join(december, "y").crossJoin(first).select("y", "m", F.round("v", 2).alias("now"), r6(F.col("v") / F.col("dec"), "since_december"), r6(100 * F.col("v") / F.col("first"), "indexed"))


@query(f"""WITH {DAILY}, t AS (SELECT g, d, v, lag(round(v / 100000)) OVER w AS before, round(v / 100000) AS level FROM daily WINDOW w AS (PARTITION BY g ORDER BY d))
    SELECT g, d, level FROM t WHERE before IS NULL OR before <> level""")
def changes_only(spark, sf):
    at = daily_orders(spark, sf).withColumn("level", F.round(F.col("v") / 100000))
    w = Window.partitionBy("g").orderBy("d")
    return at.withColumn("before", F.lag("level").over(w)).where("before is null or before != level").select("g", "d", "level")
