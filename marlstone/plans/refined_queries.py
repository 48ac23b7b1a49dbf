"""Ranges back from the last day, rates inside ratios, mixes, counts by kind, runs with gaps, fundamentals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series as S
from ..operators.panel import exact_sum, latest
from ..sources.tables import daily_orders, money, monthly_orders, supplier_quarters, table
from .registry import DAILY, MONTHLY, SUPPLIER, query

RANGES = {"1Y": 12, "3Y": 36, "5Y": 60}


def r4(c, name):
    return F.round(c, 4).alias(name)


@query("""WITH l AS (SELECT max(o_orderdate)::DATE AS last FROM orders), b(name, start) AS (SELECT '1Y', last - INTERVAL 12 MONTH FROM l UNION ALL SELECT '3Y', last - INTERVAL 36 MONTH FROM l UNION ALL SELECT '5Y', last - INTERVAL 60 MONTH FROM l UNION ALL SELECT 'YTD', date_trunc('year', last)::TIMESTAMP FROM l UNION ALL SELECT 'All', NULL FROM l)
    SELECT name, start::DATE AS start, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM b JOIN orders ON start IS NULL OR o_orderdate::DATE >= start::DATE GROUP BY ALL""")
def range_totals(spark, sf):
    """Orders within each range back from the last day, in one pass."""
    orders = table(spark, sf, "orders", ["o_orderdate", "o_totalprice"]).withColumn("d", F.to_date("o_orderdate"))
    last = orders.agg(F.max("d").alias("last"))  # one row
    starts = {**{name: F.add_months("last", -m) for name, m in RANGES.items()}, "YTD": F.to_date(F.date_trunc("year", "last")), "All": F.lit(None).cast("date")}
    at = orders.crossJoin(F.broadcast(last))
    inside = {name: s.isNull() | (F.col("d") >= s) for name, s in starts.items()}
    one = at.agg(F.max("last").alias("last"), *(x for name, c in inside.items() for x in (F.count_if(c).alias(f"n_{name}"), F.sum(F.when(c, money("o_totalprice"))).cast("double").alias(f"t_{name}"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("name"), s.alias("start"), F.col(f"n_{name}").alias("n"), F.col(f"t_{name}").alias("total")) for name, s in starts.items()))))


@query(f"""WITH {DAILY}, k AS (SELECT d, v FROM daily WHERE g = 'P' AND v > 100000), j AS (SELECT a.g, a.d, a.v, (SELECT max(d) FROM k WHERE k.d <= a.d) AS at FROM daily a WHERE a.g <> 'P'), x AS (SELECT j.g, date_trunc('month', j.d)::DATE AS m, j.v, k.v AS w FROM j JOIN k ON k.d = j.at)
    SELECT g, m, round(100 * sum(v::DECIMAL(38,6))::DOUBLE / sum(w::DECIMAL(38,6))::DOUBLE, 4) AS ratio, count(*) AS n FROM x GROUP BY ALL""")
def asof_ratio(spark, sf):
    """Ratio of monthly sums whose denominator is the last rate known on each day; days before the first rate don't count."""
    at = daily_orders(spark, sf)
    rates = at.where("g = 'P' and v > 100000").select(F.lit("r").alias("k"), "d", F.col("v").alias("w"))
    left = at.where("g != 'P'").select("g", "v", F.lit("r").alias("k"), "d")
    got = S.asof(left, rates, ["k"], "d", "w").where("w is not null")
    return got.groupBy("g", F.to_date(F.date_trunc("month", "d")).alias("m")).agg(r4(100 * exact_sum(F.col("v")).cast("double") / exact_sum(F.col("w")).cast("double"), "ratio"), F.count("*").alias("n"))


@query(f"""WITH {SUPPLIER}, s AS (SELECT o, g, flow, row_number() OVER (PARTITION BY o ORDER BY flow DESC, g) AS k, sum(flow::DECIMAL(38,6)) OVER (PARTITION BY o) AS t FROM sq)
    SELECT o, CASE WHEN k <= 15 THEN g::VARCHAR ELSE 'other' END AS label, round(100 * sum(flow::DECIMAL(38,6))::DOUBLE / any_value(t)::DOUBLE, 4) AS share, count(*) AS members FROM s GROUP BY ALL""")
def weighted_mix(spark, sf):
    """The fifteen largest of each quarter by share, the rest as one with the number of its members."""
    at = supplier_quarters(spark, sf)
    k = F.row_number().over(Window.partitionBy("o").orderBy(F.desc("flow"), "g"))
    label = F.when(k <= 15, F.col("g").cast("string")).otherwise("other")
    parts = at.withColumn("label", label).groupBy("o", "label").agg(exact_sum(F.col("flow")).cast("double").alias("v"), F.count("*").alias("members"))
    total = at.groupBy("o").agg(exact_sum(F.col("flow")).cast("double").alias("t"))
    return parts.join(total, "o").select("o", "label", r4(100 * F.col("v") / F.col("t"), "share"), "members")


@query(f"""WITH {DAILY} SELECT g, date_trunc('month', d)::DATE AS m, round(sum(v::DECIMAL(38,6))::DOUBLE / count(*), 8) AS mean, count(*) AS days FROM daily GROUP BY ALL""")
def month_averages(spark, sf):
    """Daily values as month averages."""
    return daily_orders(spark, sf).groupBy("g", F.to_date(F.date_trunc("month", "d")).alias("m")).agg(F.round(exact_sum(F.col("v")).cast("double") / F.count("*"), 8).alias("mean"), F.count("*").alias("days"))


@query("""SELECT n_name AS g, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS partial, count(DISTINCT o_custkey) AS entities, count(DISTINCT c_mktsegment) AS kinds, max(o_orderdate)::DATE AS newest FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def profile_counts(spark, sf):
    """What a group holds by status and kind, and by how many entities."""
    orders, customers, nations = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    at = orders.join(customers, orders.o_custkey == customers.c_custkey).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    of = lambda s, name: F.count_if(F.col("o_orderstatus") == s).alias(name)
    return at.groupBy(F.col("n_name").alias("g")).agg(F.count("*").alias("n"), of("F", "closed"), of("O", "open"), of("P", "partial"), F.countDistinct("o_custkey").alias("entities"), F.countDistinct("c_mktsegment").alias("kinds"), F.to_date(F.max("o_orderdate")).alias("newest"))


@query("""WITH l AS (SELECT max(o_orderdate)::DATE AS last FROM orders), c AS (SELECT o_orderpriority AS g, o_custkey, count(*) AS n FROM orders, l WHERE o_orderdate::DATE > last - 365 GROUP BY ALL) SELECT g, sum(n)::BIGINT AS n, count(*) AS entities, max(n) AS most, count(*) FILTER (n = 1) AS once FROM c GROUP BY g""")
def category_counts(spark, sf):
    """Items of each category in the last year, by how many entities, and how they spread over them."""
    orders = table(spark, sf, "orders", ["o_orderdate", "o_orderpriority", "o_custkey"]).withColumn("d", F.to_date("o_orderdate"))
    last = orders.agg(F.max("d").alias("last"))  # one row
    each = orders.crossJoin(F.broadcast(last)).where(F.datediff("last", "d") < 365).groupBy(F.col("o_orderpriority").alias("g"), "o_custkey").agg(F.count("*").alias("n"))
    return each.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("entities"), F.max("n").alias("most"), F.count_if(F.col("n") == 1).alias("once"))


@query("""SELECT c_nationkey AS g, arg_max(c_acctbal, (abs(c_acctbal), -c_custkey)) AS v, arg_max(c_custkey, (abs(c_acctbal), -c_custkey)) AS k FROM customer GROUP BY 1""")
def largest_magnitude(spark, sf):
    """The balance of largest size in each group, with its sign; of equal sizes the first."""
    size = F.struct(F.abs("c_acctbal").alias("a"), (-F.col("c_custkey")).alias("k"))
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.max_by("c_acctbal", size).alias("v"), F.max_by("c_custkey", size).alias("k"))


@query("""WITH f AS (SELECT l_suppkey AS g, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::INT AS o, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL) SELECT o, count(*) AS filings, sum(a)::BIGINT AS a, sum(n)::BIGINT AS n, sum(r)::BIGINT AS r, count(*) FILTER (least(a, n, r) < 2) AS thin FROM f GROUP BY o""")
def statement_counts(spark, sf):
    """Rows of each statement by period, and filings with under two rows of some statement."""
    of = lambda flag: F.count_if(F.col("l_returnflag") == flag).alias(flag.lower())
    filings = table(spark, sf, "lineitem", ["l_suppkey", "l_shipdate", "l_returnflag"]).groupBy(F.col("l_suppkey").alias("g"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int").alias("o")).agg(of("A"), of("N"), of("R"))
    return filings.groupBy("o").agg(F.count("*").alias("filings"), *(F.sum(c).alias(c) for c in "anr"), F.count_if(F.least("a", "n", "r") < 2).alias("thin"))


@query(f"""WITH {SUPPLIER}, s AS (SELECT g, o, CASE WHEN qty >= 100 THEN flow / qty END AS v FROM sq), m AS (SELECT a.g, a.o, a.v > b.v AS up FROM s a LEFT JOIN s b ON b.g = a.g AND b.o = a.o - 1), k AS (SELECT g, max(o) AS last FROM s GROUP BY g), x AS (SELECT m.g, max(o) AS stop FROM m WHERE up IS NOT TRUE GROUP BY m.g)
    SELECT k.g, (last - coalesce(stop, (SELECT min(o) FROM s WHERE s.g = k.g) - 1))::INT AS rises FROM k LEFT JOIN x USING (g)""")
def rises_to_the_end(spark, sf):
    """How many periods up to the last one rose without a break; a missing value, or one in a missing period, ends the run."""
    at = supplier_quarters(spark, sf).select("g", "o", F.when(F.col("qty") >= 100, F.col("flow") / F.col("qty")).alias("v"))
    before = F.max("v").over(Window.partitionBy("g").orderBy("o").rangeBetween(-1, -1))
    at = at.withColumn("up", F.coalesce(F.col("v") > before, F.lit(False)))
    return at.groupBy("g").agg((F.max("o") - F.coalesce(F.max(F.when(~F.col("up"), F.col("o"))), F.min("o") - 1)).cast("int").alias("rises"))


@query(f"""WITH {MONTHLY}, t AS (SELECT g, (y * 12 + m - 1)::INT AS o, v FROM monthly), c AS (SELECT a.g, a.o, 100 * (a.v / b.v - 1) AS x FROM t a JOIN t b ON a.g = b.g AND b.o = a.o - 12) SELECT o, arg_max(g, x) AS leader, round(max(x), 4) AS lead, arg_min(g, x) AS laggard, round(max(x) - min(x), 4) AS spread, count(*) AS n FROM c GROUP BY o HAVING count(*) >= 2""")
def group_leader(spark, sf):
    """Which group grew most in each month, which least, and how far apart they are."""
    at = monthly_orders(spark, sf).select("g", (F.col("y") * 12 + F.col("m") - 1).cast("int").alias("o"), "v")
    was = F.max("v").over(Window.partitionBy("g").orderBy("o").rangeBetween(-12, -12))
    grown = at.withColumn("was", was).where("was > 0").withColumn("x", 100 * (F.col("v") / F.col("was") - 1))
    return grown.groupBy("o").agg(F.max_by("g", "x").alias("leader"), r4(F.max("x"), "lead"), F.min_by("g", "x").alias("laggard"), r4(F.max("x") - F.min("x"), "spread"), F.count("*").alias("n")).where("n >= 2")


@query("""WITH b AS (SELECT l_suppkey AS g, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::INT AS o, coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_linenumber <= 3), 0)::DOUBLE AS a, coalesce(sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)) ) FILTER (l_linenumber <= 4), 0)::DOUBLE AS d, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS t FROM lineitem GROUP BY ALL) SELECT g, o, round(100 * (a - d) / t, 4) AS gap FROM b WHERE t > 0""")
def short_gap(spark, sf):
    """Assets less debts that fall due within the short buckets, in percent of all."""
    p = money("l_extendedprice")
    of = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("double")
    at = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int").alias("o")).agg(of(F.col("l_linenumber") <= 3, p).alias("a"), of(F.col("l_linenumber") <= 4, p * (1 - money("l_discount"))).alias("d"), F.sum(p).cast("double").alias("t"))
    return at.where("t > 0").select("g", "o", r4(100 * (F.col("a") - F.col("d")) / F.col("t"), "gap"))


@query(f"""WITH {SUPPLIER}, l AS (SELECT g, max(o) AS last FROM sq GROUP BY g), c AS (SELECT s.g, last, s.o, flow FROM sq s JOIN l USING (g)), b AS (SELECT a.g, a.last - a.o AS back, 100 * (a.flow / y.flow - 1) AS x FROM c a JOIN sq y ON y.g = a.g AND y.o = a.o - 4 WHERE a.o > a.last - 4)
    SELECT g, max(CASE WHEN back = 0 THEN round(x, 4) END) AS q0, max(CASE WHEN back = 1 THEN round(x, 4) END) AS q1, max(CASE WHEN back = 2 THEN round(x, 4) END) AS q2, max(CASE WHEN back = 3 THEN round(x, 4) END) AS q3 FROM b GROUP BY g""")
def growth_table(spark, sf):
    """Yearly growth of each entity in its last four quarters, side by side."""
    at = supplier_quarters(spark, sf).select("g", "o", "flow")
    back = F.max("o").over(Window.partitionBy("g")) - F.col("o")
    was = F.max("flow").over(Window.partitionBy("g").orderBy("o").rangeBetween(-4, -4))
    got = at.withColumn("back", back).withColumn("x", F.round(100 * (F.col("flow") / was - 1), 4)).where("back < 4 and x is not null")
    return got.groupBy("g").agg(*(F.max(F.when(F.col("back") == k, F.col("x"))).alias(f"q{k}") for k in range(4)))


@query(f"""WITH {SUPPLIER}, w AS (SELECT g, o, stock, sum(flow::DECIMAL(38,6)) OVER f AS ttm, avg(stock) OVER f AS mean_stock, count(*) OVER f AS n FROM sq WINDOW f AS (PARTITION BY g ORDER BY o RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)), l AS (SELECT g, max(o) AS o FROM sq GROUP BY g)
    SELECT g, o, round(stock, 2) AS book, CASE WHEN n = 4 THEN round(ttm::DOUBLE, 2) END AS income, CASE WHEN n = 4 AND mean_stock > 0 THEN round(100 * ttm::DOUBLE / mean_stock, 4) END AS return FROM w JOIN l USING (g, o)""")
def fundamentals(spark, sf):
    """Each entity's book, income of the last four quarters and return on its mean book; null where a quarter is missing."""
    f = Window.partitionBy("g").orderBy("o").rangeBetween(-3, 0)
    at = supplier_quarters(spark, sf).withColumn("ttm", exact_sum(F.col("flow")).over(f).cast("double")).withColumn("mean", F.avg("stock").over(f)).withColumn("n", F.count("*").over(f))
    full = F.col("n") == 4
    last = latest(at, ["g"], ["o"], ["o", "stock", "ttm", "mean", "n"])
    return last.select("g", "o", F.round("stock", 2).alias("book"), F.when(full, F.round("ttm", 2)).alias("income"), F.when(full & (F.col("mean") > 0), r4(100 * F.col("ttm") / F.col("mean"), "x")).alias("return"))
