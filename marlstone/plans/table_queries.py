"""Filters, joins, aggregations, sets, shares and ranks over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import keyed as K
from ..operators import panel as P
from ..operators import series as S
from ..sources.tables import money, monthly_orders, supplier_quarters, table
from .registry import MONTHLY, SUPPLIER, query
from .series_queries import r6


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate::DATE AS shipped FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-07-01' AND l_returnflag IN ('R', 'A') AND l_discount BETWEEN 0.02 AND 0.05""")
def filter_project(spark, sf):
    lines = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag", "l_discount"])
    got = lines.where((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1997-07-01").cast("timestamp")) & F.col("l_returnflag").isin("R", "A") & F.col("l_discount").between(0.02, 0.05))
    return got.select("l_orderkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").alias("shipped"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period, last_day(o_orderdate)::DATE AS month_end,
    concat(year(o_orderdate)::VARCHAR, 'Q', quarter(o_orderdate)::VARCHAR) AS quarter FROM orders""")
def period_label(spark, sf):
    d = F.col("o_orderdate")
    quarter = F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
    return table(spark, sf, "orders", ["o_orderkey", "o_orderdate"]).select("o_orderkey", F.date_format(d, "yyyy-MM").alias("period"), F.last_day(d).alias("month_end"), quarter.alias("quarter"))


@query(f"""WITH {MONTHLY}, t AS (SELECT y, m, g, sum(v::DECIMAL(38,6)) OVER (PARTITION BY g, y ORDER BY m)::DOUBLE AS ytd FROM monthly)
    SELECT y, m, g, round(ytd * 12 / m, 6) AS annualised FROM t""")
def annualised_ratio(spark, sf):
    w = Window.partitionBy("g", "y").orderBy("m")
    return monthly_orders(spark, sf).select("y", "m", "g", F.round(F.sum(F.col("v").cast("decimal(38,6)")).over(w).cast("double") * 12 / F.col("m"), 6).alias("annualised"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0 THEN l_tax / l_discount END, 6) AS guarded FROM lineitem""")
def null_safe_ratio(spark, sf):
    return table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_tax", "l_discount"]).select("l_orderkey", "l_linenumber", r6(S.safe_div(F.col("l_tax"), F.col("l_discount")), "guarded"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'wid') OR contains(lower(p_type), 'wid') ORDER BY p_name, p_partkey LIMIT 25 OFFSET 10")
def contains_search(spark, sf):
    hit = F.contains(F.lower("p_name"), F.lit("wid")) | F.contains(F.lower("p_type"), F.lit("wid"))
    return table(spark, sf, "part", ["p_partkey", "p_name", "p_type"]).where(hit).orderBy("p_name", "p_partkey").offset(10).limit(25).select("p_partkey", "p_name")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 49)""")
def composite_key_semi(spark, sf):
    lines = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    big = lines.where("l_quantity >= 49").select("l_partkey", "l_suppkey").distinct()
    return lines.join(big, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join_missing(spark, sf):
    pending = table(spark, sf, "orders", ["o_custkey", "o_orderstatus"]).where("o_orderstatus = 'P'")
    customers = table(spark, sf, "customer", ["c_custkey", "c_name"])
    return customers.join(pending, customers.c_custkey == pending.o_custkey, "left_anti")


@query("""SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, o_orderstatus AS g,
      round(100 * (sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderpriority = '1-URGENT'))::DOUBLE / sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 6) AS urgent_share FROM orders GROUP BY ALL""")
def two_item_ratio(spark, sf):
    """Two items of one table in one pass instead of a self-join."""
    urgent = F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", money("o_totalprice"))).cast("double")
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.col("o_orderstatus").alias("g")).agg(r6(100 * urgent / F.sum(money("o_totalprice")).cast("double"), "urgent_share"))


@query("""SELECT l_suppkey, max(CASE WHEN p_type = 'PROMO' THEN l_extendedprice END) AS promo_max, max(CASE WHEN p_type = 'ECONOMY' THEN l_extendedprice END) AS economy_max,
      coalesce(sum(CASE WHEN p_type = 'PROMO' THEN l_quantity::DECIMAL(18,2) END), 0)::DOUBLE AS promo_qty, count(*) FILTER (p_partkey IS NULL) AS no_role
    FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 40) ON l_partkey = p_partkey GROUP BY l_suppkey""")
def role_left_join_pivot(spark, sf):
    roles = table(spark, sf, "part", ["p_partkey", "p_type", "p_size"]).where("p_size < 40")
    lines = table(spark, sf, "lineitem", ["l_suppkey", "l_partkey", "l_extendedprice", "l_quantity"])
    when = lambda t, c: F.when(F.col("p_type") == t, c)
    return lines.join(roles, lines.l_partkey == roles.p_partkey, "left").groupBy("l_suppkey").agg(
        F.max(when("PROMO", F.col("l_extendedprice"))).alias("promo_max"),
        F.max(when("ECONOMY", F.col("l_extendedprice"))).alias("economy_max"),
        F.coalesce(F.sum(when("PROMO", money("l_quantity"))), F.lit(0)).cast("double").alias("promo_qty"),
        F.count_if(F.col("p_partkey").isNull()).alias("no_role"),
    )


@query("""WITH k AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size > 40 UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'),
    a AS (SELECT l_partkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_quantity > 45 GROUP BY ALL), b AS (SELECT p_partkey AS k, p_size::DOUBLE AS v FROM part WHERE p_size > 40), c AS (SELECT l_partkey AS k, min(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT k.k, coalesce(a.v, b.v, c.v) AS v FROM k LEFT JOIN a USING (k) LEFT JOIN b USING (k) LEFT JOIN c USING (k)""")
def six_source_coalesce(spark, sf):
    lines, parts = table(spark, sf, "lineitem", ["l_partkey", "l_quantity", "l_returnflag"]), table(spark, sf, "part", ["p_partkey", "p_size"])
    a = lines.where("l_quantity > 45").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_quantity").alias("v"))
    b = parts.where("p_size > 40").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("v"))
    c = lines.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_quantity").alias("v"))
    return K.coalesce_sources([a, b, c], ["k"], ["v"])


@query("SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_row_per_key(spark, sf):
    orders = table(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"])
    return P.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate", "o_totalprice"]).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"), "o_totalprice")


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS suppliers, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey")
def bridge_tags(spark, sf):
    pairs = table(spark, sf, "lineitem", ["l_partkey", "l_suppkey"]).distinct()
    return pairs.groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_list("l_suppkey")), ",").alias("suppliers"), F.count("*").alias("n"))


HEAL = "SELECT l_orderkey AS k, l_returnflag AS part, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY ALL"


@query(f"""WITH t AS ({HEAL}) SELECT * FROM t UNION ALL SELECT a.k, 'R' AS part, a.v + b.v AS v FROM t a JOIN t b ON a.k = b.k AND a.part = 'A' AND b.part = 'N' WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.k = a.k AND c.part = 'R')""")
def heal_missing_total(spark, sf):
    t = table(spark, sf, "lineitem", ["l_orderkey", "l_returnflag", "l_extendedprice"]).groupBy(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("part")).agg(F.sum(money("l_extendedprice")).cast("double").alias("v"))
    return K.heal_totals(t, ["k"], "part", "v", ("A", "N"), "R")


@query("""SELECT l_suppkey, count(DISTINCT c_nationkey) AS nations, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY l_suppkey HAVING count(DISTINCT c_nationkey) >= 2""")
def entity_hubs(spark, sf):
    lines, orders, customers = table(spark, sf, "lineitem", ["l_suppkey", "l_orderkey"]), table(spark, sf, "orders", ["o_orderkey", "o_custkey"]), table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    met = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    return met.groupBy("l_suppkey").agg(F.countDistinct("c_nationkey").alias("nations"), F.countDistinct("o_orderkey").alias("orders")).where("nations >= 2")


@query("""SELECT year(o_orderdate)::INT AS y, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F'), 0)::DOUBLE AS f, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'O'), 0)::DOUBLE AS o,
      round(100 * (sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F'))::DOUBLE / (sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus IN ('F', 'O')))::DOUBLE, 6) AS ratio FROM orders GROUP BY ALL""")
def pivot_ratio(spark, sf):
    of = lambda *s: F.sum(F.when(F.col("o_orderstatus").isin(*s), money("o_totalprice")))
    zero = F.lit(0).cast("decimal(18,2)")
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.coalesce(of("F"), zero).cast("double").alias("f"), F.coalesce(of("O"), zero).cast("double").alias("o"), r6(100 * of("F").cast("double") / of("F", "O").cast("double"), "ratio"))


@query("""WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL HAVING count(DISTINCT o_custkey) >= 10) SELECT * FROM t ORDER BY period DESC LIMIT 1""")
def latest_common_period(spark, sf):
    at = table(spark, sf, "orders", ["o_orderdate", "o_custkey"]).withColumn("period", F.date_format("o_orderdate", "yyyy-MM"))
    return P.latest_common(at, "period", "o_custkey", 10)


@query("""WITH t AS (SELECT l_suppkey AS g, l_extendedprice AS a, CASE WHEN l_discount > 0.02 THEN l_quantity END AS b FROM lineitem)
    SELECT g, sum(CASE WHEN b IS NOT NULL THEN a::DECIMAL(18,2) END)::DOUBLE AS num, sum(b::DECIMAL(18,2))::DOUBLE AS den, count(b) AS n FROM t GROUP BY g HAVING count(b) >= 5""")
def null_matched_sums(spark, sf):
    at = table(spark, sf, "lineitem", ["l_suppkey", "l_extendedprice", "l_quantity", "l_discount"]).withColumn("b", F.when(F.col("l_discount") > 0.02, F.col("l_quantity")))
    both = F.col("b").isNotNull() & F.col("l_extendedprice").isNotNull()
    return at.groupBy(F.col("l_suppkey").alias("g")).agg(F.sum(F.when(both, money("l_extendedprice"))).cast("double").alias("num"), F.sum(F.when(both, money("b"))).cast("double").alias("den"), F.count("b").alias("n")).where("n >= 5")


@query("""SELECT l_suppkey AS g, round(sum((l_discount * l_quantity)::DECIMAL(38,6))::DOUBLE / sum(l_quantity::DECIMAL(38,6))::DOUBLE, 6) AS discount FROM lineitem GROUP BY g""")
def weighted_mean(spark, sf):
    return table(spark, sf, "lineitem", ["l_suppkey", "l_discount", "l_quantity"]).groupBy(F.col("l_suppkey").alias("g")).agg(r6(P.weighted_mean(F.col("l_discount"), F.col("l_quantity")), "discount"))


SHARES = f"""{SUPPLIER}, sh AS (SELECT o, g, flow, flow / (sum(CASE WHEN flow > 0 THEN flow END::DECIMAL(38,6)) OVER (PARTITION BY o))::DOUBLE AS share, row_number() OVER (PARTITION BY o ORDER BY flow DESC, g) AS rank FROM sq)"""


@query(f"""WITH {SHARES}, p AS (SELECT o, row_number() OVER (ORDER BY o) AS p FROM (SELECT DISTINCT o FROM sh)), s AS (SELECT * FROM sh JOIN p USING (o))
    SELECT s.o, s.g, round(s.share, 8) AS share, s.rank, b.rank - s.rank AS rank_change, round(s.share - f.share, 6) AS share_shift FROM s LEFT JOIN s b ON b.g = s.g AND b.p = s.p - 1 LEFT JOIN s f ON f.g = s.g AND f.p = s.p - 4""")
def share_league(spark, sf):
    return P.league(P.shares(supplier_quarters(spark, sf), "o", "g", "flow"), "o", "g").select("o", "g", F.round("share", 8).alias("share"), "rank", "rank_change", r6(F.col("share_shift"), "share_shift"))


@query(f"WITH {SHARES} SELECT o, round(sum((share * share)::DECIMAL(38,18))::DOUBLE * 10000, 4) AS hhi, count(share) AS members FROM sh GROUP BY o")
def share_hhi(spark, sf):
    return P.concentration(P.shares(supplier_quarters(spark, sf), "o", "g", "flow"), "o").select("o", F.round("hhi", 4).alias("hhi"), "members")


@query("""WITH s AS (SELECT l_suppkey AS g, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.75) AS q75, count(*) AS n FROM lineitem GROUP BY g),
    x AS (SELECT g, count(*) FILTER (l_extendedprice > 2 * median OR l_extendedprice < median / 8) AS outliers FROM lineitem JOIN s ON l_suppkey = g GROUP BY g)
    SELECT g, round(median, 4) AS median, round(q25, 4) AS q25, round(q75, 4) AS q75, outliers FROM s JOIN x USING (g) WHERE n >= 5""")
def median_quantile(spark, sf):
    lines = table(spark, sf, "lineitem", ["l_suppkey", "l_extendedprice"]).select(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("x"))
    q = P.quantiles(lines, ["g"], "x", [0.25, 0.5, 0.75], ["q25", "median", "q75"]).where("there >= 5")
    far = (F.col("x") > 2 * F.col("median")) | (F.col("x") < F.col("median") / 8)
    got = lines.join(q, "g").groupBy("g").agg(F.count_if(far).alias("outliers"), *(F.first(c).alias(c) for c in ("q25", "median", "q75")))
    return got.select("g", *(F.round(c, 4).alias(c) for c in ("q25", "median", "q75")), "outliers")


@query("SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part, arg_max(l_partkey, (abs(l_extendedprice), l_partkey)) AS largest_part FROM lineitem GROUP BY l_orderkey")
def packed_argmin(spark, sf):
    return table(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]).groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"), F.max_by("l_partkey", F.struct(F.abs("l_extendedprice").alias("a"), "l_partkey")).alias("largest_part"))


@query("SELECT p_brand, count(*) AS n, round(regr_slope(p_retailprice, p_size), 4) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2, round(covar_samp(p_retailprice, p_size) / var_samp(p_size), 4) AS beta FROM part GROUP BY p_brand HAVING count(*) > 2")
def ols_fit(spark, sf):
    fit = lambda f, name, k: F.round(F.expr(f), k).alias(name)
    return table(spark, sf, "part", ["p_brand", "p_retailprice", "p_size"]).groupBy("p_brand").agg(F.count("*").alias("n"), fit("regr_slope(p_retailprice, p_size)", "slope", 4), fit("regr_intercept(p_retailprice, p_size)", "intercept", 4), fit("regr_r2(p_retailprice, p_size)", "r2", 6), fit("covar_samp(p_retailprice, p_size) / var_samp(p_size)", "beta", 4)).where("n > 2")


@query("""WITH t AS (SELECT s_suppkey AS g, CASE WHEN s_acctbal > 0 THEN round(s_acctbal / 1000) END AS v FROM supplier), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS mr, count(v) OVER () AS n FROM t WHERE v IS NOT NULL)
    SELECT t.g, round(CASE WHEN n = 1 THEN 0.5 ELSE (mr - 1) / (n - 1) END, 6) AS score, CASE WHEN n > 1 THEN CASE WHEN (mr - 1) / (n - 1) >= 0.75 THEN 'top' WHEN (mr - 1) / (n - 1) >= 0.25 THEN 'middle' ELSE 'bottom' END END AS band FROM t LEFT JOIN r USING (g)""")
def midrank_score(spark, sf):
    at = table(spark, sf, "supplier", ["s_suppkey", "s_acctbal"]).select(F.col("s_suppkey").alias("g"), F.when(F.col("s_acctbal") > 0, F.round(F.col("s_acctbal") / 1000)).alias("v"))
    got = P.midrank_score(at, [], "v")
    band = F.when(F.col("score") >= 0.75, "top").when(F.col("score") >= 0.25, "middle").when(F.col("score").isNotNull(), "bottom")
    return got.select("g", r6(F.col("score"), "score"), band.alias("band"))


@query("""WITH s AS (SELECT s_suppkey AS g, s_nationkey AS k, s_acctbal AS v, count(*) OVER (PARTITION BY s_nationkey) AS n, count(*) OVER () AS total FROM supplier)
    SELECT g, k, CASE WHEN n >= 5 THEN row_number() OVER (PARTITION BY k ORDER BY v DESC, g) WHEN total >= 5 THEN row_number() OVER (ORDER BY v DESC, g) END AS rank FROM s""")
def peer_rank(spark, sf):
    at = table(spark, sf, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]).select(F.col("s_suppkey").alias("g"), F.col("s_nationkey").cast("string").alias("k"), F.col("s_acctbal").alias("v"))
    return P.peer_rank(at, "g", "k", "v", 5).select("g", F.col("k").cast("int").alias("k"), "rank")


@query("""WITH b AS (SELECT l_returnflag AS stage, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY 1), s(bps) AS (VALUES (-200), (-100), (100), (200))
    SELECT stage, bps::INT AS bps, round(v * bps / 10000 * (1 - CASE stage WHEN 'A' THEN 1 / 24 WHEN 'N' THEN 2 / 12 ELSE 7.5 / 12 END), 4) AS effect FROM b CROSS JOIN s""")
def scenarios(spark, sf):
    """Every bucket under every shock; the shocks are a list of the caller."""
    b = table(spark, sf, "lineitem", ["l_returnflag", "l_extendedprice"]).groupBy(F.col("l_returnflag").alias("stage")).agg(F.sum(money("l_extendedprice")).cast("double").alias("v"))
    middle = F.when(F.col("stage") == "A", F.lit(1 / 24)).when(F.col("stage") == "N", F.lit(2 / 12)).otherwise(F.lit(7.5 / 12))
    at = b.withColumn("bps", F.explode(F.array(*(F.lit(x) for x in (-200, -100, 100, 200)))))
    return at.select("stage", "bps", F.round(F.col("v") * F.col("bps") / 10000 * (1 - middle), 4).alias("effect"))


@query(f"""WITH {SHARES} SELECT o, CASE WHEN share >= 0.03 THEN g::VARCHAR ELSE 'other' END AS label, round(sum(share::DECIMAL(38,6))::DOUBLE, 4) AS share FROM sh GROUP BY ALL""")
def composition_residual(spark, sf):
    at = supplier_quarters(spark, sf).select("o", F.col("g").cast("string").alias("label"), "flow")
    return P.with_residual(at, ["o"], "label", "flow", 0.03).select("o", "label", F.round("share", 4).alias("share"))


@query(f"""WITH {SUPPLIER}, h AS (SELECT g, o, flow, avg(flow) OVER w AS mu, stddev_pop(flow) OVER w AS sd, count(*) OVER w AS n FROM sq WINDOW w AS (PARTITION BY g ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT g, o, round(least(abs(flow - mu) / sd, 8), 4) AS z FROM h WHERE n >= 6 AND sd > 0""")
def zscore_scout(spark, sf):
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    at = supplier_quarters(spark, sf).select("g", "o", "flow", F.avg("flow").over(w).alias("mu"), F.stddev_pop("flow").over(w).alias("sd"), F.count("*").over(w).alias("n"))
    return at.where("n >= 6 and sd > 0").select("g", "o", F.round(P.capped_z(F.col("flow"), F.col("mu"), F.col("sd"), F.col("n")), 4).alias("z"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders QUALIFY k <= 3")
def topk_per_group(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_totalprice"]).withColumn("k", F.row_number().over(w)).where("k <= 3")


@query("""SELECT k, CASE WHEN min(s) = 1 THEN 'both' WHEN max(s) = 2 THEN 'old' ELSE 'new' END AS status FROM (
    SELECT o_custkey AS k, 2 AS s FROM orders WHERE year(o_orderdate) = 1996 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
    UNION SELECT o_custkey, 3 FROM orders WHERE year(o_orderdate) = 1997 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996)
    UNION (SELECT o_custkey, 1 FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey, 1 FROM orders WHERE year(o_orderdate) = 1997)) GROUP BY k""")
def set_ops(spark, sf):
    orders = table(spark, sf, "orders", ["o_custkey", "o_orderdate"])
    had = lambda y: F.max((F.year("o_orderdate") == y).cast("int"))
    at = orders.groupBy(F.col("o_custkey").alias("k")).agg(had(1996).alias("a"), had(1997).alias("b")).where("a + b > 0")
    return at.select("k", F.when(F.col("a") + F.col("b") == 2, "both").when(F.col("a") == 1, "old").otherwise("new").alias("status"))


DIFF = "SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS v FROM orders"


@query(f"""WITH old AS ({DIFF} WHERE o_orderkey % 7 <> 0), new AS (SELECT k, s, CASE WHEN k % 5 = 0 THEN v + 1 ELSE v END AS v FROM ({DIFF}) WHERE k % 11 <> 0)
    SELECT coalesce(old.k, new.k) AS k, CASE WHEN old.k IS NULL THEN 'new' WHEN new.k IS NULL THEN 'gone' ELSE 'changed' END AS status FROM old FULL JOIN new ON old.k = new.k WHERE old.k IS NULL OR new.k IS NULL OR (old.s, old.v) IS DISTINCT FROM (new.s, new.v)""")
def incremental_diff(spark, sf):
    at = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("stamp"))
    new = at.where("k % 11 != 0").withColumn("v", F.when(F.col("k") % 5 == 0, F.col("v") + 1).otherwise(F.col("v"))).withColumn("stamp", F.current_timestamp())
    return K.changes(at.where("k % 7 != 0"), new, ["k"], ("stamp",))


@query(f"""WITH u AS (SELECT k, s, v, 1 AS t FROM ({DIFF}) WHERE k % 3 <> 0 UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN s END, v * 2, 2 FROM ({DIFF}) WHERE k % 4 = 0)
    SELECT k, arg_max(s, t) FILTER (s IS NOT NULL) AS s, arg_max(v, t) AS v FROM u GROUP BY k""")
def upsert_keep_missing(spark, sf):
    at = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    old = at.where("k % 3 != 0").withColumn("t", F.lit(1))
    new = at.where("k % 4 = 0").select("k", F.when(F.col("k") % 2 == 0, F.col("s")).alias("s"), (F.col("v") * 2).alias("v"), F.lit(2).alias("t"))
    return K.upsert(old, new, ["k"], "t", ("s",)).select("k", "s", "v")


@query("""SELECT o_custkey AS g, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 13 = 0) GROUP BY g""")
def partition_digest_skip(spark, sf):
    """Partitions whose digest is unchanged after every 13th order's price moved."""
    at = table(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_totalprice"])
    moved = at.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    old, new = K.partition_digest(at, ["o_custkey"]), K.partition_digest(moved, ["o_custkey"])
    return new.join(K.unchanged(new, old, ["o_custkey"]), "o_custkey").select(F.col("o_custkey").alias("g"), "rows")
