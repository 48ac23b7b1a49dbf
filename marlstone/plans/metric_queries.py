"""More metrics, searches and shapes over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from ..operators import panel as P
from ..operators import series as S
from ..sources.tables import daily_orders, money, monthly_orders, supplier_quarters, table
from .registry import DAILY, MONTHLY, SUPPLIER, query
from .series_queries import r6

ORD = "t AS (SELECT g, (y * 12 + m - 1)::INT AS o, v FROM monthly)"


def _ord(spark, sf):
    return monthly_orders(spark, sf).select("g", (F.col("y") * 12 + F.col("m") - 1).cast("int").alias("o"), "v")


@query(f"""WITH {MONTHLY}, {ORD}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o DESC) AS k FROM t) SELECT g, round(arg_max(v, o), 2) AS last, round(arg_max(v, o) - arg_min(v, o), 2) AS delta FROM n WHERE k <= 7 GROUP BY g""")
def delta_over_n(spark, sf):
    return M.delta_over(_ord(spark, sf), ["g"], "o", "v", 6).select("g", F.round("last", 2).alias("last"), F.round("delta", 2).alias("delta"))


@query(f"""WITH {DAILY}, l AS (SELECT year(d)::INT AS y, g, arg_max(v, d) AS v FROM daily GROUP BY ALL) SELECT y, round(min(v), 2) AS low, arg_min(g, v) AS low_at, round(max(v), 2) AS high, arg_max(g, v) AS high_at FROM l GROUP BY y""")
def group_spread(spark, sf):
    at = daily_orders(spark, sf).withColumn("y", F.year("d"))
    return M.spread(at, ["y"], "g", "d", "v").select("y", F.round("low", 2).alias("low"), "low_at", F.round("high", 2).alias("high"), "high_at")


@query(f"""WITH {MONTHLY}, {ORD}, c AS (SELECT a.o, sign(a.v - b.v) AS s FROM t a JOIN t b ON a.g = b.g AND a.o = b.o + 1) SELECT o, count(*) AS groups, min(s)::INT AS direction FROM c GROUP BY o HAVING min(s) = max(s) AND min(s) <> 0""")
def all_groups_moved(spark, sf):
    return M.all_moved(_ord(spark, sf), [], "g", "o", "v")


@query(f"""WITH {MONTHLY}, y AS (SELECT g, y, m, sum(v::DECIMAL(38,6)) OVER (PARTITION BY g, y ORDER BY m)::DOUBLE AS ytd FROM monthly)
    SELECT a.g, a.y, a.m, round(a.ytd + d.ytd - b.ytd, 2) AS flow FROM y a JOIN y d ON d.g = a.g AND d.y = a.y - 1 AND d.m = 12 JOIN y b ON b.g = a.g AND b.y = a.y - 1 AND b.m = a.m""")
def trailing_year_flow(spark, sf):
    w = Window.partitionBy("g", "y").orderBy("m")
    at = monthly_orders(spark, sf).select("g", "y", "m", F.sum(F.col("v").cast("decimal(38,6)")).over(w).cast("double").alias("ytd"))
    return M.trailing_year(at, ["g"], "y", "m", "ytd").select("g", "y", "m", F.round("flow", 2).alias("flow"))


@query(f"""WITH {DAILY} SELECT d, round(sum(v::DECIMAL(38,6))::DOUBLE, 2) AS total FROM daily GROUP BY d HAVING count(DISTINCT g) = 3""")
def sum_all_members(spark, sf):
    return M.complete_only(daily_orders(spark, sf), ["d"], "g", "v", 3).select("d", F.round("total", 2).alias("total"))


@query(f"""WITH {SUPPLIER}, c AS (SELECT a.g, a.o, a.flow - b.flow AS delta FROM sq a JOIN sq b ON a.g = b.g AND a.o = b.o + 1)
    SELECT g, o, round(delta, 2) AS delta, round(abs(delta) / (sum(abs(delta)::DECIMAL(38,6)) OVER (PARTITION BY o))::DOUBLE, 6) AS part, row_number() OVER (PARTITION BY o ORDER BY abs(delta) DESC, g) AS rank FROM c""")
def movement_ranking(spark, sf):
    return M.movement_ranking(supplier_quarters(spark, sf).select("g", "o", "flow"), ["g"], "o", "flow").select("g", "o", F.round("delta", 2).alias("delta"), r6(F.col("part"), "part"), "rank")


@query(f"""WITH {MONTHLY}, {ORD}, a AS (SELECT *, (sum(v::DECIMAL(38,6)) OVER w)::DOUBLE / 12 AS m12, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY g ORDER BY o RANGE BETWEEN 11 PRECEDING AND CURRENT ROW))
    SELECT a.g, a.o, round(100 * (a.m12 / b.m12 - 1), 6) AS growth FROM a JOIN a b ON a.g = b.g AND a.o = b.o + 12 WHERE a.n = 12 AND b.n = 12 AND b.m12 > 0""")
def twelve_month_average_growth(spark, sf):
    mean = S.rolling(_ord(spark, sf), ["g"], "o", "v", 12, "avg", "mean", contiguous=True)
    base = mean.select("g", (F.col("o") + 12).alias("o"), F.col("mean").alias("base")).where("base > 0")
    return mean.join(base, ["g", "o"]).select("g", "o", r6(100 * (F.col("mean") / F.col("base") - 1), "growth"))


@query(f"""WITH {DAILY}, a AS (SELECT d, v, row_number() OVER (ORDER BY d) AS n FROM daily WHERE g = 'F'), k AS (SELECT max(d) FILTER (v > 1500000) AS d FROM a)
    SELECT round(avg(v), 4) AS mean, count(*) AS n FROM (SELECT v FROM a WHERE d <= (SELECT d FROM k) ORDER BY d DESC LIMIT 20)""")
def trailing_mean_before(spark, sf):
    """Mean of the last twenty values at or before the last day over a level."""
    at = daily_orders(spark, sf).where("g = 'F'")
    day = at.where("v > 1500000").agg(F.max("d").alias("k"))  # one row
    last = at.crossJoin(day).where("d <= k").orderBy(F.col("d").desc()).limit(20)
    return last.agg(F.round(F.avg("v"), 4).alias("mean"), F.count("*").alias("n"))


@query(f"""WITH {MONTHLY} SELECT g, y, m, round(v, 2) AS step, round((coalesce(sum(v::DECIMAL(38,6)) OVER (PARTITION BY g, y ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE, 2) AS base FROM monthly""")
def waterfall_steps(spark, sf):
    return M.waterfall(monthly_orders(spark, sf), ["g", "y"], "m", "v").select("g", "y", "m", F.round("v", 2).alias("step"), F.round("base", 2).alias("base"))


@query("""WITH l AS (SELECT l_suppkey AS g, l_orderkey * 100 + l_linenumber AS o, max(l_linenumber) AS n FROM lineitem GROUP BY ALL), a AS (SELECT *, CASE WHEN n <= lag(n) OVER (PARTITION BY g ORDER BY o) THEN 1 ELSE 0 END AS again FROM l)
    SELECT g, o, n, (sum(again) OVER (PARTITION BY g ORDER BY o ROWS UNBOUNDED PRECEDING))::INT AS instance FROM a""")
def numbered_blocks(spark, sf):
    lines = table(spark, sf, "lineitem", ["l_suppkey", "l_orderkey", "l_linenumber"])
    at = lines.groupBy(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("o")).agg(F.max("l_linenumber").alias("n"))
    return M.template_instances(at, ["g"], "o", "n")


@query("""WITH a AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS t FROM part), b AS (SELECT list_sort(list_distinct(string_split(p_name, ' '))) AS t, max(p_partkey) AS k FROM part GROUP BY ALL),
    m AS (SELECT a.k, b.k AS b, len(b.t) AS n FROM a JOIN b ON list_has_all(a.t, b.t)) SELECT k, arg_max(b, (n, b)) AS match, max(n) AS tokens FROM m GROUP BY k""")
def token_containment(spark, sf):
    parts = table(spark, sf, "part", ["p_partkey", "p_name"]).withColumn("t", F.split("p_name", " "))
    return M.contains_all(parts.select(F.col("p_partkey").alias("k"), "t"), parts.select(F.col("p_partkey").alias("match"), F.col("t").alias("u")), "k", "t", "match", "u")


@query("""WITH b AS (SELECT max(o_orderdate)::DATE + 4 AS now FROM orders) SELECT c_mktsegment || o_orderpriority AS source, count(*) AS n, max(o_orderdate)::DATE AS newest, CASE WHEN date_diff('day', max(o_orderdate)::DATE, any_value(now)) <= 1.5 * 2 THEN 'fresh' WHEN date_diff('day', max(o_orderdate)::DATE, any_value(now)) <= 3 * 2 THEN 'late' ELSE 'stale' END AS status FROM orders JOIN customer ON o_custkey = c_custkey, b GROUP BY 1""")
def source_freshness(spark, sf):
    """How old each source's newest row is four days after the newest of all, against a rhythm of two days."""
    orders, customers = table(spark, sf, "orders", ["o_custkey", "o_orderpriority", "o_orderdate"]), table(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    now = orders.agg(F.date_add(F.to_date(F.max("o_orderdate")), 4).alias("now"))
    got = orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy(F.concat("c_mktsegment", "o_orderpriority").alias("source")).agg(F.count("*").alias("n"), F.to_date(F.max("o_orderdate")).alias("newest"))
    return got.crossJoin(F.broadcast(now)).select("source", "n", "newest", M.freshness(F.datediff("now", "newest"), 2).alias("status"))


@query("""SELECT c_mktsegment AS g, min(date_diff('day', o_orderdate, l_shipdate)) AS least, max(date_diff('day', o_orderdate, l_shipdate)) AS most, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def lag_extremes(spark, sf):
    lines, orders, customers = table(spark, sf, "lineitem", ["l_orderkey", "l_shipdate"]), table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]), table(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    lag = F.datediff("l_shipdate", "o_orderdate").cast("bigint")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey).groupBy(F.col("c_mktsegment").alias("g")).agg(F.min(lag).alias("least"), F.max(lag).alias("most"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_returnflag AS stage, year(l_shipdate)::INT AS y, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v, sum((l_extendedprice * l_discount)::DECIMAL(38,6))::DOUBLE AS e FROM lineitem GROUP BY ALL), t AS (SELECT y, sum(v::DECIMAL(38,6))::DOUBLE AS total, count(*) AS n FROM s GROUP BY y)
    SELECT s.y, stage, round(v / total, 6) AS share, round(e / v, 6) AS coverage FROM s JOIN t USING (y) WHERE t.n = 3 AND s.y = (SELECT max(y) FROM t WHERE n = 3)""")
def stage_ladder(spark, sf):
    """Shares and coverages of stages in the latest year that has all of them."""
    lines = table(spark, sf, "lineitem", ["l_returnflag", "l_shipdate", "l_extendedprice", "l_discount"])
    s = lines.groupBy(F.col("l_returnflag").alias("stage"), F.year("l_shipdate").alias("y")).agg(F.sum(money("l_extendedprice")).cast("double").alias("v"), P.exact_sum(F.col("l_extendedprice") * F.col("l_discount")).cast("double").alias("e"))
    t = s.groupBy("y").agg(P.exact_sum(F.col("v")).cast("double").alias("total"), F.count("*").alias("n")).where("n = 3").orderBy(F.col("y").desc()).limit(1)
    return s.join(F.broadcast(t), "y").select("y", "stage", r6(F.col("v") / F.col("total"), "share"), r6(F.col("e") / F.col("v"), "coverage"))


@query(f"""WITH {MONTHLY}, {ORD}, f AS (SELECT g, o // 12 AS y, sum(v::DECIMAL(38,6))::DOUBLE / count(*) AS mean, count(*) AS n FROM t GROUP BY ALL), w AS (SELECT g, y, mean, n, lag(mean) OVER (PARTITION BY g ORDER BY y) AS guess FROM f)
    SELECT g, y::INT AS y, n, round(mean, 4) AS actual, round(guess, 4) AS forecast, CASE WHEN guess IS NULL OR n < 12 THEN 'not graded' WHEN abs(mean - guess) <= 0.02 * guess THEN 'near' ELSE 'off' END AS grade FROM w""")
def forecast_scorecard(spark, sf):
    """Year means against the year before as the forecast; incomplete years aren't graded."""
    f = _ord(spark, sf).groupBy("g", (F.col("o") / 12).cast("int").alias("y")).agg((P.exact_sum(F.col("v")).cast("double") / F.count("*")).alias("mean"), F.count("*").alias("n"))
    w = f.withColumn("guess", F.lag("mean").over(Window.partitionBy("g").orderBy("y")))
    grade = F.when(F.col("guess").isNull() | (F.col("n") < 12), "not graded").when(F.abs(F.col("mean") - F.col("guess")) <= 0.02 * F.col("guess"), "near").otherwise("off")
    return w.select("g", "y", "n", F.round("mean", 4).alias("actual"), F.round("guess", 4).alias("forecast"), grade.alias("grade"))


@query(f"""WITH {SUPPLIER} SELECT a.g, a.o, round(a.flow - b.flow, 2) AS qoq, round(a.flow - c.flow, 2) AS yoy, CASE WHEN abs(a.flow - b.flow) <= 0.01 * abs(b.flow) THEN 'flat' WHEN a.flow > b.flow THEN 'up' ELSE 'down' END AS direction FROM sq a JOIN sq b ON a.g = b.g AND a.o = b.o + 1 LEFT JOIN sq c ON a.g = c.g AND a.o = c.o + 4""")
def metric_change(spark, sf):
    at = supplier_quarters(spark, sf).select("g", "o", "flow")
    b, c = at.select("g", (F.col("o") + 1).alias("o"), F.col("flow").alias("b")), at.select("g", (F.col("o") + 4).alias("o"), F.col("flow").alias("c"))
    way = F.when(F.abs(F.col("flow") - F.col("b")) <= 0.01 * F.abs("b"), "flat").when(F.col("flow") > F.col("b"), "up").otherwise("down")
    return at.join(b, ["g", "o"]).join(c, ["g", "o"], "left").select("g", "o", F.round(F.col("flow") - F.col("b"), 2).alias("qoq"), F.round(F.col("flow") - F.col("c"), 2).alias("yoy"), way.alias("direction"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?\\n]')) AS c FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS clauses, max(length(trim(c, ' '))) AS longest FROM s WHERE contains(lower(c), 'license') GROUP BY doc_id""")
def clause_extraction(spark, sf):
    at = table(spark, sf, "documents", ["doc_id", "text"]).withColumn("c", X.clauses(F.col("text"), "license")).where(F.size("c") > 0)
    return at.select("doc_id", F.size("c").cast("bigint").alias("clauses"), F.array_max(F.transform("c", lambda x: F.length(x))).cast("bigint").alias("longest"))


@query("""SELECT lower(regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', '')) AS link, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1""")
def canonical_links(spark, sf):
    link = F.lower(F.regexp_replace(F.regexp_replace("url", "[#?].*$", ""), "/+$", ""))
    return table(spark, sf, "pages", ["page_id", "url"]).groupBy(link.alias("link")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (text IS NULL OR length(text) < 30) AS short, count(DISTINCT source) AS sources, max(n_chars) AS longest FROM documents GROUP BY lang""")
def source_summary(spark, sf):
    return table(spark, sf, "documents", ["lang", "text", "source", "n_chars"]).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.length("text") < 30)).alias("short"), F.countDistinct("source").alias("sources"), F.max("n_chars").alias("longest"))


@query("""SELECT source, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source ORDER BY chars DESC, source LIMIT 12""")
def topic_top12(spark, sf):
    return table(spark, sf, "documents", ["source", "n_chars"]).groupBy("source").agg(F.sum("n_chars").alias("chars")).orderBy(F.col("chars").desc(), "source").limit(12)


@query("""SELECT doc_id, quality, toxic, CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS credit FROM labels""")
def partial_credit(spark, sf):
    credit = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).when(F.col("quality") == 1, 0.5).otherwise(0.0)
    return table(spark, sf, "labels").select("doc_id", "quality", "toxic", credit.alias("credit"))


@query("""WITH t AS (SELECT c_custkey AS k, c_acctbal, o.n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) o ON o_custkey = c_custkey) SELECT k, n FROM t ORDER BY n DESC NULLS LAST, k LIMIT 30""")
def nulls_last_top(spark, sf):
    low = table(spark, sf, "orders", ["o_custkey", "o_orderpriority"]).where("o_orderpriority = '5-LOW'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    customers = table(spark, sf, "customer", ["c_custkey"])
    return customers.join(low, customers.c_custkey == low.o_custkey, "left").select(F.col("c_custkey").alias("k"), "n").orderBy(F.col("n").desc_nulls_last(), "k").limit(30)


@query("""SELECT o_custkey AS k, arg_min(o_orderkey, (CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_orderkey)) AS first_choice FROM orders GROUP BY 1""")
def priority_first(spark, sf):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    return table(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_orderpriority"]).groupBy(F.col("o_custkey").alias("k")).agg(F.min_by("o_orderkey", F.struct(rank.alias("r"), "o_orderkey")).alias("first_choice"))


@query("""WITH m AS (SELECT o_custkey AS g, year(o_orderdate)::INT AS y, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders GROUP BY ALL)
    SELECT a.g, a.y, array_to_string(list_filter(a.s, lambda x: NOT list_contains(b.s, x)), ',') AS added, array_to_string(list_filter(b.s, lambda x: NOT list_contains(a.s, x)), ',') AS removed FROM m a JOIN m b ON a.g = b.g AND a.y = b.y + 1 WHERE a.s <> b.s""")
def member_changes(spark, sf):
    """Members that a set gained and lost against the period before."""
    m = table(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_orderpriority"]).groupBy(F.col("o_custkey").alias("g"), F.year("o_orderdate").alias("y")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("s"))
    b = m.select("g", (F.col("y") + 1).alias("y"), F.col("s").alias("b"))
    return m.join(b, ["g", "y"]).where("s != b").select("g", "y", F.array_join(F.array_except("s", "b"), ",").alias("added"), F.array_join(F.array_except("b", "s"), ",").alias("removed"))


@query("""SELECT l_suppkey AS g, l_returnflag AS f, round(log10(abs(max(l_extendedprice) / nullif(min(l_quantity), 0))))::INT AS decade FROM lineitem GROUP BY ALL HAVING abs(log10(abs(max(l_extendedprice) / nullif(min(l_quantity), 0))) - round(log10(abs(max(l_extendedprice) / nullif(min(l_quantity), 0))))) <= 0.25""")
def unit_factor(spark, sf):
    got = table(spark, sf, "lineitem", ["l_suppkey", "l_returnflag", "l_extendedprice", "l_quantity"]).groupBy(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("f")).agg(X.power_of_ten(F.max("l_extendedprice"), F.min("l_quantity")).alias("decade"))
    return got.where("decade is not null")


@query("SELECT explode_k AS d FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 91 DAY))::DATE AS explode_k FROM orders)")
def backfill_anchors(spark, sf):
    """Dates thirteen weeks apart over the span of the orders."""
    span = table(spark, sf, "orders", ["o_orderdate"]).agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return span.select(F.explode(F.sequence("a", "b", F.expr("interval 13 weeks"))).alias("d"))
