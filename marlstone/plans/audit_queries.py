"""Identities, bands, seams, signals and searches over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import panel as P
from ..sources.tables import supplier_quarters, table
from .registry import SUPPLIER, query
from .series_queries import r6


@query("""WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS base, l_extendedprice * l_discount AS d, l_extendedprice * l_tax AS x, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice - l_extendedprice * l_discount - l_extendedprice * l_tax + CASE WHEN l_orderkey % 50 = 0 THEN 100 ELSE 0 END END AS target FROM lineitem)
    SELECT k, n, CASE WHEN target IS NULL THEN 'skip' WHEN abs(base + d + x - target) <= greatest(3, abs(target) * 5e-5) OR abs(base - abs(d) - abs(x) - target) <= greatest(3, abs(target) * 5e-5) THEN 'pass' ELSE 'fail' END AS verdict FROM t""")
def deduction_chain(spark, sf):
    p = F.col("l_extendedprice")
    target = F.when(F.col("l_linenumber") != 5, p - p * F.col("l_discount") - p * F.col("l_tax") + F.when(F.col("l_orderkey") % 50 == 0, 100).otherwise(0))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), C.signed_chain(p, [p * F.col("l_discount"), p * F.col("l_tax")], target).alias("verdict"))


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 9 = 0 THEN 'skip' WHEN p_size BETWEEN 5 AND 40 THEN 'pass' ELSE 'fail' END AS verdict FROM part""")
def plausible_bands(spark, sf):
    v = F.when(F.col("p_size") % 9 != 0, F.col("p_size"))
    return table(spark, sf, "part", ["p_partkey", "p_size"]).select(F.col("p_partkey").alias("k"), C.in_band(v, 5, 40).alias("verdict"))


@query(f"""WITH {SUPPLIER}, r AS (SELECT g, o, qty / 1000 AS r FROM sq) SELECT a.g, a.o, round(b.r, 6) AS before, round(a.r, 6) AS now FROM r a JOIN r b ON a.g = b.g AND a.o = b.o + 1 WHERE b.r >= 0.5 AND a.r < 0.3""")
def ratio_collapse(spark, sf):
    at = supplier_quarters(spark, sf).select("g", "o", (F.col("qty") / 1000).alias("r"))
    return C.collapses(at, ["g"], "o", "r", 0.5, 0.3).select("g", "o", r6(F.col("before"), "before"), r6(F.col("r"), "now"))


@query("""WITH t AS (SELECT l_suppkey % 20 AS g, l_returnflag || l_linestatus || l_linenumber::VARCHAR AS line, year(l_shipdate) AS y, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL), a AS (SELECT g, y, line, v FROM t WHERE NOT (g = 3 AND line LIKE 'A%')), b AS (SELECT g, y, line, CASE WHEN g % 5 = 0 THEN v * 1000 ELSE v END AS v FROM t WHERE NOT (g = 4 AND line LIKE 'N%')),
    m AS (SELECT coalesce(a.g, b.g) AS g, coalesce(a.y, b.y)::INT AS y, a.v AS a, b.v AS b FROM a FULL JOIN b ON a.g = b.g AND a.y = b.y AND a.line = b.line) SELECT g, y, count(*) FILTER (a IS NULL) AS new_lines, count(*) FILTER (b IS NULL) AS gone_lines, CASE WHEN count(*) FILTER (b / a > 900) >= 3 AND g % 5 = 0 THEN 3 END AS unit_switch FROM m GROUP BY g, y""")
def seam_comparison(spark, sf):
    """A statement against its re-extract: lines lost and found, and a change of unit."""
    line = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    t = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("g"), F.year("l_shipdate").alias("y"), line.alias("line")).agg(F.max("l_extendedprice").alias("v"))
    a = t.where("not (g = 3 and line like 'A%')")
    b = t.where("not (g = 4 and line like 'N%')").withColumn("v", F.when(F.col("g") % 5 == 0, F.col("v") * 1000).otherwise(F.col("v")))
    return C.seam(a, b, ["g", "y"], "line", "v")


@query(f"""WITH {SUPPLIER} SELECT g, o, unnest(list_filter([CASE WHEN qty > 500 THEN 'volume' END, CASE WHEN flow > 2000000 THEN 'value' END, CASE WHEN stock < 80000 THEN 'small' END], lambda x: x IS NOT NULL)) AS flag FROM sq""")
def entity_flags(spark, sf):
    rules = [("volume", F.col("qty") > 500), ("value", F.col("flow") > 2000000), ("small", F.col("stock") < 80000)]
    return supplier_quarters(spark, sf).select("g", "o", F.explode(C.flags(rules)).alias("flag"))


@query(f"""WITH {SUPPLIER} SELECT concat('step:', a.g::VARCHAR, ':', a.o::VARCHAR) AS signal_id, a.o FROM sq a JOIN sq b ON a.g = b.g AND a.o = b.o + 1 WHERE a.stock > 1.02 * b.stock""")
def signal_identity(spark, sf):
    at = supplier_quarters(spark, sf).select("g", "o", "stock")
    before = at.select("g", (F.col("o") + 1).alias("o"), F.col("stock").alias("was"))
    return at.join(before, ["g", "o"]).where("stock > 1.02 * was").select(*C.signal("step", ["g", "o"], ["stock", "was"]), "o").drop("payload")


@query("""WITH s AS (SELECT l_suppkey AS g, l_extendedprice AS v FROM lineitem), p AS (SELECT DISTINCT l_suppkey AS g, round(l_extendedprice * CASE WHEN l_suppkey % 3 = 0 THEN 1000 ELSE 1 END)::HUGEINT AS p FROM lineitem WHERE l_linenumber <> 2),
    f(f) AS (VALUES (1), (1000), (1000000)), m AS (SELECT s.g, f, count(*) AS n, count(p.p) AS hit FROM s CROSS JOIN f LEFT JOIN p ON p.g = s.g AND p.p = round(s.v)::HUGEINT * f GROUP BY ALL)
    SELECT g, round(max(hit / n), 4) AS found FROM m GROUP BY g""")
def capture_reconcile(spark, sf):
    """Stored amounts found among printed ones, at the unit that finds most."""
    lines = table(spark, sf, "lineitem", ["l_suppkey", "l_linenumber", "l_extendedprice"]).select(F.col("l_suppkey").alias("g"), "l_linenumber", F.round("l_extendedprice").alias("v"))
    printed = table(spark, sf, "lineitem", ["l_suppkey", "l_linenumber", "l_extendedprice"]).where("l_linenumber != 2").select(F.col("l_suppkey").alias("g"), (F.col("l_extendedprice") * F.when(F.col("l_suppkey") % 3 == 0, 1000).otherwise(1)).alias("v"))
    return C.capture_share(lines, printed, ["g"], "v").select("g", F.round("found", 4).alias("found"))


@query("""WITH t AS (SELECT DISTINCT l_suppkey AS g, year(l_shipdate)::INT AS y FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7 AND l_quantity > 40), r AS (SELECT year(l_shipdate)::INT AS y FROM lineitem GROUP BY 1), p AS (SELECT g, y + 1 AS y FROM t JOIN r USING (y) WHERE y + 1 IN (SELECT y FROM r)), n AS (SELECT g, y FROM t WHERE y - 1 IN (SELECT y FROM r))
    SELECT concat(coalesce(n.g, p.g)::VARCHAR, ':', coalesce(n.y, p.y)::VARCHAR) AS k, CASE WHEN p.g IS NULL THEN 'new' ELSE 'resolved' END AS state FROM n FULL JOIN p ON n.g = p.g AND n.y = p.y WHERE n.g IS NULL OR p.g IS NULL""")
def anomaly_delta(spark, sf):
    """Findings of each year's run against the run before: new ones and those resolved. A finding is a supplier with a large last line returned."""
    lines = table(spark, sf, "lineitem", ["l_suppkey", "l_shipdate", "l_returnflag", "l_linenumber", "l_quantity"]).withColumn("y", F.year("l_shipdate"))
    runs = lines.select("y").distinct()  # a row for each year
    found = lines.where("l_returnflag = 'R' and l_linenumber = 7 and l_quantity > 40").select(F.col("l_suppkey").alias("g"), "y").distinct()
    had = F.broadcast(runs.select((F.col("y") + 1).alias("y")))
    now = found.join(had, "y").select(F.concat_ws(":", "g", "y").alias("k"))
    before = found.select("g", (F.col("y") + 1).alias("y")).join(F.broadcast(runs), "y").select(F.concat_ws(":", "g", "y").alias("k"))
    return C.anomaly_delta(now, before, "k")


@query("""SELECT o_orderkey AS k, count(*) AS n, sum(length(l_returnflag || l_linestatus))::BIGINT AS chars, min(l_linenumber)::INT AS first FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def document_grids(spark, sf):
    """Cells of each document as one JSON grid, read back through a schema."""
    lines = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"])
    orders = table(spark, sf, "orders", ["o_orderkey"])
    grid = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy(F.col("o_orderkey").alias("k")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("row"), F.concat("l_returnflag", "l_linestatus").alias("cell"))))).alias("grid"))
    cells = F.from_json("grid", "array<struct<row: int, cell: string>>")
    got = grid.withColumn("c", cells)
    return got.select("k", F.size("c").cast("bigint").alias("n"), F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["cell"])).alias("chars"), F.array_min(F.transform("c", lambda x: x["row"])).alias("first"))


@query("""WITH b AS (SELECT min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders), w AS (SELECT first + (k * 91)::INT AS opens, first + (k * 91)::INT + 44 AS closes FROM (SELECT first, unnest(range(0, date_diff('day', first, last) // 91 + 1)) AS k FROM b)), o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders)
    SELECT k, max(opens) AS opens, (date_diff('day', max(opens), any_value(d)) + 1)::INT AS day, any_value(d) <= max(closes) AS open FROM o JOIN w ON opens <= d GROUP BY k""")
def window_calendar(spark, sf):
    """The last window opened by each order's day, from the first order on: windows become days, so the join is by equality."""
    span = table(spark, sf, "orders", ["o_orderdate"]).agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    spans = span.select(F.explode(F.expr("sequence(first, last, interval 91 days)")).alias("opens"))
    days = spans.select("opens", F.explode(F.sequence("opens", F.date_add("opens", 90))).alias("d"))
    orders = table(spark, sf, "orders", ["o_orderkey", "o_orderdate"]).select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    return orders.join(F.broadcast(days), "d").select("k", "opens", (F.datediff("d", "opens") + 1).alias("day"), (F.datediff("d", "opens") <= 44).alias("open"))


@query("""WITH d AS (SELECT c_custkey AS k, c_mktsegment AS a, min(o_orderpriority) AS p FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL), l AS (SELECT a, p, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT a, count(*) AS total FROM d GROUP BY a)
    SELECT a, p, n, round(n / total, 6) AS coverage FROM l JOIN s USING (a)""")
def shelf_coverage(spark, sf):
    d = table(spark, sf, "customer", ["c_custkey", "c_mktsegment"]).join(table(spark, sf, "orders", ["o_custkey", "o_orderpriority"]), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey", F.col("c_mktsegment").alias("a")).agg(F.min("o_orderpriority").alias("p"))
    total = d.groupBy("a").agg(F.count("*").alias("total"))
    return d.groupBy("a", "p").agg(F.count("*").alias("n")).join(total, "a").select("a", "p", "n", r6(F.col("n") / F.col("total"), "coverage"))


@query(f"""WITH {SUPPLIER}, m AS (SELECT o, median(flow) AS med, count(*) AS n FROM sq GROUP BY o HAVING count(*) >= 3), f AS (SELECT g, o, flow, flow > lag(flow) OVER (PARTITION BY g ORDER BY o) AS up FROM sq)
    SELECT o, n, round(med, 4) AS med, (count(*) FILTER (flow > med)) AS above FROM m JOIN sq USING (o) GROUP BY o, n, med""")
def class_median(spark, sf):
    at = supplier_quarters(spark, sf).select("o", "flow")
    m = P.quantiles(at, ["o"], "flow", [0.5], ["med"]).withColumnRenamed("there", "n").where("n >= 3")
    return at.join(m, "o").groupBy("o", "n", "med").agg(F.count_if(F.col("flow") > F.col("med")).alias("above")).withColumn("med", F.round("med", 4))


@query("""WITH t AS (SELECT o_custkey AS g, o_orderdate::DATE AS d, o_orderpriority AS p, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders) SELECT g, d, was, p AS now FROM t WHERE was IS NOT NULL AND was <> p AND (was LIKE '1%' OR p LIKE '1%')""")
def category_change(spark, sf):
    """Changes of class into or out of the most urgent one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    at = table(spark, sf, "orders").withColumn("was", F.lag("o_orderpriority").over(w)).where("was is not null and was != o_orderpriority and (was like '1%' or o_orderpriority like '1%')")
    return at.select(F.col("o_custkey").alias("g"), F.to_date("o_orderdate").alias("d"), "was", F.col("o_orderpriority").alias("now"))
