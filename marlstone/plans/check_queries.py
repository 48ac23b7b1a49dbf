"""Validators, detectors, text, JSON and folds over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks as C
from ..operators import panel as P
from ..sources.tables import money, monthly_orders, supplier_quarters, table
from .registry import MONTHLY, SUPPLIER, query
from .series_queries import r6


@query("""WITH c AS (SELECT n_regionkey, n_nationkey, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    r AS (SELECT n_regionkey, sum(v::DECIMAL(38,6))::DOUBLE + CASE WHEN n_regionkey = 2 THEN 100000 ELSE 0 END AS own, sum(v::DECIMAL(38,6))::DOUBLE AS total, count(*) AS n FROM c GROUP BY 1)
    SELECT concat('R', n_regionkey::VARCHAR) AS node, round(own, 2) AS own, round(total, 2) AS total, CASE WHEN abs(own - total) <= greatest(3 + n, abs(own) * 5e-5) THEN 'pass' ELSE 'fail' END AS verdict FROM r""")
def hierarchy_sums(spark, sf):
    """Regions against their nations, with one region moved."""
    c = table(spark, sf, "customer", ["c_nationkey", "c_acctbal"]).groupBy("c_nationkey").agg(F.sum(money("c_acctbal")).cast("double").alias("v"))
    n = F.broadcast(table(spark, sf, "nation", ["n_nationkey", "n_regionkey"]))
    leaves = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    tops = leaves.groupBy("n_regionkey").agg(P.exact_sum(F.col("v")).cast("double").alias("v")).withColumn("v", F.col("v") + F.when(F.col("n_regionkey") == 2, 100000).otherwise(0))
    nodes = leaves.select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.concat(F.lit("R"), "n_regionkey").alias("parent"), "v").unionByName(tops.select(F.concat(F.lit("R"), "n_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), "v"))
    return C.parent_sums(nodes, "node", "parent", "v").select("node", F.round("own", 2).alias("own"), F.round("total", 2).alias("total"), "verdict")


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS labels, count(*) FILTER (l_quantity <> 0) AS \"values\" FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1 AND count(*) FILTER (l_quantity <> 0) >= 2")
def duplicate_keys(spark, sf):
    return C.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", "l_quantity")


@query()
def spine_lis(spark, sf):
    lines = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"]).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    return C.increasing_spine(lines, ["l_orderkey"], "l_linenumber", "l_partkey")


@query(f"""WITH {SUPPLIER}, m AS (SELECT g, median(flow) AS mid FROM sq GROUP BY g HAVING count(flow) >= 5)
    SELECT g, o, round(flow, 2) AS flow FROM sq JOIN m USING (g) WHERE mid > 0 AND (flow > 2 * mid OR flow < mid / 2)""")
def dq_median_outliers(spark, sf):
    return C.median_outliers(supplier_quarters(spark, sf).select("g", "o", "flow"), ["g"], "flow", 2.0).select("g", "o", F.round("flow", 2).alias("flow"))


@query(f"""WITH {SUPPLIER}, t AS (SELECT g, o, CASE WHEN g % 3 = 0 AND o = 7990 THEN flow * 1000 ELSE flow END AS flow FROM sq)
    SELECT a.g, a.o, round(a.flow / b.flow, 4) AS ratio FROM t a JOIN t b ON a.g = b.g AND a.o = b.o + 1 WHERE b.flow > 0 AND NOT a.flow / b.flow BETWEEN 0.02 AND 50""")
def unit_change(spark, sf):
    """A quarter of every third entity is a thousand times too large."""
    at = supplier_quarters(spark, sf).select("g", "o", F.when((F.col("g") % 3 == 0) & (F.col("o") == 7990), F.col("flow") * 1000).otherwise(F.col("flow")).alias("flow"))
    return C.ratio_breaks(at, ["g"], "o", "flow").select("g", "o", F.round("ratio", 4).alias("ratio"))


@query(f"""WITH {SUPPLIER}, t AS (SELECT g, o, flow AS a, CASE WHEN g % 5 = 0 THEN flow * 1.5 WHEN g % 7 = 0 THEN 0 ELSE flow END AS b FROM sq)
    SELECT g, o, round(abs(a - b) / greatest(abs(a), abs(b)), 6) AS off FROM t WHERE NOT ((a = 0) <> (b = 0) OR greatest(abs(a), abs(b)) < 1000) AND abs(a - b) / greatest(abs(a), abs(b)) > 0.01""")
def restatement(spark, sf):
    at = supplier_quarters(spark, sf).withColumn("b", F.when(F.col("g") % 5 == 0, F.col("flow") * 1.5).when(F.col("g") % 7 == 0, F.lit(0.0)).otherwise(F.col("flow")))
    return at.withColumn("off", C.mismatch(F.col("flow"), F.col("b"))).where("off > 0.01").select("g", "o", r6(F.col("off"), "off"))


@query(f"""WITH {SUPPLIER}, t AS (SELECT g, o, stock, flow - lag(flow) OVER (PARTITION BY g ORDER BY o) AS ch FROM sq)
    SELECT g, count(*) FILTER (ch > 0) AS up, count(*) FILTER (ch < 0) AS down FROM t GROUP BY g HAVING count(*) FILTER (ch > 0) > 0 AND count(*) FILTER (ch < 0) > 0""")
def sign_flips(spark, sf):
    at = supplier_quarters(spark, sf)
    return C.sign_flips(at.withColumn("ch", F.col("flow") - C.before(F.col("flow"), ["g"], "o")), ["g"], "ch")


@query("""WITH q AS (SELECT l_orderkey % 50 AS k, l_linenumber AS line, year(l_shipdate)::INT AS o, max(l_quantity) AS v FROM lineitem GROUP BY ALL),
    t AS (SELECT * FROM q WHERE o <> 1999 UNION ALL SELECT k, line, 1999, v FROM q WHERE o = 1998 AND k < 10)
    SELECT a.k, a.o, count(*) AS lines, round(avg((a.v = b.v)::INT), 6) AS same FROM t a JOIN t b ON a.k = b.k AND a.line = b.line AND a.o = b.o + 1 WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY a.k, a.o HAVING count(*) >= 4 AND avg((a.v = b.v)::INT) >= 0.95""")
def stale_period(spark, sf):
    """A year repeated from the one before in some keys."""
    q = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"]).groupBy((F.col("l_orderkey") % 50).alias("k"), F.col("l_linenumber").alias("line"), F.year("l_shipdate").alias("o")).agg(F.max("l_quantity").alias("v"))
    t = q.where("o != 1999").unionByName(q.where("o = 1998 and k < 10").withColumn("o", F.lit(1999)))
    return C.repeated_period(t, ["k"], "line", "o", "v", 4).select("k", "o", "lines", r6(F.col("same"), "same"))


@query("""WITH e AS (SELECT DISTINCT n_name AS k FROM nation), k(kind) AS (VALUES ('F'), ('O'), ('P')), f AS (SELECT n_name AS k, o_orderstatus AS kind, count(*) AS n, count(*) FILTER (o_totalprice > 497000) AS failed FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE NOT (n_nationkey % 4 = 0 AND o_orderstatus = 'P') GROUP BY ALL)
    SELECT e.k, k.kind, CASE WHEN n IS NULL THEN 'missing' WHEN failed > 0 THEN 'error' ELSE 'ok' END AS status FROM e CROSS JOIN k LEFT JOIN f ON f.k = e.k AND f.kind = k.kind""")
def coverage_matrix(spark, sf):
    nations = table(spark, sf, "nation", ["n_nationkey", "n_name"])
    met = table(spark, sf, "orders", ["o_custkey", "o_orderstatus", "o_totalprice"]).join(table(spark, sf, "customer", ["c_custkey", "c_nationkey"]), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    found = met.where("not (n_nationkey % 4 = 0 and o_orderstatus = 'P')").groupBy(F.col("n_name").alias("k"), F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("rows"), F.count_if(F.col("o_totalprice") > 497000).alias("failed"))
    return C.coverage(nations.select(F.col("n_name").alias("k")), ["F", "O", "P"], found, ["k"])


@query("""WITH v AS (SELECT l_suppkey AS g, CASE WHEN l_discount IS NULL OR l_tax IS NULL THEN 'skip' WHEN abs(l_extendedprice * (1 - l_discount) - (l_extendedprice - l_extendedprice * l_discount)) <= greatest(3, abs(l_extendedprice - l_extendedprice * l_discount) * 1e-5) THEN 'pass' ELSE 'fail' END AS v FROM (SELECT l_suppkey, l_extendedprice, l_tax, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS l_discount FROM lineitem))
    SELECT g, count(*) FILTER (v = 'pass') AS passed, count(*) FILTER (v = 'fail') AS failed, count(*) FILTER (v = 'skip') AS skipped, (count(*) FILTER (v = 'pass') = 0 OR count(*) FILTER (v = 'fail') > 0) AS error FROM v GROUP BY g""")
def validation_rollup(spark, sf):
    at = table(spark, sf, "lineitem", ["l_suppkey", "l_extendedprice", "l_discount", "l_linenumber"]).withColumn("l_discount", F.when(F.col("l_linenumber") != 7, F.col("l_discount")))
    p, d = F.col("l_extendedprice"), F.col("l_discount")
    return C.roll_up(at.select(F.col("l_suppkey").alias("g"), C.verdict(p * (1 - d), p - p * d, 3, 1e-5).alias("verdict")), ["g"])


@query("""WITH t AS (SELECT o_orderkey AS k, CASE k % 6 WHEN 0 THEN concat('(', round(o_totalprice)::BIGINT::VARCHAR, ')') WHEN 1 THEN replace((o_totalprice::DECIMAL(18,2))::VARCHAR, '.', ',') WHEN 2 THEN '-' WHEN 3 THEN concat('-', round(o_totalprice)::BIGINT::VARCHAR) WHEN 4 THEN 'n/a' ELSE (o_totalprice::DECIMAL(18,2))::VARCHAR END AS s FROM orders)
    SELECT k, CASE k % 6 WHEN 0 THEN -trim(s, '()')::DOUBLE WHEN 1 THEN replace(s, ',', '.')::DOUBLE WHEN 2 THEN 0 WHEN 3 THEN s::DOUBLE WHEN 4 THEN NULL ELSE s::DOUBLE END AS v FROM t""")
def parse_numbers(spark, sf):
    whole = F.round("o_totalprice").cast("bigint").cast("string")
    exact = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    k = F.col("o_orderkey") % 6
    s = F.when(k == 0, F.concat(F.lit("("), whole, F.lit(")"))).when(k == 1, F.replace(exact, F.lit("."), F.lit(","))).when(k == 2, "-").when(k == 3, F.concat(F.lit("-"), whole)).when(k == 4, "n/a").otherwise(exact)
    return table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).select(F.col("o_orderkey").alias("k"), X.parse_number(s).alias("v"))


RULES = [("licence", "(?i)licensed under"), ("contact", r"[\w.]+@[\w.]+"), ("table", r"\|"), ("shout", "!!")]


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(text, '(?i)licensed under') THEN 'licence' WHEN regexp_matches(text, '[\\w.]+@[\\w.]+') THEN 'contact' WHEN contains(text, '|') THEN 'table' WHEN contains(text, '!!') THEN 'shout' ELSE 'other' END AS class FROM documents""")
def text_classify(spark, sf):
    return table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", X.first_rule(F.col("text"), RULES).alias("class"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) AS n, list_sum(list_transform(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), lambda x: least(x::DOUBLE, 1000)::DECIMAL(38,6)))::DOUBLE AS total FROM documents WHERE regexp_matches(text, '\\d')""")
def text_extract(spark, sf):
    found = X.numbers_in(F.col("text"))
    total = F.aggregate(found, F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + F.least(x, F.lit(1000.0)).cast("decimal(38,6)")).cast("decimal(38,6)"))
    return table(spark, sf, "documents", ["doc_id", "text"]).where(F.col("text").rlike(r"\d")).select("doc_id", F.size(found).cast("bigint").alias("n"), total.cast("double").alias("total"))


@query("""WITH a AS (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation) SELECT p_partkey, s.term FROM part JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS term FROM part) s ON contains(concat(' ', p_name, ' '), concat(' ', s.term, ' '))""")
def alias_tagging(spark, sf):
    """Names tagged with each alias they hold as whole words: an equi-join on words, not a nested loop."""
    parts = table(spark, sf, "part", ["p_partkey", "p_name"])
    aliases = parts.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term")).distinct()
    return parts.select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("term")).join(aliases, "term").select("p_partkey", "term")


@query("""SELECT event_type, (event_id % 10)::BIGINT AS bucket, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL""")
def json_columns(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events", ["event_id", "event_type", "props"]).groupBy("event_type", (F.col("event_id") % 10).alias("bucket")).agg(F.sum(k).alias("k"), F.count("*").alias("n"))


@query("""SELECT conv_id, array_to_string(list(text ORDER BY turn) FILTER (role = 'assistant' AND length(text) > 60), ' || ') AS answers, count(*) AS turns FROM conversations GROUP BY conv_id""")
def conversation_turns(spark, sf):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    long = F.filter("t", lambda x: (x["role"] == "assistant") & (F.length(x["text"]) > 60))
    got = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"), F.count("*").alias("turns"))
    return got.select("conv_id", F.when(F.size(long) > 0, F.array_join(F.transform(long, lambda x: x["text"]), " || ")).alias("answers"), "turns")


@query(f"""WITH RECURSIVE {MONTHLY}, s AS (SELECT g, arg_max(v, y * 12 + m) AS v FROM monthly GROUP BY g), p AS (SELECT g, 0 AS k, v AS book, 0::DOUBLE AS pv FROM s UNION ALL SELECT g, k + 1, book * 1.06, pv + (book * 0.12 - book * 0.1) / pow(1.1, k + 1) FROM p WHERE k < 10)
    SELECT g, round(book, 2) AS book, round(pv, 2) AS pv FROM p WHERE k = 10""")
def valuation_fold(spark, sf):
    """A book value carried ten years on, as a fold over the years."""
    s = monthly_orders(spark, sf).groupBy("g").agg(F.max_by("v", F.col("y") * 12 + F.col("m")).alias("v"))
    start = F.struct(F.col("v").alias("book"), F.lit(0.0).alias("pv"))
    step = lambda a, k: F.struct((a["book"] * 1.06).alias("book"), (a["pv"] + (a["book"] * 0.12 - a["book"] * 0.1) / F.pow(F.lit(1.1), k)).alias("pv"))
    got = s.select("g", F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, step).alias("a"))
    return got.select("g", F.round("a.book", 2).alias("book"), F.round("a.pv", 2).alias("pv"))


@query(f"""WITH {MONTHLY} SELECT g, y, round(sum(v::DECIMAL(38,6))::DOUBLE, 2) AS total, round(sum(v::DECIMAL(38,6))::DOUBLE / count(*), 4) AS mean, count(*) AS months FROM monthly GROUP BY ALL HAVING count(*) = 12""")
def year_means(spark, sf):
    got = monthly_orders(spark, sf).groupBy("g", "y").agg(P.exact_sum(F.col("v")).cast("double").alias("total"), F.count("*").alias("months")).where("months = 12")
    return got.select("g", "y", F.round("total", 2).alias("total"), F.round(F.col("total") / F.col("months"), 4).alias("mean"), "months")


@query("""WITH e AS (SELECT user_id, ts, event_type, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR AS gap FROM events), s AS (SELECT user_id, ts, sum(coalesce(gap, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM e)
    SELECT user_id, count(DISTINCT island) AS islands, max(n) AS longest FROM (SELECT user_id, island, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id""")
def gaps_and_islands(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = table(spark, sf, "events", ["user_id", "ts", "event_id"]).withColumn("ts", F.col("ts").cast("timestamp"))
    gap = F.coalesce(F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) > 6 * 3600 * 1_000_000, F.lit(True))
    at = at.withColumn("gap", gap.cast("int")).withColumn("island", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy("user_id", "island").count().groupBy("user_id").agg(F.count("*").alias("islands"), F.max("count").alias("longest"))
