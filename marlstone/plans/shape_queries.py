"""Caps, branches, resolvers, payloads, statements, grids of filings, paths, merges, snapshots, skips."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import keyed as K
from ..operators import panel as P
from ..sources.tables import daily_orders, money, monthly_orders, supplier_quarters, table, weekly_orders
from .identity_queries import STATEMENT, _statement
from .metric_queries import ORD, _ord
from .registry import DAILY, MONTHLY, SUPPLIER, WEEKLY, query
from .series_queries import r6

CAP = 25


@query(f"""SELECT o_orderkey AS k, o_totalprice AS v, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') > {CAP} AS cut FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT {CAP}""")
def capped_rows(spark, sf):
    """The first rows up to a cap; one row more is asked for, which tells whether there were others."""
    top = table(spark, sf, "orders").where("o_orderstatus = 'P'").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(CAP + 1)
    at = top.withColumn("n", F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey")))  # cap + 1 rows
    probe = at.agg((F.count("*") > CAP).alias("cut"))  # one row
    return at.where(F.col("n") <= CAP).crossJoin(F.broadcast(probe)).select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), "cut")


@query("""(SELECT 'orders' AS branch, o_orderkey AS k, o_totalprice AS v FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL (SELECT 'customers', c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION ALL (SELECT 'suppliers', s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5)""")
def union_of_tops(spark, sf):
    """The first five of each of three branches."""
    parts = [("orders", "orders", "o_orderkey", "o_totalprice"), ("customers", "customer", "c_custkey", "c_acctbal"), ("suppliers", "supplier", "s_suppkey", "s_acctbal")]
    tops = [table(spark, sf, t, [k, v]).orderBy(F.col(v).desc(), k).limit(5).select(F.lit(name).alias("branch"), F.col(k).alias("k"), F.col(v).alias("v")) for name, t, k, v in parts]
    return tops[0].unionByName(tops[1]).unionByName(tops[2])


@query("""SELECT 'documents' AS name, unnest(['rows', 'text', 'lang', 'source']) AS item, unnest([count(*), count(text), count(lang), count(DISTINCT source)]) AS n FROM documents UNION ALL SELECT 'labels', unnest(['rows', 'quality', 'toxic', 'marked']), unnest([count(*), count(quality), count(toxic), count(*) FILTER (quality = 1)]) FROM labels""")
def column_counts(spark, sf):
    """Counts of several columns from one scan of each table."""
    one = lambda name, aggs: table(spark, sf, name).agg(*(a.alias(c) for c, a in aggs.items())).unpivot([], list(aggs), "item", "n").select(F.lit(name).alias("name"), "item", "n")
    docs = one("documents", {"rows": F.count("*"), "text": F.count("text"), "lang": F.count("lang"), "source": F.countDistinct("source")})
    return docs.unionByName(one("labels", {"rows": F.count("*"), "quality": F.count("quality"), "toxic": F.count("toxic"), "marked": F.count_if(F.col("quality") == 1)}))


@query(f"""WITH {MONTHLY}, {WEEKLY}, {DAILY} SELECT 'M.' || g AS code, make_date(y, m, 1) AS d, round(v, 2) AS v FROM monthly UNION ALL SELECT 'W.' || g, d, round(v, 2) FROM weekly UNION ALL SELECT 'D.' || g, d, round(v, 2) FROM daily""")
def resolved_layouts(spark, sf):
    """Series of three physical layouts under codes of one kind."""
    code = lambda letter: F.concat(F.lit(f"{letter}."), "g").alias("code")
    month = monthly_orders(spark, sf).select(code("M"), F.make_date("y", "m", F.lit(1)).alias("d"), F.round("v", 2).alias("v"))
    return month.unionByName(weekly_orders(spark, sf).select(code("W"), "d", F.round("v", 2).alias("v"))).unionByName(daily_orders(spark, sf).select(code("D"), "d", F.round("v", 2).alias("v")))


@query(f"""WITH {MONTHLY}, {WEEKLY}, c AS (SELECT 'M.' || g AS code, 'monthly' AS frequency, make_date(y, m, 1) AS d, v FROM monthly UNION ALL SELECT 'W.' || g, 'weekly', d, v FROM weekly) SELECT code, frequency, min(d) AS start_date, max(d) AS end_date, count(v) AS obs_count, concat('{{"code":"', code, '","obs_count":', count(v)::VARCHAR, '}}') AS payload FROM c GROUP BY code, frequency""")
def catalogue_payloads(spark, sf):
    """Catalogue rows of two sources, and each as JSON."""
    month = monthly_orders(spark, sf).select(F.concat(F.lit("M."), "g").alias("code"), F.lit("monthly").alias("frequency"), F.make_date("y", "m", F.lit(1)).alias("d"), "v")
    both = month.unionByName(weekly_orders(spark, sf).select(F.concat(F.lit("W."), "g").alias("code"), F.lit("weekly").alias("frequency"), "d", "v"))
    got = both.groupBy("code", "frequency").agg(F.min("d").alias("start_date"), F.max("d").alias("end_date"), F.count("v").alias("obs_count"))
    return got.withColumn("payload", F.to_json(F.struct("code", "obs_count")))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'several' WHEN 2 THEN 'not a query' WHEN 3 THEN 'word' ELSE 'ok' END AS problem FROM orders""")
def statement_checks(spark, sf):
    """Statements after comments are taken out: one alone, a query, no word that writes; words in quotes don't count."""
    forms = ("SELECT 1 -- DROP x\n", "SELECT 1; SELECT 2", "UPDATE t SET a = 1", "WITH x AS (DELETE FROM t) SELECT 1", "SELECT 'drop; it' /* ; */ AS a;")
    sql = F.element_at(F.array(*map(F.lit, forms)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("k"), X.statement_problem(sql).alias("problem"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN ['999999'] ELSE [] END AS invented FROM orders""")
def invented_numbers(spark, sf):
    """Numbers of an answer that are neither in the data nor in the question."""
    k = F.col("o_orderkey")
    answer = F.concat(F.lit("order "), k.cast("string"), F.lit(" of 1997 and "), F.when(k % 4 == 0, "999999").otherwise("1997"))
    numbers = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1)))
    return table(spark, sf, "orders", ["o_orderkey"]).select(k.alias("k"), F.array_except(numbers(answer), F.array(k.cast("string"), F.lit("1997"))).alias("invented"))


@query(f"""WITH {SUPPLIER}, f AS (SELECT g, o FROM sq WHERE (g + o) % 9 <> 0), p AS (SELECT DISTINCT o FROM sq), e AS (SELECT DISTINCT g FROM sq), x AS (SELECT e.g, p.o FROM e CROSS JOIN p) SELECT x.g, x.o, CASE WHEN x.o >= (SELECT max(o) - 1 FROM p) THEN 'due' ELSE 'gap' END AS status FROM x WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.g = x.g AND f.o = x.o)""")
def missing_filings(spark, sf):
    """Expected cells without a filing: gaps, or due in the last two periods."""
    at = supplier_quarters(spark, sf).select("g", "o", F.when((F.col("g") + F.col("o")) % 9 != 0, F.col("o")).alias("filed"))
    periods = at.agg(F.array_sort(F.collect_set("o")).alias("periods"))  # one row, an entry for each quarter
    have = at.groupBy("g").agg(F.collect_set("filed").alias("have"))
    lost = have.crossJoin(F.broadcast(periods)).select("g", "periods", F.explode(F.array_except("periods", "have")).alias("o"))
    return lost.select("g", "o", F.when(F.col("o") >= F.array_max("periods") - 1, "due").otherwise("gap").alias("status"))


@query("""SELECT l_orderkey AS k, l_linenumber::INT AS top, CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 2 END AS depth, CASE WHEN l_linenumber % 2 = 0 THEN concat(l_linenumber::VARCHAR, '.1') ELSE l_linenumber::VARCHAR END AS parent FROM lineitem""")
def hierarchy_paths(spark, sf):
    """Paths such as 4.1.2. as their first number, depth and parent."""
    n = F.col("l_linenumber").cast("string")
    path = F.concat(n, F.lit(".1"), F.when(F.col("l_linenumber") % 2 == 0, ".2.").otherwise("."))
    parts = F.filter(F.split(path, r"\."), lambda x: x != "")
    return table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("k"), parts[0].cast("int").alias("top"), F.size(parts).alias("depth"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".").alias("parent"))


@query("""SELECT p_partkey AS k, CASE WHEN p_type = 'PROMO' AND p_name LIKE 'red%' THEN 'offer' WHEN p_type = 'PROMO' THEN 'notice' WHEN p_size > 40 THEN 'large' ELSE 'other' END AS disclosure, CASE WHEN p_name LIKE '%bolt' OR p_name LIKE '%gear' THEN 'equity' WHEN p_name LIKE '%ring' THEN 'bond' ELSE 'fund' END AS instrument FROM part""")
def instrument_classes(spark, sf):
    """Disclosures by rules over two fields, instruments by the end of their names."""
    both = F.concat_ws("|", "p_type", "p_name", F.when(F.col("p_size") > 40, "big").otherwise("small"))
    disclosure = X.first_rule(both, [("offer", r"^PROMO\|red"), ("notice", r"^PROMO\|"), ("large", r"\|big$")])
    return table(spark, sf, "part", ["p_partkey", "p_type", "p_name", "p_size"]).select(F.col("p_partkey").alias("k"), disclosure.alias("disclosure"), X.first_rule(F.col("p_name"), [("equity", "(bolt|gear)$"), ("bond", "ring$")], "fund").alias("instrument"))


@query("""SELECT l_orderkey AS k, list_sort(list(DISTINCT l_returnflag)) AS flags, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1""")
def json_arrays(spark, sf):
    """Arrays of texts stored as JSON, read back; what isn't an array reads as empty."""
    stored = table(spark, sf, "lineitem", ["l_orderkey", "l_returnflag"]).groupBy(F.col("l_orderkey").alias("k")).agg(F.to_json(F.sort_array(F.collect_set("l_returnflag"))).alias("j"))
    flags = F.coalesce(F.from_json("j", "array<string>"), F.array().cast("array<string>"))
    return stored.select("k", flags.alias("flags"), F.size(flags).cast("bigint").alias("n"))


@query("""SELECT o_orderkey AS k, strftime(o_orderdate::DATE - 45, '%Y-%m-%d') AS back, strftime(o_orderdate::DATE + 45, '%Y-%m-%d') AS ahead, strftime((date_trunc('month', o_orderdate) + INTERVAL 3 MONTH)::DATE, '%Y-%m') AS later FROM orders""")
def shifted_dates(spark, sf):
    """Dates written as text, moved by days and months and written again."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    move = lambda n: F.date_format(F.date_add(F.to_date(text), n), "yyyy-MM-dd")
    return table(spark, sf, "orders", ["o_orderkey", "o_orderdate"]).select(F.col("o_orderkey").alias("k"), move(-45).alias("back"), move(45).alias("ahead"), F.date_format(F.add_months(F.to_date(text), 3), "yyyy-MM").alias("later"))


@query(f"""WITH {STATEMENT} SELECT g, o, round(coalesce(v1, v2, v3), 2) AS stage1, round(coalesce(v2, v3), 2) AS stage2, CASE WHEN v1 IS NOT NULL THEN 'filed' WHEN v2 IS NOT NULL THEN 'form' WHEN v3 IS NOT NULL THEN 'text' END AS source FROM st WHERE coalesce(v1, v2, v3) IS NOT NULL""")
def stage_merge(spark, sf):
    """A table merged from three sources, and which of them gave the first figure."""
    at = _statement(spark, sf)
    first, second = F.coalesce("v1", "v2", "v3"), F.coalesce("v2", "v3")
    source = F.when(F.col("v1").isNotNull(), "filed").when(F.col("v2").isNotNull(), "form").when(F.col("v3").isNotNull(), "text")
    return at.where(first.isNotNull()).select("g", "o", F.round(first, 2).alias("stage1"), F.round(second, 2).alias("stage2"), source.alias("source"))


@query(f"""WITH {STATEMENT}, t AS (SELECT o, sum(v1::DECIMAL(38,6))::DOUBLE AS income, sum(v2::DECIMAL(38,6))::DOUBLE AS paid, sum(v3::DECIMAL(38,6))::DOUBLE AS fees FROM st GROUP BY o) SELECT o, 'interest' AS source, 'income' AS sink, round(income, 2) AS v FROM t WHERE income > 0 UNION ALL SELECT o, 'income', 'paid', round(paid, 2) FROM t WHERE paid > 0 UNION ALL SELECT o, CASE WHEN income - paid >= 0 THEN 'income' ELSE 'loss' END, 'net', round(abs(income - paid), 2) FROM t WHERE income IS NOT NULL AND paid IS NOT NULL""")
def interest_flows(spark, sf):
    """Edges from what is earned to what is paid and what is left, losses as edges of their own."""
    total = lambda c: P.exact_sum(F.col(c)).cast("double")
    t = _statement(spark, sf).groupBy("o").agg(total("v1").alias("income"), total("v2").alias("paid"))
    net = F.col("income") - F.col("paid")
    edge = lambda a, b, v: F.struct(a.alias("source"), F.lit(b).alias("sink"), F.round(v, 2).alias("v"))
    edges = F.array(F.when(F.col("income") > 0, edge(F.lit("interest"), "income", F.col("income"))), F.when(F.col("paid") > 0, edge(F.lit("income"), "paid", F.col("paid"))), F.when(net.isNotNull(), edge(F.when(net >= 0, "income").otherwise("loss"), "net", F.abs(net))))
    return t.select("o", F.inline(F.filter(edges, lambda e: e.isNotNull())))


@query(f"""WITH {SUPPLIER}, l AS (SELECT g, max(o) AS o FROM sq GROUP BY g), k AS (SELECT sq.g, sq.o, flow, stock, qty FROM sq JOIN l USING (g, o)), n AS (SELECT count(*) AS n FROM k) SELECT g, o, round(flow, 2) AS flow, round(stock / qty, 6) AS ratio, round(100 * flow / (SELECT sum(flow::DECIMAL(38,6))::DOUBLE FROM k), 6) AS share, CASE WHEN (SELECT n FROM n) >= 5 THEN rank() OVER (ORDER BY flow DESC) END AS place FROM k""")
def kpi_snapshot(spark, sf):
    """Each entity's last figures, its share of all and its place, the latter where five are there."""
    at = P.latest(supplier_quarters(spark, sf), ["g"], ["o"], ["o", "flow", "stock", "qty"])
    total = at.agg(P.exact_sum(F.col("flow")).cast("double").alias("total"))  # one row
    ranked = P.with_ranks(at, [], "flow")
    place = F.when(F.col("there") >= 5, F.col("there") - F.col("below") - F.col("ties") + 1)
    return ranked.crossJoin(F.broadcast(total)).select("g", "o", F.round("flow", 2).alias("flow"), r6(F.col("stock") / F.col("qty"), "ratio"), r6(100 * F.col("flow") / F.col("total"), "share"), place.alias("place"))


@query(f"""WITH {SUPPLIER} SELECT o, count(*) AS n, round(CASE WHEN count(*) FILTER (qty IS NOT NULL AND flow IS NOT NULL) >= 8 THEN sum(CASE WHEN qty >= 500 THEN flow ELSE 0 END::DECIMAL(38,6))::DOUBLE / sum(flow::DECIMAL(38,6))::DOUBLE END, 6) AS share FROM sq GROUP BY o""")
def gated_shares(spark, sf):
    """A share of a sum, only where eight members give both figures."""
    both = F.count_if(F.col("qty").isNotNull() & F.col("flow").isNotNull())
    share = P.exact_sum(F.when(F.col("qty") >= 500, F.col("flow")).otherwise(0.0)).cast("double") / P.exact_sum(F.col("flow")).cast("double")
    return supplier_quarters(spark, sf).groupBy("o").agg(F.count("*").alias("n"), F.round(F.when(both >= 8, share), 6).alias("share"))


ROLE_MAP = [("A", "assets"), ("R", "returns")]


@query("""WITH m(f, role) AS (VALUES ('A', 'assets'), ('R', 'returns')) SELECT l_suppkey AS g, role, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS v FROM lineitem JOIN m ON f = l_returnflag GROUP BY ALL""")
def mapped_roles(spark, sf):
    """Lines that a role map names, the others left out."""
    roles = spark.createDataFrame(ROLE_MAP, "f string, role string")
    lines = table(spark, sf, "lineitem", ["l_suppkey", "l_returnflag", "l_quantity"])
    return lines.join(F.broadcast(roles), F.col("l_returnflag") == F.col("f")).groupBy(F.col("l_suppkey").alias("g"), "role").agg(F.count("*").alias("n"), F.sum(money("l_quantity")).cast("double").alias("v"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents) SELECT word, count(*) AS docs FROM d JOIN w USING (word) GROUP BY word""")
def names_in_texts(spark, sf):
    """How many documents hold each word of the benchmark: words are counted first, so the join meets each once."""
    every = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    names = table(spark, sf, "benchmark", ["text"]).select(F.explode(every).alias("word")).distinct()
    words = table(spark, sf, "documents", ["text"]).select(F.explode(every).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    return words.join(names, "word", "left_semi")


@query("""WITH t(name, rows) AS (SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier) SELECT name, rows, CASE name WHEN 'orders' THEN 'push' ELSE 'skip' END AS action FROM t""")
def table_skips(spark, sf):
    """Tables whose digest is as the last finished push left it are skipped whole."""
    parts = []
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")):
        old = table(spark, sf, name).withColumn("name", F.lit(name))
        new = old.withColumn("extra", F.lit(0)) if name == "orders" else old
        both = K.partition_digest(new, ["name"]).join(K.partition_digest(old, ["name"]).select("name", F.col("digest").alias("stored")), "name")
        parts.append(both.select("name", "rows", F.when(F.col("digest") == F.col("stored"), "skip").otherwise("push").alias("action")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {STATEMENT}, v AS (SELECT o, g, unnest(['a', 'b', 'c']) AS rule, unnest([CASE WHEN v1 IS NULL THEN 'skip' WHEN v1 > 500000 THEN 'fail' ELSE 'pass' END, CASE WHEN v2 IS NULL THEN 'skip' WHEN v2 > 400000 THEN 'fail' ELSE 'pass' END, CASE WHEN v3 IS NULL THEN 'skip' ELSE 'pass' END]) AS r FROM st)
    SELECT o, g, count(*) FILTER (r = 'pass') AS passed, count(*) FILTER (r = 'fail') AS failed, CASE WHEN count(*) FILTER (r = 'fail') > 0 THEN 'error' WHEN count(*) FILTER (r = 'pass') = 0 THEN 'unchecked' ELSE 'ok' END AS cell FROM v GROUP BY o, g""")
def coverage_cells(spark, sf):
    """A grid's cells from their checks: one failure is an error, no check that passed is unchecked."""
    check = lambda c, limit: F.when(F.col(c).isNull(), "skip").when(F.col(c) > limit, "fail").otherwise("pass") if limit else F.when(F.col(c).isNull(), "skip").otherwise("pass")
    every = F.array(check("v1", 500000), check("v2", 400000), check("v3", None))
    count = lambda r: F.size(F.filter("r", lambda x: x == r)).cast("bigint")
    at = _statement(spark, sf).select("o", "g", every.alias("r"))
    return at.select("o", "g", count("pass").alias("passed"), count("fail").alias("failed"), F.when(count("fail") > 0, "error").when(count("pass") == 0, "unchecked").otherwise("ok").alias("cell"))


@query(f"""WITH {MONTHLY}, {ORD}, l AS (SELECT max(o) AS o FROM (SELECT o FROM t GROUP BY o HAVING count(DISTINCT g) = 5)) SELECT t.g, round(t.v, 2) AS v, round((t.v / b.v - 1) * 100, 4) AS yearly, date_diff('hour', make_date(t.o // 12, t.o % 12 + 1, 1)::TIMESTAMP, (SELECT max(o_orderdate) FROM orders))::BIGINT AS age_hours FROM t JOIN l ON l.o = t.o LEFT JOIN t b ON b.g = t.g AND b.o = t.o - 12""")
def latest_growth_table(spark, sf):
    """The last month that all groups have, with growth on the year before and its age in hours."""
    at = _ord(spark, sf)
    w = Window.partitionBy("g").orderBy("o").rangeBetween(-12, -12)
    last = P.latest_common(at, "o", "g", 5).select("o")  # one row
    fresh = table(spark, sf, "orders", ["o_orderdate"]).agg(F.max("o_orderdate").alias("now"))  # one row
    got = at.withColumn("was", F.max("v").over(w)).join(F.broadcast(last), "o").crossJoin(F.broadcast(fresh))
    start = F.make_date(F.floor(F.col("o") / 12).cast("int"), (F.col("o") % 12 + 1).cast("int"), F.lit(1)).cast("timestamp")
    age = F.floor((F.unix_timestamp("now") - F.unix_timestamp(start)) / 3600)
    return got.select("g", F.round("v", 2).alias("v"), F.round((F.col("v") / F.col("was") - 1) * 100, 4).alias("yearly"), age.alias("age_hours"))
