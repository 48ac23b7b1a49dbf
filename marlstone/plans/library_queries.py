"""Round trips through sinks, feeds, tables of pages, catalogue pages, spec checks, guards of writes, rules and holders."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dsl
from ..functions import text as X
from ..operators import bundles as B
from ..operators import keyed as K
from ..operators import panel as P
from ..sources import feeds
from ..sources.tables import daily_orders, money, monthly_orders, shared_dir, supplier_quarters, table, without_nan, write_csv, write_json_lines
from ..streaming import weekly as W
from . import catalog
from .metric_queries import ORD, _ord
from .registry import DAILY, MONTHLY, SUPPLIER, WEEKLY, query
from .series_queries import r6
from .service_queries import FACTS, SPEC, _facts

TENS, ONES = ("", "X", "XX", "XXX", "XL", "L"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")


def _folder(spark, label):
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("""SELECT s_suppkey AS k, concat('sirin ', lower(s_name)) AS folded, concat('İI ', upper(replace(s_name, 'i', 'İ'))) AS upper, replace(replace(replace(format('{:,.2f}', s_acctbal::DECIMAL(18,2)::DOUBLE), ',', '_'), '.', ','), '_', '.') AS shown, ['A B', upper(s_name)] AS items FROM supplier""")
def text_forms(spark, sf):
    """Folded and upper forms with both kinds of i, figures with grouped digits, items of a delimited list."""
    name = F.col("s_name")
    return table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_acctbal"]).select(F.col("s_suppkey").alias("k"), X.fold(F.concat(F.lit("Şırın "), name)).alias("folded"), X.upper_dotted(F.concat(F.lit("iı "), name)).alias("upper"), X.format_grouped(F.col("s_acctbal")).alias("shown"), X.split_list(F.concat(F.lit("a b ; ,"), name)).alias("items"))


@query("SELECT p_partkey AS k, CASE WHEN p_size > 0 THEN p_size END AS n, NULL::INT AS none FROM part")
def numerals(spark, sf):
    """Roman numerals read as numbers; a wrong one is none."""
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), i.cast("int") + 1)
    text = F.concat(pick(TENS, F.floor(F.col("p_size") / 10)), pick(ONES, F.col("p_size") % 10))
    return table(spark, sf, "part", ["p_partkey", "p_size"]).select(F.col("p_partkey").alias("k"), X.roman(text).alias("n"), X.roman(F.concat(text, F.lit("IIX"))).alias("none"))


@query("SELECT o_orderkey AS k, o_totalprice AS v, o_orderdate::DATE AS d, concat('said \"', o_orderpriority, '\", twice') AS note FROM orders")
def csv_round_trip(spark, sf):
    """A table written as CSV, quotes and commas inside, and read back."""
    at = _folder(spark, "csv")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.to_date("o_orderdate").alias("d"), F.concat(F.lit('said "'), "o_orderpriority", F.lit('", twice')).alias("note"))
    write_csv(rows, at)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(at)


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS v, [s_name, 'x'] AS names FROM supplier")
def json_lines_round_trip(spark, sf):
    """Rows as JSON lines, NaN as null and nulls kept, read back."""
    at = _folder(spark, "jsonl")
    v = F.when(F.col("s_suppkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    rows = without_nan(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), v.alias("v"), F.array("s_name", F.lit("x")).alias("names")))
    write_json_lines(rows, at)
    return spark.read.schema(rows.schema).json(at)


@query("""SELECT c_mktsegment AS entity, 'P' || (c_nationkey % 3)::VARCHAR AS period, count(*) AS rows FROM customer GROUP BY ALL""")
def stored_objects(spark, sf):
    """A table written by entity and period, and what a listing of its objects tells without reading them."""
    at = _folder(spark, "objects")
    rows = table(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"]).select("c_custkey", F.col("c_mktsegment").alias("e"), F.concat(F.lit("P"), (F.col("c_nationkey") % 3).cast("string")).alias("p"))
    rows.write.partitionBy("e", "p").parquet(at)
    listed = feeds.listing(spark, at).select(F.regexp_replace("entity", "^e=", "").alias("entity"), F.regexp_replace("period", "^p=", "").alias("period")).distinct()
    return listed.join(rows.groupBy(F.col("e").alias("entity"), F.col("p").alias("period")).agg(F.count("*").alias("rows")), ["entity", "period"])


@query("""SELECT o_orderkey::VARCHAR AS external_id, concat('http://h', (o_custkey % 7)::VARCHAR, '.example/', o_orderkey::VARCHAR) AS link, NOT (o_orderpriority = '5-LOW') OR o_orderstatus = 'F' AS relevant FROM orders WHERE o_custkey % 7 <> 3""")
def press_items(spark, sf):
    """Feeds of items written as XML and read back: canonical links, relevance by three patterns, hosts that are read directly left out."""
    at = _folder(spark, "feed")
    body = F.concat(F.lit("about rates "), F.when(F.col("o_orderpriority") == "5-LOW", "and football").otherwise("only"), F.when(F.col("o_orderstatus") == "F", " by the board").otherwise(""))
    link = F.concat(F.lit("http://h"), (F.col("o_custkey") % 7).cast("string"), F.lit(".example/"), F.col("o_orderkey").cast("string"), F.lit("/?utm=1#top"))
    items = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("guid"), link.alias("link"), F.lit("item").alias("title"), body.alias("description"))
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(at)
    got = feeds.news_items(spark, at, "rates", "board", "football")
    followed = spark.createDataFrame([("h3.example",)], "host string")
    return feeds.without_followed_hosts(got, followed).select("external_id", "link", "relevant")


@query("""SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST, l_partkey NULLS FIRST, l_quantity NULLS FIRST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST) - 1 AS row, l_linenumber::VARCHAR AS line, trim(concat(l_returnflag, ' & ', l_linestatus)) AS flags FROM lineitem""")
def page_tables(spark, sf):
    """Cells of tables in pages, entities decoded, back as rows.

    Lines of an order are in the order of all that tells them apart, nulls first; a missing flag is left out of its cell.
    """
    none = F.lit("")
    row = F.concat(F.lit("<tr><td>"), F.coalesce(F.col("l_linenumber").cast("string"), none), F.lit("</td><td>"), F.coalesce("l_returnflag", none), F.lit(" &amp; "), F.coalesce("l_linestatus", none), F.lit("</td></tr>"))
    order = ["l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus"]
    lines = table(spark, sf, "lineitem", ["l_orderkey", *order])
    cells = F.transform(F.sort_array(F.collect_list(F.struct(*order, row.alias("r")))), lambda x: x["r"])
    pages = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.concat(F.lit("<p>Rates</p><table>"), F.array_join(cells, ""), F.lit("</table>")).alias("html"))
    got = feeds.html_cells(pages, ["k"], "html")
    line = F.nullif(F.max(F.when(F.col("col") == 0, F.col("cell"))), none)
    return got.groupBy("k", F.col("row").cast("bigint").alias("row")).agg(line.alias("line"), F.max(F.when(F.col("col") == 1, F.col("cell"))).alias("flags"))


@query(f"WITH {FACTS}, a AS (SELECT * FROM (VALUES ('MS.SQ.Q.003.2', 0), ('MS.SQ.Q.001.1', 1), ('MS.SQ.Q.999.1', 2)) t(series_code, pos)) SELECT a.series_code, pos, item, e AS end_date FROM a LEFT JOIN cat USING (series_code)")
def series_lookup(spark, sf):
    """Catalogue rows in the order asked for; an unknown code comes back empty."""
    cat = catalog.build(_facts(spark, sf), "SQ", "Q", "g")
    return catalog.lookup(cat, ["MS.SQ.Q.003.2", "MS.SQ.Q.001.1", "MS.SQ.Q.999.1"]).select("series_code", "pos", "item", "end_date")


@query(f"WITH {FACTS} SELECT series_code, item, (SELECT count(*) FROM cat WHERE item = 'stock') AS total FROM cat WHERE item = 'stock' ORDER BY series_code LIMIT 10 OFFSET 10")
def series_page(spark, sf):
    """The second page of ten of the series whose item holds a term, and how many there are."""
    rows, n = catalog.search(catalog.build(_facts(spark, sf), "SQ", "Q", "g"), "STOC", 1, 10)
    return rows.select("series_code", "item", F.lit(n).cast("bigint").alias("total"))


@query(f"""WITH {DAILY}, a AS (SELECT d, sum(v::DECIMAL(38,6))::DOUBLE AS v FROM daily GROUP BY d), l AS (SELECT max(d) AS d FROM a WHERE d::VARCHAR LIKE '1997-03%') SELECT 'all' AS series, '1997-03' AS date, round(v, 2) AS got, v >= 0 AND v <= 1e9 AS near FROM a JOIN l USING (d) UNION ALL SELECT 'millions', '1997-03', round(v * 1e-6, 2), false FROM a JOIN l USING (d)""")
def spec_checks(spark, sf):
    """Assertions of a spec about its series, one near enough and one not."""
    spec = {**SPEC, "verify": [{"series": "all", "date": "1997-03", "value": 5e8, "tolerance": 100, "tolerance_unit": "percent"}, {"series": "millions", "date": "1997-03", "value": -7, "tolerance": 0.5}]}
    at = daily_orders(spark, sf)
    done = dsl.resolve(spec, {g: at.where(F.col("g") == g) for g in "FOP"})
    return dsl.check_rows(spec, done).select("series", "date", F.round("got", 2).alias("got"), "near")


@query("SELECT DISTINCT o_custkey AS g FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def emptied_partitions(spark, sf):
    """Partitions of the log of which the table has nothing left."""
    orders = table(spark, sf, "orders", ["o_custkey", "o_orderpriority"]).withColumnRenamed("o_custkey", "g")
    return K.emptied(orders, orders.where("o_orderpriority = '5-LOW'"), ["g"])


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'new' ELSE 'changed' END AS status FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 = 0""")
def refetch_changes(spark, sf):
    """What a second fetch of an overlapping window changes; rows that are gone from it don't count."""
    at = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("stamp"))
    new = at.withColumn("v", F.when(F.col("k") % 10 == 0, F.col("v") + 1).otherwise(F.col("v"))).withColumn("stamp", F.current_timestamp())
    return W.day_changes(at.where("k % 9 != 0"), new, ["k"], ("stamp",))


@query("""SELECT doc_id AS k, length(text) AS n FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND NOT (doc_id % 2 = 0 AND length(text) > 200)""")
def shrunk_texts(spark, sf):
    """New texts but those that shrank by over a tenth and a hundred characters."""
    old = table(spark, sf, "documents", ["doc_id", "text"]).where("doc_id is not null and text is not null").select(F.col("doc_id").alias("k"), "text")
    new = old.withColumn("text", F.when((F.col("k") % 2 == 0) & (F.length("text") > 200), F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))).otherwise(F.col("text")))
    return K.shrink_guard(old, new, ["k"], "text").select("k", F.length("text").cast("bigint").alias("n"))


@query("""WITH n(source, name, code) AS (VALUES ('monthly', 'late', 'F'), ('monthly', 'open', 'O'), ('weekly', 'late', 'P'), ('weekly', 'open', 'F')) SELECT source, name, code, count(*) AS n FROM n JOIN orders ON o_orderstatus = code GROUP BY ALL""")
def named_groups(spark, sf):
    """Names of groups resolved to codes; the namespaces of two sources differ."""
    names = spark.createDataFrame([("monthly", "late", "F"), ("monthly", "open", "O"), ("weekly", "late", "P"), ("weekly", "open", "F")], "source string, name string, code string")
    n = table(spark, sf, "orders", ["o_orderstatus"]).groupBy(F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(names), "code").select("source", "name", "code", "n")


@query(f"""WITH {MONTHLY}, s AS (SELECT g, arg_max(v, y * 12 + m) AS v FROM monthly GROUP BY g), p(preset, growth, cost) AS (VALUES ('low', 0.02, 0.14), ('base', 0.06, 0.12), ('high', 0.1, 0.1)) SELECT g, preset, round(v * pow(1 + growth, 5), 2) AS book, round(v * (growth / cost), 2) AS value FROM s CROSS JOIN p""")
def scenario_presets(spark, sf):
    """Each entity under three sets of assumptions; the sets are a list of the caller."""
    last = monthly_orders(spark, sf).groupBy("g").agg(F.max_by("v", F.col("y") * 12 + F.col("m")).alias("v"))
    presets = F.array(*(F.struct(F.lit(n).alias("preset"), F.lit(g).alias("growth"), F.lit(c).alias("cost")) for n, g, c in (("low", 0.02, 0.14), ("base", 0.06, 0.12), ("high", 0.1, 0.1))))
    return last.select("g", "v", F.inline(presets)).select("g", "preset", F.round(F.col("v") * F.pow(1 + F.col("growth"), 5), 2).alias("book"), F.round(F.col("v") * (F.col("growth") / F.col("cost")), 2).alias("value"))


@query("""WITH b AS (SELECT o_orderkey AS k, o_custkey % 900 AS no, o_orderdate::DATE AS d, o_orderstatus = 'F' AS gone, o_orderpriority = '1-URGENT' AS says FROM orders) SELECT k, no::INT AS number, d AS decided, CASE WHEN gone THEN 'terminated' WHEN says THEN 'changed' ELSE 'unread' END AS state FROM b""")
def rule_watch(spark, sf):
    """Decisions parsed out of titles, and whether their bodies end a rule, change one, or are still unread."""
    d = F.col("o_orderdate")
    title = F.concat(F.lit("Board decision no. "), (F.col("o_custkey") % 900).cast("string"), F.lit(" of "), F.date_format(d, "d MMMM yyyy"))
    body = F.when(F.col("o_orderstatus") == "F", "the rule | is repealed").when(F.col("o_orderpriority") == "1-URGENT", "the rate becomes 5%").otherwise("see the annex")
    state = F.when(body.rlike("repealed|abolished|terminated"), "terminated").when(X.rate_in(body).isNotNull(), "changed").otherwise("unread")
    return table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"]).select(F.col("o_orderkey").alias("k"), F.regexp_extract(title, r"no\.\s*(\d+)", 1).cast("int").alias("number"), X.dates_in(title).alias("decided"), state.alias("state"))


@query("""WITH h AS (SELECT o_custkey % 50 AS node, o_orderpriority AS holder, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL), t AS (SELECT o_custkey % 50 AS node, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY 1)
    SELECT node, holder, round(100 * h.v / t.v, 6) AS share FROM h JOIN t USING (node) WHERE h.v > 0 UNION ALL SELECT node, 'free float', round(100 - 100 * coalesce(sum(h.v::DECIMAL(38,6))::DOUBLE, 0) / t.v, 6) FROM t LEFT JOIN h USING (node) GROUP BY node, t.v""")
def holder_graph(spark, sf):
    """Holders of each node by share, and what nobody holds as free float."""
    at = table(spark, sf, "orders", ["o_custkey", "o_orderpriority", "o_totalprice"]).groupBy((F.col("o_custkey") % 50).alias("node"), F.col("o_orderpriority").alias("holder")).agg(F.sum(money("o_totalprice")).cast("double").alias("v"))
    total = at.groupBy("node").agg(P.exact_sum(F.col("v")).cast("double").alias("t"), F.coalesce(P.exact_sum(F.when(F.col("holder") != "5-LOW", F.col("v"))).cast("double"), F.lit(0.0)).alias("held"))
    edges = at.where("holder != '5-LOW' and v > 0").join(total, "node").select("node", "holder", r6(100 * F.col("v") / F.col("t"), "share"))
    return edges.unionByName(total.select("node", F.lit("free float").alias("holder"), r6(100 - 100 * F.col("held") / F.col("t"), "share")))


@query(f"""WITH {WEEKLY}, w AS (SELECT d, max(v) FILTER (g = 'F') AS f, max(v) FILTER (g = 'O') AS o, max(v) FILTER (g = 'P') AS p FROM weekly GROUP BY d) SELECT d, round(100 * coalesce(f, 0) / (coalesce(f, 0) + coalesce(o, 0) + coalesce(p, 0)), 6) AS fixed, round(100 * coalesce(p, 0) / (coalesce(f, 0) + coalesce(o, 0) + coalesce(p, 0)), 6) AS foreign_part FROM w""")
def reserve_ratios(spark, sf):
    """Parts of a weekly whole; a part that isn't there is nothing."""
    wide = table(spark, sf, "orders", ["o_orderstatus", "o_orderdate", "o_totalprice"]).groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("d")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum(money("o_totalprice")).cast("double"))
    f, o, p = (F.coalesce(c, F.lit(0.0)) for c in ("F", "O", "P"))
    return wide.select("d", r6(100 * f / (f + o + p), "fixed"), r6(100 * p / (f + o + p), "foreign_part"))


@query(f"""WITH {MONTHLY}, {ORD} SELECT o, round(max(v) FILTER (g = 'BUILDING'), 2) AS building, round(max(v) FILTER (g = 'MACHINERY'), 2) AS machinery, count(*) AS types, round(sum(v::DECIMAL(38,6))::DOUBLE, 2) AS total FROM t GROUP BY o""")
def type_trend(spark, sf):
    """Types as columns over months, with their number and sum."""
    at = _ord(spark, sf)
    part = lambda g: F.round(F.max(F.when(F.col("g") == g, F.col("v"))), 2)
    return at.groupBy("o").agg(part("BUILDING").alias("building"), part("MACHINERY").alias("machinery"), F.count("*").alias("types"), F.round(P.exact_sum(F.col("v")).cast("double"), 2).alias("total"))


@query(f"""WITH {DAILY}, w AS (SELECT g, min(d) AS a, max(d) AS z, arg_min(v, d) AS first, arg_max(v, d) AS last, min(v) AS low, max(v) AS high FROM daily GROUP BY g) SELECT concat(g, ': ', first::DECIMAL(18,0)::VARCHAR, ' to ', last::DECIMAL(18,0)::VARCHAR, ' (', low::DECIMAL(18,0)::VARCHAR, '-', high::DECIMAL(18,0)::VARCHAR, ')') AS summary FROM w""")
def chart_summary(spark, sf):
    """One sentence for each column of a chart: first, last and range."""
    got = B.finding(daily_orders(spark, sf).withColumn("n", F.datediff("d", F.lit("1970-01-01"))), ["g"], "n", "v", 1_000_000)
    whole = lambda c: F.col(c).cast("decimal(18,0)").cast("string")
    return got.select(F.concat("g", F.lit(": "), whole("first"), F.lit(" to "), whole("last"), F.lit(" ("), whole("low"), F.lit("-"), whole("high"), F.lit(")")).alias("summary"))


TEMPLATE = list(range(1, 11))


@query("""WITH t AS (SELECT unnest(range(1, 11))::INT AS line), g AS (SELECT DISTINCT l_suppkey AS g FROM lineitem), v AS (SELECT l_suppkey AS g, l_linenumber AS line, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY ALL) SELECT g, line, round(v, 2) AS v, v IS NULL AS missing FROM g CROSS JOIN t LEFT JOIN v USING (g, line)""")
def wide_template(spark, sf):
    """Every line of a form for each entity, those that it didn't fill as missing."""
    at = table(spark, sf, "lineitem", ["l_suppkey", "l_linenumber", "l_extendedprice"]).groupBy(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("line")).agg(F.sum(money("l_extendedprice")).cast("double").alias("v"))
    form = at.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("line", "v"))).alias("m"))
    line = F.explode(F.array(*map(F.lit, TEMPLATE))).alias("line")
    return form.select("g", "m", line).select("g", "line", F.round(F.try_element_at("m", F.col("line")), 2).alias("v"), F.try_element_at("m", F.col("line")).isNull().alias("missing"))


@query(f"""WITH l AS (SELECT l_suppkey AS g, l_returnflag || l_linestatus AS line, l_shipdate, l_orderkey, l_linenumber, l_quantity FROM lineitem) SELECT g, line, count(*) AS n, max(l_shipdate)::DATE AS last FROM l GROUP BY ALL""")
def line_names(spark, sf):
    """The lines that an entity has ever filed, and when last."""
    return table(spark, sf, "lineitem", ["l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"]).groupBy(F.col("l_suppkey").alias("g"), F.concat("l_returnflag", "l_linestatus").alias("line")).agg(F.count("*").alias("n"), F.to_date(F.max("l_shipdate")).alias("last"))


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'settled' END AS family, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1""")
def population_pins(spark, sf):
    """The sum of each family of codes, by a statement that keeps to the family; the statement over all codes is refused."""
    from . import gateway

    orders = table(spark, sf, "orders", ["o_orderstatus", "o_totalprice"])
    codes = [r[0] for r in orders.select("o_orderstatus").distinct().limit(gateway.ROW_CAP).collect()]  # a handful
    families = {c: "partial" if c == "P" else "settled" for c in codes}
    orders.createOrReplaceTempView("pin_orders")
    policy = gateway.Policy(frozenset({"pin_orders"}), {"o_orderstatus": families}, frozenset({"o_orderstatus"}))
    asked = "SELECT '{0}' AS family, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM pin_orders WHERE {1}"
    if not gateway.ask(spark, asked.format("all", "o_totalprice > 0"), policy).reason:
        raise ValueError("a sum over all codes was let through")
    out = None
    for family in sorted(set(families.values())):
        own = sorted(c for c in codes if families[c] == family)
        sql = asked.format(family, "o_orderstatus IN (" + ", ".join(f"'{c}'" for c in own) + ")")
        got = gateway.ask(spark, sql, policy, " ".join(own))
        if got.reason:
            raise ValueError(f"{got.reason}: {sql}")
        out = got.rows if out is None else out.unionByName(got.rows)
    spark.catalog.dropTempView("pin_orders")
    return out


@query(f"""WITH {MONTHLY}, a AS (SELECT y, m, sum(v::DECIMAL(38,6))::DOUBLE AS v FROM monthly GROUP BY ALL) SELECT x.y, x.m, round(100 * (x.v - z.v) / z.v, 4) AS yearly, CASE WHEN x.v > z.v THEN 'grew' ELSE 'shrank' END AS read FROM a x JOIN a z ON z.y = x.y - 1 AND z.m = x.m""")
def macro_reads(spark, sf):
    """A takeaway for each month from its growth on the year before."""
    a = monthly_orders(spark, sf).groupBy("y", "m").agg(P.exact_sum(F.col("v")).cast("double").alias("v"))
    both = a.join(a.select((F.col("y") + 1).alias("y"), "m", F.col("v").alias("was")), ["y", "m"])
    return both.select("y", "m", F.round(100 * (F.col("v") - F.col("was")) / F.col("was"), 4).alias("yearly"), F.when(F.col("v") > F.col("was"), "grew").otherwise("shrank").alias("read"))


@query(f"""WITH {SUPPLIER}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o DESC) AS k FROM sq), x AS (SELECT g, o, flow, stock, qty FROM n WHERE k = 1) SELECT g, o, round(100 * stock / (flow + stock + qty), 6) AS first_stage, round(100 * flow / (flow + stock + qty), 6) AS second_stage, round(100 * qty / (flow + stock + qty), 6) AS third_stage FROM x""")
def stages_latest(spark, sf):
    """The split of an entity's book at its last period."""
    last = P.latest(supplier_quarters(spark, sf), ["g"], ["o"], ["o", "flow", "stock", "qty"])
    whole = F.col("flow") + F.col("stock") + F.col("qty")
    return last.select("g", "o", *(r6(100 * F.col(c) / whole, n) for c, n in (("stock", "first_stage"), ("flow", "second_stage"), ("qty", "third_stage"))))


@query(f"""WITH {SUPPLIER}, r AS (SELECT a.g, a.o, 100 * (a.flow - b.flow) / b.flow AS n FROM sq a JOIN sq b ON b.g = a.g AND b.o = a.o - 4 WHERE b.flow > 0), p AS (SELECT o, sum(flow::DECIMAL(38,6))::DOUBLE / sum(qty::DECIMAL(38,6))::DOUBLE AS p FROM sq GROUP BY o), i AS (SELECT a.o, 100 * (a.p - b.p) / b.p AS i FROM p a JOIN p b ON b.o = a.o - 4)
    SELECT g, r.o, round(((1 + n / 100) / (1 + i / 100) - 1) * 100, 4) AS real, CASE WHEN n > i THEN 'real growth' ELSE 'inflation only' END AS read FROM r JOIN i USING (o)""")
def real_growth_reads(spark, sf):
    """An entity's growth with that quarter's inflation taken out, and what it reads as."""
    from ..operators import series as S

    at = supplier_quarters(spark, sf)
    back = lambda n: F.max("flow").over(Window.partitionBy("g").orderBy("o").rangeBetween(-n, -n))
    growth = at.withColumn("was", back(4)).where("was > 0").select("g", "o", (100 * (F.col("flow") - F.col("was")) / F.col("was")).alias("n"))
    level = at.groupBy("o").agg((P.exact_sum(F.col("flow")).cast("double") / P.exact_sum(F.col("qty")).cast("double")).alias("p"))
    prices = level.join(level.select((F.col("o") + 4).alias("o"), F.col("p").alias("was")), "o").select("o", (100 * (F.col("p") - F.col("was")) / F.col("was")).alias("i"))
    return growth.join(prices, "o").select("g", "o", F.round(S.fisher(F.col("n"), F.col("i")), 4).alias("real"), F.when(F.col("n") > F.col("i"), "real growth").otherwise("inflation only").alias("read"))


@query("""SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 250000""")
def bound_scan(spark, sf):
    """A statement with bound values and a column from an allow-list."""
    table(spark, sf, "orders").createOrReplaceTempView("scan_orders")
    sql = "SELECT o_orderkey AS k, {who} AS c, o_orderstatus AS s FROM scan_orders WHERE o_orderstatus = :status AND o_totalprice >= :least"
    return feeds.scan(spark, sql, {"status": "F", "least": 250000}, {"who": "o_custkey"}, frozenset({"o_custkey"}))


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN 'rating raised' WHEN p_size % 5 = 1 THEN 'rating affirmed' WHEN p_size % 5 = 2 THEN 'new issue abroad' WHEN p_size % 5 = 3 THEN 'results' ELSE 'notice' END AS gloss, CASE WHEN p_size % 2 = 0 THEN 'Alpha' END AS agency FROM part""")
def event_glosses(spark, sf):
    """Notices in plain words by ordered phrase rules, and the agency that they name."""
    words = F.element_at(F.array(*map(F.lit, ("the rating was upgraded", "the rating was affirmed", "debt issued in foreign markets", "quarterly results", "general assembly"))), (F.col("p_size") % 5 + 1).cast("int"))
    text = F.concat(words, F.when(F.col("p_size") % 2 == 0, " by Alpha Ratings").otherwise(""))
    gloss = X.first_rule(text, [("rating raised", "upgrade"), ("rating affirmed", "affirm"), ("new issue abroad", "issued.*foreign"), ("results", "results")], "notice")
    return table(spark, sf, "part", ["p_partkey", "p_size"]).select(F.col("p_partkey").alias("k"), gloss.alias("gloss"), F.nullif(F.regexp_extract(text, r"by (\w+) Ratings", 1), F.lit("")).alias("agency"))
