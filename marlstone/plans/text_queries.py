"""Parsers, names, dates and guards of answers over texts that the tables' columns make up."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import money, table
from .registry import query
from .series_queries import r6


@query("""SELECT p_partkey AS k, p_type LIKE 'X%' OR regexp_matches(label, '^[IVXLCDM]+\\.') AS numbered, length(p_name) < 9 AS short, p_partkey % 3 = 0 OR length(p_name) < 9 AS missing
    FROM (SELECT *, concat(CASE p_size % 4 WHEN 0 THEN 'IV. ' WHEN 1 THEN 'II.1 ' WHEN 2 THEN 'IQ. ' ELSE '' END, p_name) AS label FROM part)""")
def label_filters(spark, sf):
    """Labels under Roman numerals, and names that are null or short."""
    label = F.concat(F.element_at(F.array(*map(F.lit, ("IV. ", "II.1 ", "IQ. ", ""))), (F.col("p_size") % 4 + 1).cast("int")), "p_name")
    name = F.when(F.col("p_partkey") % 3 != 0, F.col("p_name"))
    return table(spark, sf, "part", ["p_partkey", "p_name", "p_type", "p_size"]).select(F.col("p_partkey").alias("k"), (F.startswith("p_type", F.lit("X")) | X.matches_numeral(label)).alias("numbered"), (F.length("p_name") < 9).alias("short"), X.missing_body(name, 9).alias("missing"))


@query("""SELECT s_suppkey AS k, concat(upper(replace(s_name, '#', ' ')), ' ', replace(upper(n_name), '_', ' ')) AS key, s_name AS prefix, concat(n_name, ' Supplier') AS short, n_name LIKE 'NATION_1_' AS offshore
    FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def names_normalised(spark, sf):
    """Holders' keys without case, punctuation and legal suffixes; what stands before a keyword; short names; a flag by name."""
    rows = table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_nationkey"]).join(F.broadcast(table(spark, sf, "nation", ["n_nationkey", "n_name"])), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat("s_name", F.lit(", "), "n_name", F.lit(" AŞ, Ltd."))
    long = F.concat_ws(" ", "n_name", F.lit("Supplier"), "s_name", F.lit("Fund Managers"))
    return rows.select(F.col("s_suppkey").alias("k"), X.legal_key(name).alias("key"), X.before_keyword(F.concat("s_name", F.lit(" Portfolio Fund")), "Portfolio").alias("prefix"), X.short_name(long).alias("short"), F.col("n_name").rlike(r"^NATION_1\d$").alias("offshore"))


@query("""SELECT o_orderkey AS k, o_orderdate::DATE AS bound, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN date_trunc('month', o_orderdate)::DATE WHEN 3 THEN date_trunc('quarter', o_orderdate)::DATE END AS stamp FROM orders""")
def dates_from_text(spark, sf):
    """Dates written out, and stamps in four forms; a fifth form is none."""
    d = F.col("o_orderdate")
    body = F.concat(F.lit("It takes effect on "), F.date_format(d, "d MMMM yyyy"), F.lit(" at 09:00."))
    quarter = F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))
    forms = F.array(F.date_format(d, "dd-MM-yyyy"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy-M"), quarter, F.lit("soon"))
    return table(spark, sf, "orders", ["o_orderkey", "o_orderdate"]).select(F.col("o_orderkey").alias("k"), X.dates_in(body).alias("bound"), X.period_date(F.element_at(forms, (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("stamp"))


@query("""SELECT doc_id AS k, length(text) AS n, true AS same FROM documents WHERE text IS NOT NULL""")
def misread_repaired(spark, sf):
    """Texts whose letters were read twice in the wrong encoding, and are put right again."""
    rows = table(spark, sf, "documents", ["doc_id", "text"]).where("text is not null")
    broken = F.col("text")
    for letter in X._BROKEN:
        broken = F.replace(broken, F.lit(letter), F.lit(X.misread(letter)))
    return rows.select(F.col("doc_id").alias("k"), F.length("text").cast("bigint").alias("n"), (X.repair_misread(broken) == F.col("text")).alias("same"))


@query("""WITH t AS (SELECT o_orderkey AS k, concat('order ', o_orderkey::VARCHAR) AS s, round(o_totalprice - 150000, 2) AS d, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice / 1000) END AS v FROM orders)
    SELECT k, printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)) AS id,
      CASE WHEN v IS NULL THEN '—' ELSE format('+{:d}.0', v::BIGINT) END AS shown, CASE WHEN abs(d) < 1000 THEN 'flat' WHEN abs(d) >= 100000 THEN concat('strongly ', CASE WHEN d > 0 THEN 'up' ELSE 'down' END) WHEN d > 0 THEN 'up' ELSE 'down' END AS way,
      concat((k % 130)::VARCHAR, CASE WHEN k % 130 % 100 BETWEEN 11 AND 13 THEN 'th' WHEN k % 130 % 10 = 1 THEN 'st' WHEN k % 130 % 10 = 2 THEN 'nd' WHEN k % 130 % 10 = 3 THEN 'rd' ELSE 'th' END) AS place FROM t""")
def figures_worded(spark, sf):
    """Ids of evidence, signed figures, directions by bands, ordinals."""
    k, d = F.col("o_orderkey"), F.round(F.col("o_totalprice") - 150000, 2)
    v = F.when(k % 7 != 0, F.round(F.col("o_totalprice") / 1000))
    return table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).select(k.alias("k"), X.fnv1a(F.concat(F.lit("order "), k.cast("string"))).alias("id"), F.replace(X.signed(v), F.lit(","), F.lit("")).alias("shown"), X.direction(d, 1000, 100000).alias("way"), X.ordinal(k % 130).alias("place"))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, round(l_discount * 100) AS rate, round(l_tax * 100) / 2 AS forecast, CASE WHEN l_quantity >= 40 THEN l_quantity * 1000 / 100 ELSE l_quantity END AS percent,
    CASE WHEN l_extendedprice = floor(l_extendedprice) THEN 0 WHEN round(l_extendedprice * 10, 4) = floor(round(l_extendedprice * 10, 4)) THEN 1 ELSE 2 END AS digits FROM lineitem""")
def rates_parsed(spark, sf):
    """Rates and forecasts out of phrases, percentages that lost their point, decimals of amounts."""
    body = F.concat(F.lit("the policy rate is set at "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(" percent, from 3 before"))
    seen = F.concat(F.lit("~ "), (F.round(F.col("l_tax") * 100) / 2).cast("string"), F.lit("% (avg)"))
    value = F.when(F.col("l_quantity") >= 40, F.col("l_quantity") * 1000).otherwise(F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), X.rate_in(body).alias("rate"), X.forecast(seen).alias("forecast"), X.repair_percent(F.array(value))[0].alias("percent"), X.fraction_digits(F.col("l_extendedprice")).alias("digits"))


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'million' WHEN s_suppkey % 4 = 1 THEN 'thousand' WHEN s_suppkey % 4 = 2 THEN 'million' ELSE 'unknown' END AS unit, s_suppkey % 5 = 0 OR s_suppkey % 7 = 3 AS misread FROM supplier""")
def units_named(spark, sf):
    """Units from page texts: a transition note, all pages, most pages, none; and amounts whose separator was misread."""
    k = F.col("s_suppkey")
    thousand, million, none = "in thousand lira", "in million lira", "no unit here"
    sets = ((thousand, million + ", restated in million"), (thousand, thousand), (million, thousand, million), (thousand, million, none))
    pages = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in sets)), (k % 4 + 1).cast("int"))
    amount = F.when(k % 5 == 0, F.lit(12.345)).when(k % 7 == 3, F.lit(123456.7)).otherwise(F.lit(12.34))
    return table(spark, sf, "supplier", ["s_suppkey"]).select(k.alias("k"), X.unit_in(pages, [("thousand", "in thousand"), ("million", "in million")]).alias("unit"), X.misread_separator(amount).alias("misread"))


@query("""SELECT l_orderkey AS k, count(*) AS n, sum(l_linenumber)::BIGINT AS lines, min(l_returnflag) AS first_flag FROM lineitem GROUP BY 1""")
def pipe_tables(spark, sf):
    """Tables drawn with pipes, read back as rows of cells."""
    line = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" | "), "l_returnflag", F.lit(" |"))
    drawn = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"]).groupBy(F.col("l_orderkey").alias("k")).agg(F.concat_ws("\n", F.lit("Rules changed:"), F.lit("|---|---|"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("body"))
    rows = drawn.withColumn("r", X.pipe_rows(F.col("body")))
    return rows.select("k", F.size("r").cast("bigint").alias("n"), F.aggregate("r", F.lit(0).cast("bigint"), lambda a, x: a + x[0].cast("bigint")).alias("lines"), F.array_min(F.transform("r", lambda x: x[1])).alias("first_flag"))


RULES = [("profanity", r"(?i)\b(idiot|stupid|damn)"), ("contact", r"@|\d{3}-\d{4}"), ("legal", r"(?i)license|copyright|warranty"), ("figures", r"\d")]


@query("""SELECT doc_id AS k, CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(lead, '(?i)\\b(idiot|stupid|damn)') THEN 'profanity' WHEN regexp_matches(lead, '@|\\d{3}-\\d{4}') THEN 'contact' WHEN regexp_matches(lead, '(?i)license|copyright|warranty') THEN 'legal' WHEN regexp_matches(lead, '\\d') THEN 'figures' ELSE 'other' END AS class
    FROM (SELECT doc_id, text, substr(text, 1, 800) AS lead FROM documents)""")
def lead_classes(spark, sf):
    """Reports classed by ordered rules over their first 800 characters, which is what the rule reads."""
    return table(spark, sf, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("k"), X.first_rule(F.substring("text", 1, 800), RULES).alias("class"))


@query("""WITH c AS (SELECT conv_id AS k, count(*) AS n, min(turn) AS a, max(turn) AS b, count(DISTINCT turn) AS d, arg_min(role, turn) AS first, bool_or(role = 'assistant') AS answered FROM conversations GROUP BY 1)
    SELECT k, b - a + 1 = n AND d = n AS contiguous, first, coalesce(answered, false) AS answered, CASE WHEN b - a + 1 = n AND d = n AND answered THEN 'pass' ELSE 'fail' END AS verdict FROM c""")
def prose_sections(spark, sf):
    """Sections must be contiguous and hold the required role."""
    got = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("k")).agg(F.count("*").alias("n"), (F.max("turn") - F.min("turn") + 1).alias("span"), F.countDistinct("turn").alias("d"), F.min_by("role", "turn").alias("first"), F.coalesce(F.bool_or(F.col("role") == "assistant"), F.lit(False)).alias("answered"))
    whole = (F.col("span") == F.col("n")) & (F.col("d") == F.col("n"))
    return got.select("k", whole.alias("contiguous"), "first", "answered", F.when(whole & F.col("answered"), "pass").otherwise("fail").alias("verdict"))


@query("""SELECT o_orderkey AS k, concat(year(q)::VARCHAR, 'Q', quarter(q)::VARCHAR) AS period, lag FROM (SELECT o_orderkey, (date_trunc('quarter', o_orderdate)::DATE - 1)::DATE AS q, date_diff('day', (date_trunc('quarter', o_orderdate)::DATE - 1)::DATE, o_orderdate::DATE) AS lag FROM orders)""")
def notice_periods(spark, sf):
    """The quarter that a notice reports on: the last that ended before it; and the days since."""
    end = F.date_sub(F.to_date(F.date_trunc("quarter", "o_orderdate")), 1)
    return table(spark, sf, "orders", ["o_orderkey", "o_orderdate"]).select(F.col("o_orderkey").alias("k"), F.concat(F.year(end).cast("string"), F.lit("Q"), F.quarter(end).cast("string")).alias("period"), F.datediff(F.to_date("o_orderdate"), end).cast("bigint").alias("lag"))


@query("""WITH s AS (SELECT l_orderkey AS k, min(l_shipdate)::DATE AS ship FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey AS k, date_diff('day', o_orderdate::DATE, ship) AS lag, o_orderpriority AS p FROM orders JOIN s ON s.k = o_orderkey)
    SELECT k, lag, lag > 60 AS late FROM t""")
def decision_lags(spark, sf):
    """Days from a decision to its publication."""
    ship = table(spark, sf, "lineitem", ["l_orderkey", "l_shipdate"]).groupBy(F.col("l_orderkey").alias("k")).agg(F.to_date(F.min("l_shipdate")).alias("ship"))
    lag = F.datediff("ship", F.to_date("o_orderdate")).cast("bigint")
    return table(spark, sf, "orders", ["o_orderkey", "o_orderdate"]).join(ship, F.col("o_orderkey") == F.col("k")).select("k", lag.alias("lag"), (lag > 60).alias("late"))


@query("""SELECT o_orderkey AS k, concat('SELECT ', o_orderstatus, ' FROM t') AS fenced, concat('WITH x AS (SELECT 1) SELECT ', o_orderkey::VARCHAR) AS bare, NULL::VARCHAR AS none FROM orders""")
def sql_replies(spark, sf):
    """Statements out of replies: fenced, bare, or none."""
    sql = F.concat(F.lit("SELECT "), "o_orderstatus", F.lit(" FROM t"))
    fenced = F.concat(F.lit("I would ask select nothing:\n```sql\n"), sql, F.lit("\n```\nand so on"))
    bare = F.concat(F.lit("Try this: WITH x AS (SELECT 1) SELECT "), F.col("o_orderkey").cast("string"), F.lit("; that's all"))
    return table(spark, sf, "orders", ["o_orderkey", "o_orderstatus"]).select(F.col("o_orderkey").alias("k"), X.sql_in(fenced).alias("fenced"), X.sql_in(bare).alias("bare"), X.sql_in(F.lit("I can't tell")).alias("none"))


@query("""WITH n AS (SELECT n_regionkey AS r, n_name AS label, sum(s_acctbal::DECIMAL(18,2))::BIGINT AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY v DESC, label) AS i FROM n)
    SELECT r, string_agg(concat(i::VARCHAR, '. ', label, ': ', v::VARCHAR), chr(10) ORDER BY i) AS list, r % 2 = 0 AS replaced FROM k WHERE i <= 5 GROUP BY r""")
def ranked_lists(spark, sf):
    """Rows as a ranked list of at most five; it replaces a typed list that names at least half of its labels."""
    rows = table(spark, sf, "supplier", ["s_nationkey", "s_acctbal"]).join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    sums = rows.groupBy(F.col("n_regionkey").alias("r"), F.col("n_name").alias("label")).agg(F.round(F.sum(money("s_acctbal"))).cast("bigint").alias("v"))
    top = sums.withColumn("i", F.row_number().over(Window.partitionBy("r").orderBy(F.col("v").desc(), "label"))).where("i <= 5")
    got = top.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("i", "label", "v"))).alias("rows"))
    line = lambda x: F.concat_ws("", x["i"].cast("string"), F.lit(". "), x["label"], F.lit(": "), x["v"].cast("string"))
    typed = F.when(F.col("r") % 2 == 0, F.transform("rows", lambda x: x["label"])).otherwise(F.array(F.lit("Elsewhere")))
    shared = F.size(F.array_intersect(typed, F.transform("rows", lambda x: x["label"])))
    return got.select("r", F.array_join(F.transform("rows", line), "\n").alias("list"), (2 * shared >= F.size("rows")).alias("replaced"))


@query("""SELECT s_suppkey AS k, s_suppkey % 6 = 0 AS unsupported, s_suppkey % 4 = 1 AS contradicted FROM supplier""")
def answer_guards(spark, sf):
    """Figures with a unit that the data doesn't hold within half a percent, and comparisons that their own figures contradict."""
    k = F.col("s_suppkey")
    told = F.round(F.lit(200) + k % 700 + F.when(k % 6 == 0, F.lit(37)).otherwise(0)).cast("int")
    answer = F.concat(F.lit("Assets reached "), told.cast("string"), F.lit(" mn, and "), F.when(k % 4 == 1, F.lit("3.5 above 9")).otherwise(F.lit("9 above 3.5")), F.lit(" in the year."))
    figure = F.regexp_extract(answer, r"(\d+(?:\.\d+)?) mn", 1).cast("double") * 1e6
    data = F.array((F.lit(200) + k % 700) * 1e6, F.lit(1.0))
    held = F.exists(data, lambda x: F.abs(figure - x) <= 0.005 * F.abs(x))
    wrong = F.exists(X.comparisons(answer), lambda c: F.when(c["way"] == "above", c["a"] <= c["b"]).otherwise(c["a"] >= c["b"]))
    return table(spark, sf, "supplier", ["s_suppkey"]).select(k.alias("k"), (~held).alias("unsupported"), wrong.alias("contradicted"))


@query("""WITH b AS (SELECT l_orderkey AS k, list(DISTINCT round(l_discount * 100)::INT) AS body, any_value(NULL) FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), t AS (SELECT l_orderkey AS k, list(DISTINCT round(l_discount * 100)::INT) AS told FROM lineitem GROUP BY 1)
    SELECT t.k, list_has_all(coalesce(body, []), told) AS supported, len(list_filter(told, lambda x: NOT list_contains(coalesce(body, []), x))) AS rejected FROM t LEFT JOIN b ON b.k = t.k""")
def citation_support(spark, sf):
    """Percentages of a bullet that its source's text doesn't hold."""
    lines = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_discount"]).select(F.col("l_orderkey").alias("k"), "l_linenumber", F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("p"))
    text = lambda cond, name: F.concat_ws(" and ", F.collect_list(F.when(cond, F.col("p")))).alias(name)
    both = lines.groupBy("k").agg(text(F.col("l_linenumber") <= 3, "body"), text(F.lit(True), "told"))
    lost = F.array_except(X.percents(F.col("told")), X.percents(F.col("body")))
    return both.select("k", (F.size(lost) == 0).alias("supported"), F.size(lost).cast("bigint").alias("rejected"))


@query("""SELECT o_orderkey AS k, CASE WHEN s IS NULL THEN 'skip' WHEN abs(s - t) <= 0.005 * abs(t) THEN 'pass' ELSE 'fail' END AS verdict, round(s - t, 2) AS gap FROM (SELECT o_orderkey, o_totalprice AS t, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)""")
def reconciliations(spark, sf):
    """An order's total against the sum of its lines, at half a percent."""
    lines = table(spark, sf, "lineitem", ["l_orderkey", "l_extendedprice"]).groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).cast("double").alias("s"))
    both = table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    gap = F.col("s") - F.col("o_totalprice")
    return both.select(F.col("o_orderkey").alias("k"), F.when(gap.isNull(), "skip").when(F.abs(gap) <= 0.005 * F.abs("o_totalprice"), "pass").otherwise("fail").alias("verdict"), F.round(gap, 2).alias("gap"))


@query("""SELECT o_orderpriority AS category, count(DISTINCT o_orderstatus) AS groups, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share, concat((SELECT max(o_orderdate)::DATE::VARCHAR FROM orders), ':', (SELECT count(*)::VARCHAR FROM orders)) AS snapshot FROM orders GROUP BY 1""")
def categories(spark, sf):
    """Groups and rows of each category, under the snapshot's identity (its last stamp and its number of rows)."""
    orders = table(spark, sf, "orders", ["o_orderpriority", "o_orderstatus", "o_orderdate"])
    got = orders.groupBy(F.col("o_orderpriority").alias("category")).agg(F.countDistinct("o_orderstatus").alias("groups"), F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    total = got.agg(F.sum("n").alias("all"), F.to_date(F.max("last")).alias("stamp"))  # one row
    return got.crossJoin(F.broadcast(total)).select("category", "groups", "n", r6(F.col("n") / F.col("all"), "share"), F.concat_ws(":", F.col("stamp").cast("string"), F.col("all").cast("string")).alias("snapshot"))
