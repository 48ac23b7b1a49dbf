"""Statements aligned to templates, headers to bands, flows that balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as L
from ..operators import flows as W
from ..sources.tables import money, table
from .registry import query

TEMPLATES = (
    L.Template("trading", (L.Role("gross", "^A", 1.0, True), L.Role("cost", "^N", 1.0), L.Role("tax", "^R", 1.5, True))),
    L.Template("lending", (L.Role("tax", "^R", 1.5, True), L.Role("gross", "F$", 1.0), L.Role("cost", "O$", 1.0, True))),
)


def _template_sql() -> str:
    """All ways to place three roles in order, and the best of them."""
    tries = []
    for t in TEMPLATES:
        like = {"^A": "label LIKE 'A%'", "^N": "label LIKE 'N%'", "^R": "label LIKE 'R%'", "F$": "label LIKE '%F'", "O$": "label LIKE '%O'"}
        part = lambda r: f"(SELECT k, i FROM l WHERE {like[r.pattern]} UNION ALL SELECT k, NULL FROM (SELECT DISTINCT k FROM l) WHERE {not r.required})"
        a, b, c = t.roles
        score = " + ".join(f"CASE WHEN {x}.i IS NULL THEN 0 ELSE {r.weight} END" for x, r in zip("abc", t.roles, strict=True))
        tries.append(f"""SELECT a.k, '{t.name}' AS template, {score} AS score, [{", ".join(f"'{r.name}=' || {x}.i" for x, r in zip("abc", t.roles, strict=True))}] AS roles, a.i AS i1, b.i AS i2, c.i AS i3 FROM {part(a)} a JOIN {part(b)} b ON a.k = b.k JOIN {part(c)} c ON a.k = c.k
            WHERE (a.i IS NULL OR b.i IS NULL OR a.i < b.i) AND (b.i IS NULL OR c.i IS NULL OR b.i < c.i) AND (a.i IS NULL OR c.i IS NULL OR a.i < c.i)""")
    order = " ".join(f"WHEN '{t.name}' THEN {i}" for i, t in enumerate(TEMPLATES))
    return f"""WITH l AS (SELECT l_orderkey AS k, l_returnflag || l_linestatus AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag || l_linestatus) AS i FROM lineitem), t AS ({" UNION ALL ".join(tries)}),
        b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, CASE template {order} END, i1 NULLS LAST, i2 NULLS LAST, i3 NULLS LAST) = 1)
        SELECT d.k, template, coalesce(score, 0)::DOUBLE AS score, list_sort(list_filter(coalesce(roles, []), lambda x: x IS NOT NULL)) AS roles FROM (SELECT DISTINCT k FROM l) d LEFT JOIN b USING (k)"""


@query(_template_sql())
def template_alignment(spark, sf):
    """The lines of each order, in order, against two templates of roles: which fits best, and which line has which role."""
    label = F.concat("l_returnflag", "l_linestatus")
    lines = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]).groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", label.alias("x")))).alias("l"))
    got = lines.select("k", L.aligned(F.transform("l", lambda x: x["x"]), TEMPLATES).alias("a"))
    roles = F.array_sort(F.transform(F.map_entries("a.roles"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return got.select("k", "a.template", "a.score", roles.alias("roles"))


BANDS = (("<10", "^up to 10$"), ("10-20", "^10 to 20$"), ("20-30", "^20 to 30$"), ("30-40", "^30 to 40$"), (">40", "^over 40$"))


@query("""WITH h AS (SELECT l_orderkey AS k, l_linenumber AS c, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey) AS i FROM lineitem), b AS (SELECT k, i, CASE WHEN q < 10 THEN 1 WHEN q < 20 THEN 2 WHEN q < 30 THEN 3 WHEN q < 40 THEN 4 ELSE 5 END AS b FROM h WHERE i <= 7),
    n AS (SELECT k, max(i) AS cols FROM b GROUP BY k), m AS (SELECT k, mask FROM n, range(1, 128) AS r(mask) WHERE mask < (1 << cols)), s AS (SELECT m.k, mask, count(*) AS named, list(i ORDER BY b) AS places, list(i ORDER BY i) AS in_order, count(DISTINCT b) AS kinds FROM m JOIN b ON b.k = m.k AND (mask >> (i - 1)) & 1 = 1 GROUP BY ALL),
    g AS (SELECT k, mask, named, list(CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN b END ORDER BY i) AS bs FROM s JOIN b USING (k) WHERE places = in_order AND kinds = named GROUP BY ALL),
    v AS (SELECT k, named, bs, list_transform([1, 2, 3, 4, 5], lambda x: coalesce(list_position(bs, x), 99)) AS ranks FROM g), t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY named DESC, ranks) = 1),
    e AS (SELECT k, bs, list_transform(range(1, len(bs) + 1), lambda i: list_max(list_filter(range(1, i), lambda j: bs[j] IS NOT NULL))) AS la, list_transform(range(1, len(bs) + 1), lambda i: list_min(list_filter(range(i + 1, len(bs) + 1), lambda j: bs[j] IS NOT NULL))) AS lb FROM t WHERE named >= 3),
    f AS (SELECT k, list_transform(range(1, len(bs) + 1), lambda i: coalesce(bs[i], CASE WHEN bs[lb[i]] - bs[la[i]] = lb[i] - la[i] THEN bs[la[i]] + i - la[i] END)) AS bs FROM e)
    SELECT k, list_transform(bs, lambda x: ['<10', '10-20', '20-30', '30-40', '>40'][x]) AS bands FROM f""")
def band_columns(spark, sf):
    """Columns of a matrix to bands by the fragments of their headers, which come in any order and in pieces; three must be named."""
    q = F.col("l_quantity")
    pick = lambda *names: F.when(q < 10, names[0]).when(q < 20, names[1]).when(q < 30, names[2]).when(q < 40, names[3]).otherwise(names[4])
    words = F.array(pick("up to", "10 to", "20 to", "30 to", "over"), pick("10", "20", "30", "40", "40"))
    lines = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_partkey"]).select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity", "l_partkey", words.alias("w"))
    at = lines.groupBy("k").agg(F.slice(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey", "w"))), 1, 7).alias("l"))
    place = lambda i: (i * 10).cast("double")
    piece = lambda x, i, n: F.struct((place(i) + (n * 4 - 2)).alias("x"), F.lit(float(n)).alias("y"), x["w"][n].alias("text"))
    parts = F.concat(F.transform("l", lambda x, i: piece(x, i, 1)), F.reverse(F.transform("l", lambda x, i: piece(x, i, 0))))
    got = at.select("k", F.transform("l", lambda x, i: place(i)).alias("columns"), parts.alias("fragments"))
    return got.select("k", L.banded("columns", "fragments", BANDS, 3).alias("bands")).where("bands is not null")


@query("""WITH s AS (SELECT l_suppkey AS g, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::INT AS o, coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag = 'A'), 0)::DOUBLE AS sales, coalesce(sum(l_extendedprice::DECIMAL(18,2) * (l_discount - 0.05)::DECIMAL(18,2)) FILTER (l_returnflag = 'N'), 0)::DOUBLE * 10 AS other, coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag = 'R'), 0)::DOUBLE AS cost, coalesce(sum(l_extendedprice::DECIMAL(18,2) * (l_tax - 0.02)::DECIMAL(18,2)), 0)::DOUBLE AS tax FROM lineitem GROUP BY ALL),
    h AS (SELECT *, sales + other - cost AS operating, sales + other - cost - tax AS net FROM s),
    e AS (SELECT g, o, 'sales' AS source, 'operating' AS sink, sales AS v FROM h UNION ALL SELECT g, o, 'other', 'operating', other FROM h WHERE other > 0 UNION ALL SELECT g, o, 'operating', 'other', -other FROM h WHERE other < 0 UNION ALL SELECT g, o, 'operating', 'cost', cost FROM h
        UNION ALL SELECT g, o, 'operating', 'net', operating FROM h WHERE operating > 0 UNION ALL SELECT g, o, 'net', 'operating', -operating FROM h WHERE operating < 0 UNION ALL SELECT g, o, 'net', 'tax', tax FROM h WHERE tax > 0 UNION ALL SELECT g, o, 'tax', 'net', -tax FROM h WHERE tax < 0
        UNION ALL SELECT g, o, 'net', 'profit', net FROM h WHERE net > 0 UNION ALL SELECT g, o, 'loss', 'net', -net FROM h WHERE net < 0)
    SELECT g, o, source, sink, round(v, 4) AS v FROM e WHERE v > 0""")
def flow_graph(spark, sf):
    """Flows of each supplier's quarter through two hubs; negative legs run the other way, a loss pays for what is missing."""
    of = lambda flag, v: F.coalesce(F.sum(F.when(F.col("l_returnflag") == flag, v)), F.lit(0)).cast("double")
    price = money("l_extendedprice")
    rate = lambda c, less: (F.col(c) - less).cast("decimal(18,2)")
    at = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int").alias("o")).agg(
        of("A", price).alias("sales"), (of("N", price * rate("l_discount", 0.05)) * 10).alias("other"), of("R", price).alias("cost"), F.sum(price * rate("l_tax", 0.02)).cast("double").alias("tax"))
    hubs = [W.Hub("operating", ("sales", "other"), ("cost",)), W.Hub("net", (), ("tax",))]
    return W.balanced(at, ["g", "o"], hubs).select("g", "o", "source", "sink", F.round("v", 4).alias("v"))
