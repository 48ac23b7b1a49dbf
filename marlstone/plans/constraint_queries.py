"""Statements of figures against their own constraints, faults seeded in some of each.

A supplier's quarter is a filing. Its parts come from the lines, grouped as a statement
groups them; what the statement says itself (totals, ratios, closings) is filed
apart, and in some filings it is wrong in one place.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import constraints as C
from ..sources.tables import money, table
from .registry import query

KEYS, PERIOD = ["g"], "o"
#: What is wrong in filings whose (31 g + o) % 41 is the number.
FAULTS = {
    1: ("capital", "tier 1"), 2: ("capital", "total"), 3: ("capital", "stated ratio"), 4: ("capital", "band"),
    5: ("liquidity", "coverage band"), 6: ("liquidity", "funding band"), 7: ("position", "currencies"), 8: ("position", "net"),
    9: ("position", "year before"), 10: ("repricing", "buckets"), 11: ("repricing", "both sides"), 12: ("quality", "stages"), 13: ("quality", "third stage"),
    14: ("stages", "coverage"), 15: ("stages", "not all bad"), 16: ("stages", "loans"), 17: ("profile", "split"), 18: ("profile", "group"),
    19: ("opinion", "fields"), 20: ("opinion", "kind"), 21: ("bad loans", "two sources"), 22: ("bad loans", "roll forward"), 23: ("sectors", "parts"),
}

RULES = [
    C.equal("capital", "tier 1", C.total("parts", "amount", "flag IN ('A', 'N')", False), C.one("filed", "tier1")),
    C.equal("capital", "total", C.one("filed", "tier1") + C.total("parts", "amount", "flag = 'R'", False), C.one("filed", "total")),
    C.equal("capital", "stated ratio", C.one("filed", "ratio"), C.one("filed", "total") / C.one("filed", "weighted") * 100, least=2.0, rel=0.0),
    C.between("capital", "band", C.one("filed", "ratio"), 5, 80),
    C.between("liquidity", "coverage band", C.one("filed", "coverage"), 10, 2000),
    C.between("liquidity", "funding band", C.one("filed", "funding"), 1, 60),
    C.equal("position", "currencies", C.total("currencies", "assets"), C.one("filed", "assets")),
    C.every("position", "net", "abs(assets - debts - net) <= 3"),
    C.equal("position", "year before", C.one("filed", "assets_before"), C.one("filed", "assets").before(4)),
    C.equal("repricing", "buckets", C.total("currencies", "assets", "currency <= 4") + C.total("currencies", "assets", "currency > 4", False), C.one("filed", "sensitive")),
    C.equal("repricing", "both sides", C.one("filed", "sensitive"), C.one("filed", "sensitive_debts")),
    C.equal("quality", "stages", C.total("parts", "amount", whole=False), C.one("filed", "gross")),
    C.equal("quality", "third stage", C.total("parts", "amount", "flag = 'R'", False), C.one("filed", "third")),
    C.every("stages", "coverage", "allowance / amount BETWEEN 0 AND 1"),
    C.less("stages", "not all bad", C.one("filed", "bad"), C.one("filed", "gross")),
    C.equal("stages", "loans", C.one("filed", "loans"), C.one("filed", "gross"), rel=0.05),
    C.equal("profile", "split", C.one("filed", "home") + C.one("filed", "abroad"), C.one("filed", "branches"), least=0.5),
    C.at_most("profile", "group", C.one("filed", "branches"), C.one("filed", "branches_group")),
    C.required("opinion", "fields", ["auditor", "signed"]),
    C.every("opinion", "kind", "kind IN ('clean', 'qualified')"),
    C.equal("bad loans", "two sources", C.total("parts", "amount", "flag = 'R'", False), C.total("lines", "amount", "returned", False)),
    C.equal("bad loans", "roll forward", C.one("filed", "closing").before() + C.one("filed", "flow"), C.one("filed", "closing")),
    C.every("sectors", "parts", "inner_amount <= amount"),
]
#: Which table's rows a statement's row rules look at.
ROWS = {"position": "currencies", "stages": "parts", "opinion": "filed", "sectors": "parts"}


def _statements(spark, sf):
    ordinal = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int")
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), ordinal.alias("o"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("currency"), money("l_extendedprice").alias("p"), F.col("l_discount").cast("decimal(18,2)").alias("d"), F.col("l_linestatus").alias("s"))
    fault = F.pmod(F.col("g") * 31 + F.col("o"), F.lit(41))
    off = lambda k, x: F.when(fault == k, x).otherwise(0)
    dbl = lambda c: c.cast("double")
    parts = lines.groupBy("g", "o", "flag").agg(dbl(F.sum("p")).alias("amount"), dbl(F.sum(F.col("p") * F.col("d"))).alias("allowance"), dbl(F.coalesce(F.sum(F.when(F.col("s") == "F", F.col("p"))), F.lit(0))).alias("inner_amount"))
    parts = parts.withColumn("allowance", F.col("allowance") * F.when(fault == 14, 1000).otherwise(1)).withColumn("inner_amount", F.col("inner_amount") + off(23, 1e7))
    currencies = lines.groupBy("g", "o", "currency").agg(dbl(F.sum("p")).alias("assets"), dbl(F.sum(F.col("p") * (1 - F.col("d")))).alias("debts"), dbl(F.sum(F.col("p") * F.col("d"))).alias("net"))
    currencies = currencies.withColumn("net", F.col("net") + off(8, 50))
    single = lines.select("g", "o", (dbl(F.col("p")) + off(21, 1000)).alias("amount"), (F.col("flag") == "R").alias("returned"))
    of = lambda cond: dbl(F.coalesce(F.sum(F.when(cond, F.col("p"))), F.lit(0).cast("decimal(18,2)")))
    sums = lines.groupBy("g", "o").agg(of(F.col("flag").isin("A", "N")).alias("core"), of(F.col("flag") == "R").alias("r"), dbl(F.sum("p")).alias("all"), dbl(F.sum(F.col("p") * (4 + F.col("currency")))).alias("w"), F.count("*").alias("n"), dbl(F.sum("d")).alias("ds"), F.count_if(F.col("s") == "F").alias("home"), F.count_if(F.col("s") != "F").alias("abroad"))
    sums = sums.where("g is not null and o is not null")  # a filing has a supplier and a quarter
    # a supplier's quarters are few: earlier ones are looked up in its window
    earlier = lambda c, back: F.max(c).over(Window.partitionBy("g").orderBy("o").rangeBetween(-back, -back))
    sums = sums.withColumn("all_before", earlier("all", 4))
    tier1 = F.col("core") + off(1, 1000)
    whole = tier1 + F.col("r") + off(2, 500)
    weighted = F.col("w") / F.when(fault == 4, 20).otherwise(1)
    filed = sums.select(
        "g", "o", tier1.alias("tier1"), whole.alias("total"), weighted.alias("weighted"), (100 * whole / weighted + off(3, 3)).alias("ratio"),
        (100 * F.col("w") / F.col("all") / 5 * F.when(fault == 5, 100).otherwise(1)).alias("coverage"), (100 * F.col("ds") / F.col("n") * F.when(fault == 6, 100).otherwise(1) + 2).alias("funding"),
        (F.col("all") + off(7, 900)).alias("assets"), (F.col("all_before") + F.when(F.pmod(F.col("g") * 31 + F.col("o") - 4, F.lit(41)) == 7, 900).otherwise(0) + off(9, 900)).alias("assets_before"),
        (F.col("all") + off(10, 700)).alias("sensitive"), (F.col("all") + off(10, 700) + off(11, 700)).alias("sensitive_debts"),
        (F.col("all") + off(12, 400)).alias("gross"), (F.col("r") + off(13, 400)).alias("third"), F.when(fault == 15, F.col("all")).otherwise(F.col("r") / 2).alias("bad"),
        (F.col("all") * F.when(fault == 16, 1.2).otherwise(1.01)).alias("loans"),
        F.col("home"), (F.col("abroad") + off(17, 2)).alias("abroad"), F.col("n").alias("branches"), (F.col("n") + F.when(fault == 18, -1).otherwise(F.col("g") % 3)).alias("branches_group"),
        F.when(fault != 19, F.concat(F.lit("a"), F.col("g") % 7)).alias("auditor"), F.col("o").alias("signed"), F.when(fault == 20, "none").when(F.col("g") % 5 == 0, "qualified").otherwise("clean").alias("kind"),
        (F.col("all") * 2 + off(22, 600)).alias("closing"), (2 * F.col("all")).alias("true_closing"),
    )
    # the flow is filed from the quarter's own books: this closing, less the last one as it was filed
    filed = filed.withColumn("flow", F.col("true_closing") - earlier("closing", 1))
    return {"parts": parts, "currencies": currencies, "lines": single, "filed": filed}


def _sql() -> str:
    band = lambda x, low, high: f"CASE WHEN {x} IS NULL THEN 'skip' WHEN {x} BETWEEN {low} AND {high} THEN 'pass' ELSE 'fail' END"
    eq = lambda a, b, least=3, rel=1e-5: f"CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN 'skip' WHEN abs(({a}) - ({b})) <= greatest({least}, {rel} * greatest(abs({a}), abs({b}))) THEN 'pass' ELSE 'fail' END"
    seen = lambda k: f"CASE WHEN h = {k} THEN 'fail' ELSE 'pass' END"
    verdicts = {
        ("capital", "tier 1"): eq("core", "core + f1"), ("capital", "total"): eq("core + f1 + r", "core + f1 + r + f2"), ("capital", "stated ratio"): eq("ratio", "100 * (core + f1 + r + f2) / weighted", 2, 0), ("capital", "band"): band("ratio", 5, 80),
        ("liquidity", "coverage band"): band("20 * w / al * CASE WHEN h = 5 THEN 100 ELSE 1 END", 10, 2000), ("liquidity", "funding band"): band("(100 * ds / n * CASE WHEN h = 6 THEN 100 ELSE 1 END + 2)", 1, 60),
        ("position", "currencies"): eq("al", "al + f7"), ("position", "net"): seen(8), ("position", "year before"): "CASE WHEN before4 IS NULL THEN 'skip' WHEN h = 9 THEN 'fail' ELSE 'pass' END",
        ("repricing", "buckets"): "CASE WHEN low IS NULL OR high IS NULL THEN 'skip' WHEN abs(low + high - al - f10) <= greatest(3, 1e-5 * (al + f10)) THEN 'pass' ELSE 'fail' END", ("repricing", "both sides"): eq("al + f10", "al + f10 + f11"),
        ("quality", "stages"): eq("al", "al + f12"), ("quality", "third stage"): "CASE WHEN nr = 0 THEN 'skip' ELSE " + eq("r", "r + f13") + " END",
        ("stages", "coverage"): "CASE WHEN bad_cover > 0 THEN 'fail' ELSE 'pass' END", ("stages", "not all bad"): "CASE WHEN CASE WHEN h = 15 THEN al ELSE r / 2 END < al + f12 THEN 'pass' ELSE 'fail' END",
        ("stages", "loans"): eq("al * CASE WHEN h = 16 THEN 1.2 ELSE 1.01 END", "al + f12", 3, 0.05), ("profile", "split"): seen(17), ("profile", "group"): seen(18),
        ("opinion", "fields"): seen(19), ("opinion", "kind"): seen(20), ("bad loans", "two sources"): "CASE WHEN nr = 0 THEN 'skip' ELSE " + eq("r", "r + CASE WHEN h = 21 THEN 1000 * nr ELSE 0 END") + " END",
        ("bad loans", "roll forward"): "CASE WHEN before1 IS NULL THEN 'skip' ELSE " + eq("2 * al", "2 * al + f22") + " END", ("sectors", "parts"): seen(23),
    }
    # a supplier without its core parts, or without returned ones, skips what needs their sum
    for name in ("tier 1",):
        verdicts["capital", name] = f"CASE WHEN nc = 0 THEN 'skip' ELSE {verdicts['capital', name]} END"
    verdicts["capital", "total"] = f"CASE WHEN nr = 0 THEN 'skip' ELSE {verdicts['capital', 'total']} END"
    rows = " UNION ALL ".join(f"SELECT g, o, '{s}' AS statement, '{r}' AS rule, {v} AS verdict FROM z" for (s, r), v in verdicts.items())
    faults = ", ".join(f"CASE WHEN q.h = {k} THEN {x} ELSE 0 END AS f{k}" for k, x in ((1, 1000), (2, 500), (7, 900), (10, 700), (11, 700), (12, 400), (13, 400), (22, 600)))
    return f"""
WITH l AS (SELECT l_suppkey AS g, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::INT AS o, l_returnflag AS flag, l_linenumber AS c, l_extendedprice::DECIMAL(18,2) AS p, l_discount::DECIMAL(18,2) AS d FROM lineitem),
pc AS (SELECT g, o, count(*) FILTER (1000 * a > s) AS over FROM (SELECT g, o, flag, sum(p * d)::DOUBLE AS a, sum(p)::DOUBLE AS s FROM l GROUP BY ALL) GROUP BY ALL),
q AS (SELECT g, o, coalesce(sum(p) FILTER (flag IN ('A', 'N')), 0)::DOUBLE AS core, coalesce(sum(p) FILTER (flag = 'R'), 0)::DOUBLE AS r, sum(p)::DOUBLE AS al, sum(p * (4 + c))::DOUBLE AS w, count(*) AS n, sum(d)::DOUBLE AS ds,
    count(*) FILTER (flag = 'R') AS nr, count(*) FILTER (flag <> 'R') AS nc, sum(p) FILTER (c <= 4)::DOUBLE AS low, sum(p) FILTER (c > 4)::DOUBLE AS high, (31 * g + o) % 41 AS h FROM l GROUP BY ALL),
x AS (SELECT q.*, {faults}, b.al AS before4, a.al AS before1, CASE WHEN q.h = 14 THEN over ELSE 0 END AS bad_cover FROM q LEFT JOIN q b ON b.g = q.g AND b.o = q.o - 4 LEFT JOIN q a ON a.g = q.g AND a.o = q.o - 1 JOIN pc ON pc.g = q.g AND pc.o = q.o),
y AS (SELECT *, w / CASE WHEN h = 4 THEN 20 ELSE 1 END AS weighted FROM x), z AS (SELECT *, 100 * (core + f1 + r + f2) / weighted + CASE WHEN h = 3 THEN 3 ELSE 0 END AS ratio FROM y)
SELECT * FROM ({rows}) WHERE verdict <> 'pass'"""


@query(_sql())
def statement_constraints(spark, sf):
    """What fails or is skipped in each filing, statement by statement."""
    rules = [C.Rule(r.statement, r.name, tuple(C.Leaf(ROWS.get(o.statement, o.statement), o.how, o.value, o.where, o.back, o.whole) if isinstance(o, C.Leaf) else o for o in r.operands), r.verdict) for r in RULES]
    return C.Compiled(KEYS, PERIOD, rules).verdicts(_statements(spark, sf)).where("verdict != 'pass'")
