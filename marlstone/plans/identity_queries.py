"""Identities of statements, capital, provisions and perimeters, with seeded faults."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import identities as I
from ..operators import panel as P
from ..operators import series as S
from ..operators.checks import verdict
from ..sources.tables import money, supplier_quarters, table
from .registry import SUPPLIER, query
from .series_queries import r6

STATEMENT = "st AS (SELECT l_suppkey AS g, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::INT AS o, " + ", ".join(f"(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_linenumber = {k}))::DOUBLE AS v{k}" for k in range(1, 8)) + " FROM lineitem GROUP BY ALL)"


def _statement(spark, sf):
    """``g, o, v1 .. v7``: a supplier's quarter with a sum for each line number; null where it has none."""
    lines = table(spark, sf, "lineitem", ["l_suppkey", "l_shipdate", "l_linenumber", "l_extendedprice"])
    o = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int")
    return lines.groupBy(F.col("l_suppkey").alias("g"), o.alias("o")).agg(*(F.sum(F.when(F.col("l_linenumber") == k, money("l_extendedprice"))).cast("double").alias(f"v{k}") for k in range(1, 8)))


@query(f"""WITH {STATEMENT}, c AS (SELECT g, o, v1 + v2 + v3 + v4 AS change, v5, v1 + v2 + v3 + v4 + CASE WHEN g % 6 = 0 THEN 10000 ELSE 0 END AS told, v5 + v1 + v2 + v3 + v4 + CASE WHEN g % 7 = 0 THEN 20000 ELSE 0 END AS closing FROM st)
    SELECT g, o, CASE WHEN change IS NOT NULL AND abs(change - told) > greatest(3, abs(told) * 5e-5) THEN 'fail' WHEN change IS NULL OR v5 IS NULL THEN 'skip' WHEN g % 6 = 0 AND abs(change - told) > greatest(3, abs(told) * 5e-5) OR abs(v5 + told - closing) > greatest(3, abs(closing) * 5e-5) THEN 'fail' ELSE 'pass' END AS verdict FROM c""")
def cash_flow_identity(spark, sf):
    """Four sections make the change in cash, and with opening cash the closing one; a sixth and a seventh are off."""
    v = {k: F.col(f"v{k}") for k in range(1, 8)}
    parts = [v[k] for k in (1, 2, 3, 4)]
    told = I.total(*parts) + F.when(F.col("g") % 6 == 0, 10000).otherwise(0)
    closing = v[5] + I.total(*parts) + F.when(F.col("g") % 7 == 0, 20000).otherwise(0)
    return _statement(spark, sf).select("g", "o", I.cash_flow(parts, told, v[5], closing).alias("verdict"))


@query(f"""WITH {STATEMENT} SELECT g, o, CASE WHEN v1 IS NULL OR v2 IS NULL THEN 'skip' WHEN g % 4 = 3 THEN 'fail' ELSE 'pass' END AS total, CASE WHEN v1 IS NULL THEN 'skip' WHEN v2 IS NULL AND v3 IS NULL THEN 'skip' WHEN g % 3 = 0 AND v2 IS NOT NULL THEN 'pass' WHEN v3 IS NOT NULL AND abs(v3 - v1) <= 10 THEN 'pass' WHEN v2 IS NOT NULL AND g % 3 <> 0 AND abs(v2 - v1) <= 10 THEN 'pass' ELSE 'fail' END AS bottom FROM st""")
def income_identities(spark, sf):
    """III = I + II, a fourth of it off; and a bottom line that any of the candidates may match."""
    v1, v2, v3 = F.col("v1"), F.col("v2"), F.col("v3")
    told = v1 + v2 + F.when(F.col("g") % 4 == 3, 100 + F.abs(v1 + v2) * 0.01).otherwise(0)
    candidates = F.array(F.when(F.col("g") % 3 == 0, v2 * 0 + v1 + 1).otherwise(v2), v3)
    return _statement(spark, sf).select("g", "o", verdict(v1 + v2, told, 3.0, 1e-5).alias("total"), I.matches_any(v1, candidates).alias("bottom"))


ROLES = [("operating", "^(STANDARD|SMALL|MEDIUM)"), ("interest", "^(LARGE|ECONOMY)"), ("tax", "^PROMO")]


@query("""WITH t AS (SELECT DISTINCT p_brand AS g, CASE WHEN regexp_matches(p_type, '^(STANDARD|SMALL|MEDIUM)') THEN 'operating' WHEN regexp_matches(p_type, '^(LARGE|ECONOMY)') THEN 'interest' WHEN regexp_matches(p_type, '^PROMO') THEN 'tax' ELSE 'other' END AS role FROM part)
    SELECT g, list_sort(list(role)) AS roles, list_has_all(list(role), ['operating', 'tax']) AS complete FROM t GROUP BY g""")
def role_resolution(spark, sf):
    """Labels to roles by ordered rules, and whether the required roles are all there."""
    got = table(spark, sf, "part", ["p_brand", "p_type"]).groupBy(F.col("p_brand").alias("g")).agg(F.sort_array(F.collect_set(X.first_rule(F.col("p_type"), ROLES))).alias("roles"))
    return got.withColumn("complete", F.size(F.array_except(F.array(F.lit("operating"), F.lit("tax")), "roles")) == 0)


@query(f"""WITH {STATEMENT}, c AS (SELECT g, o, v1 AS core, v1 + coalesce(v2, 0) AS tier1, v1 + coalesce(v2, 0) + coalesce(v3, 0) - CASE WHEN g % 9 = 0 THEN v1 ELSE 0 END AS total FROM st)
    SELECT g, o, CASE WHEN core IS NULL THEN 'skip' WHEN tier1 > total THEN 'order' WHEN g % 8 = 0 THEN 'spread' ELSE 'pass' END AS verdict FROM c""")
def capital_consistency(spark, sf):
    """Core, tier 1 and total capital in order, and the assets that their ratios imply alike; some are seeded otherwise."""
    core = F.col("v1")
    tier1 = core + F.coalesce("v2", F.lit(0.0))
    all_capital = tier1 + F.coalesce("v3", F.lit(0.0)) - F.when(F.col("g") % 9 == 0, core).otherwise(0)
    assets = lambda off: F.when((F.col("g") % 8 == 0) & F.lit(off), 800000.0).otherwise(700000.0)
    ratios = F.array(core / assets(True), tier1 / assets(False), all_capital / assets(False))
    return _statement(spark, sf).select("g", "o", I.capital_order(core, tier1, all_capital, ratios).alias("verdict"))


@query(f"""WITH l AS (SELECT l_suppkey AS g, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::INT AS o, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY ALL), t AS (SELECT *, lag(n) OVER (PARTITION BY g ORDER BY o) AS before FROM l)
    SELECT g, o, CASE WHEN top < 20 THEN 'tiny' ELSE 'vanished' END AS finding FROM t WHERE top < 20 OR 2 * n < before""")
def allowance_sanity(spark, sf):
    """Periods with a tiny largest value or less than half of the rows before."""
    at = table(spark, sf, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"]).groupBy(F.col("l_suppkey").alias("g"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int").alias("o")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("top"))
    return at.withColumn("finding", I.vanished(at, ["g"], "o", "n", "top", 20)).where("finding is not null").select("g", "o", "finding")


@query(f"""WITH {SUPPLIER}, r AS (SELECT g, o, flow / qty AS r FROM sq), m AS (SELECT g, median(r) AS m FROM r GROUP BY g) SELECT g, o, round(r, 6) AS r, round(m, 6) AS median FROM r JOIN m USING (g) WHERE abs(r / m - 1) > 0.3""")
def ratio_drift(spark, sf):
    """Ratios far from the entity's own median."""
    at = supplier_quarters(spark, sf).select("g", "o", (F.col("flow") / F.col("qty")).alias("r"))
    return I.drifts(at, ["g"], "r", P.quantiles(at, ["g"], "r", [0.5], ["median"]).drop("there"), 0.3).select("g", "o", r6(F.col("r"), "r"), r6(F.col("median"), "median"))


@query(f"""WITH {SUPPLIER}, t AS (SELECT a.g, a.o, a.qty, b.qty AS was FROM sq a LEFT JOIN sq b ON b.g = a.g AND b.o = a.o - 1)
    SELECT g, o, CASE WHEN qty > 60000 OR qty < 20 THEN 'band' WHEN was IS NULL THEN 'no prior' WHEN g % 10 = 0 THEN 'chain' ELSE 'pass' END AS verdict FROM t""")
def provision_checks(spark, sf):
    """A provision within its band, and its opening equal to the closing before; a tenth is seeded otherwise."""
    w = Window.partitionBy("g").orderBy("o").rangeBetween(-1, -1)
    at = supplier_quarters(spark, sf).select("g", "o", "qty").withColumn("was", F.max("qty").over(w))
    opening = F.col("was") + F.when(F.col("g") % 10 == 0, 5).otherwise(0)
    return at.select("g", "o", F.when((F.col("qty") > 60000) | (F.col("qty") < 20), "band").when(F.col("was").isNull(), "no prior").when(F.abs(opening - F.col("was")) > 1, "chain").otherwise("pass").alias("verdict"))


@query(f"""WITH {STATEMENT}, s AS (SELECT g, o, coalesce(v2, 0) / (v1 + coalesce(v2, 0)) AS share, v1 + coalesce(v2, 0) AS total FROM st WHERE v1 IS NOT NULL)
    SELECT a.g, a.o, round(a.share, 6) AS share FROM s a JOIN s b ON a.g = b.g AND a.o = b.o + 1 WHERE (a.share >= 0.4 OR a.share - b.share >= 0.03) AND (a.total - b.total) / 1e8 >= -0.005""")
def capital_divergence(spark, sf):
    """Capital that leans on its weaker parts while the ratio as a whole holds."""
    at = _statement(spark, sf).where("v1 is not null").select("g", "o", (F.col("v1") + F.coalesce("v2", F.lit(0.0))).alias("total"), F.coalesce("v2", F.lit(0.0)).alias("other"))
    at = at.withColumn("share", F.col("other") / F.col("total"))
    w = Window.partitionBy("g").orderBy("o").rangeBetween(-1, -1)
    at = at.withColumn("was", F.max("share").over(w)).withColumn("before", F.max("total").over(w)).where("was is not null")
    return at.where(I.composition_divergence(F.col("share"), F.col("was"), (F.col("total") - F.col("before")) / 1e8)).select("g", "o", r6(F.col("share"), "share"))


@query(f"""WITH {SUPPLIER}, r AS (SELECT g, o, qty / 100000 AS r, stock / 100000 AS c, lag(qty / 100000, 4) OVER w AS r4, lag(stock / 100000, 4) OVER w AS c4 FROM sq WINDOW w AS (PARTITION BY g ORDER BY o))
    SELECT g, o, round(c - c4, 6) AS fall FROM r WHERE abs(r - r4) <= 0.0015 AND c - c4 <= -0.01""")
def coverage_divergence(spark, sf):
    """Coverage down over four rows while the ratio it covers stands still."""
    w = Window.partitionBy("g").orderBy("o")
    at = supplier_quarters(spark, sf).select("g", "o", (F.col("qty") / 100000).alias("r"), (F.col("stock") / 100000).alias("c"))
    got = at.withColumn("r4", F.lag("r", 4).over(w)).withColumn("fall", F.col("c") - F.lag("c", 4).over(w))
    return got.where((F.abs(F.col("r") - F.col("r4")) <= 0.0015) & (F.col("fall") <= -0.01)).select("g", "o", r6(F.col("fall"), "fall"))


@query(f"""WITH {SUPPLIER}, t AS (SELECT g, o, qty, lag(qty) OVER (PARTITION BY g ORDER BY o) AS was FROM sq) SELECT g, o, qty, was FROM t WHERE was IS NOT NULL AND (was >= 500) <> (qty >= 500)""")
def materiality_flips(spark, sf):
    return I.flips(supplier_quarters(spark, sf).select("g", "o", "qty"), ["g"], "o", "qty", 500)


@query("""WITH t AS (SELECT DISTINCT l_suppkey AS g, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::INT AS o, l_returnflag || l_linestatus AS role FROM lineitem), s AS (SELECT g, o, list_sort(list(role)) AS roles FROM t GROUP BY g, o), w AS (SELECT *, lag(roles) OVER (PARTITION BY g ORDER BY o) AS was FROM s)
    SELECT g, o, list_filter(roles, lambda x: NOT list_contains(was, x)) AS added, list_filter(was, lambda x: NOT list_contains(roles, x)) AS lost FROM w WHERE was IS NOT NULL AND roles <> was""")
def line_item_changes(spark, sf):
    """Line items that a statement gained and lost against the one before."""
    at = table(spark, sf, "lineitem", ["l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus"]).select(F.col("l_suppkey").alias("g"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int").alias("o"), F.concat("l_returnflag", "l_linestatus").alias("role"))
    return I.role_changes(at.distinct(), ["g"], "o", "role")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v, o_orderkey % 3 = 0 AS kept FROM orders""")
def validated_write(spark, sf):
    """A statement that passed is not replaced by a re-extract that fails; other re-extracts replace theirs."""
    stored = table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit("pass").alias("was"))
    new = stored.select("k", F.when(F.col("k") % 2 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("fresh"), F.when(F.col("k") % 3 == 0, "fail").otherwise("pass").alias("now"))
    keep = (F.col("was") == "pass") & (F.col("now") == "fail")
    return stored.join(new, "k").select("k", F.when(keep, F.col("v")).otherwise(F.col("fresh")).alias("v"), keep.alias("kept"))


@query("""WITH o AS (SELECT o_custkey AS g, count(*) AS n, count(*) FILTER (o_orderkey % 13 <> 0) AS kept FROM orders GROUP BY 1) SELECT g, n - kept AS deleted, CASE WHEN kept = 0 THEN 'partition' ELSE 'rows' END AS how FROM o WHERE kept < n""")
def delete_outbox(spark, sf):
    """Deletions to send on: a whole partition where nothing of it is left, else its rows."""
    at = table(spark, sf, "orders", ["o_custkey", "o_orderkey"])
    got = at.groupBy(F.col("o_custkey").alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") % 13 != 0).alias("kept")).where("kept < n")
    return got.select("g", (F.col("n") - F.col("kept")).alias("deleted"), F.when(F.col("kept") == 0, "partition").otherwise("rows").alias("how"))


@query(f"""WITH {STATEMENT}, w AS (SELECT o, count(*) AS n, count(*) FILTER (v1 IS NULL) AS missing, count(*) FILTER (v1 IS NOT NULL AND g % 3 = 0) AS error FROM st GROUP BY o) SELECT o, n, missing, error, CASE WHEN 10 * missing > n THEN 'open' WHEN error > 0 THEN 'closing' ELSE 'closed' END AS state FROM w""")
def filing_season(spark, sf):
    """State of each period from its cells that are missing or in error."""
    at = _statement(spark, sf).groupBy("o").agg(F.count("*").alias("n"), F.count_if(F.col("v1").isNull()).alias("missing"), F.count_if(F.col("v1").isNotNull() & (F.col("g") % 3 == 0)).alias("error"))
    return at.withColumn("state", F.when(10 * F.col("missing") > F.col("n"), "open").when(F.col("error") > 0, "closing").otherwise("closed"))


@query(f"""WITH {STATEMENT}, u AS (SELECT g, o, unnest(['v1', 'v2', 'v3', 'v4']) AS part, unnest([v1, v2, v3, v4]) AS v FROM st) SELECT g, o, part, CASE WHEN v IS NULL THEN 'missing' ELSE 'error' END AS status FROM u WHERE v IS NULL OR v > 400000""")
def coverage_problems(spark, sf):
    """Cells that are missing or in error, one row each: the detail behind a partition's status."""
    cells = _statement(spark, sf).select("g", "o", *(F.col(f"v{k}") for k in range(1, 5))).unpivot(["g", "o"], ["v1", "v2", "v3", "v4"], "part", "v")
    return cells.where("v is null or v > 400000").select("g", "o", "part", F.when(F.col("v").isNull(), "missing").otherwise("error").alias("status"))


@query(f"""WITH {SUPPLIER}, s AS (SELECT g, o, stock, qty, lag(stock, 4) OVER w AS stock0, lag(qty, 4) OVER w AS qty0 FROM sq WINDOW w AS (PARTITION BY g ORDER BY o)), t AS (SELECT o, sum(stock0::DECIMAL(38,6))::DOUBLE AS s0, sum(qty0::DECIMAL(38,6))::DOUBLE AS q0, sum(stock::DECIMAL(38,6))::DOUBLE AS s, sum(qty::DECIMAL(38,6))::DOUBLE AS q, sum((qty * (stock0 / qty0))::DECIMAL(38,6))::DOUBLE AS c FROM s WHERE qty0 > 0 GROUP BY o)
    SELECT o, round(s0 / q0 - c / q, 4) AS mix, round(c / q - s / q, 4) AS erosion FROM t""")
def coverage_fall(spark, sf):
    """A fall of coverage as change of mix (old coverages at new weights) and erosion (the rest)."""
    w = Window.partitionBy("g").orderBy("o")
    at = supplier_quarters(spark, sf).withColumn("stock0", F.lag("stock", 4).over(w)).withColumn("qty0", F.lag("qty", 4).over(w)).where("qty0 > 0")
    kept = F.col("qty") * (F.col("stock0") / F.col("qty0"))
    t = at.groupBy("o").agg(*(P.exact_sum(c).cast("double").alias(n) for c, n in ((F.col("stock0"), "s0"), (F.col("qty0"), "q0"), (F.col("stock"), "s"), (F.col("qty"), "q"), (kept, "c"))))
    return t.select("o", F.round(F.col("s0") / F.col("q0") - F.col("c") / F.col("q"), 4).alias("mix"), F.round(F.col("c") / F.col("q") - F.col("s") / F.col("q"), 4).alias("erosion"))


@query(f"""WITH {SUPPLIER} SELECT g, o, concat(CASE WHEN flow > 2000000 THEN 'L' ELSE 'S' END, '-', CASE WHEN qty > 500 THEN 'ecl12' ELSE 'ecl' END) AS key FROM sq""")
def alias_keys(spark, sf):
    """One key for the names that a line goes by."""
    label = F.when(F.col("qty") > 500, "12-month ECL").otherwise("Expected credit loss")
    key = X.first_rule(label, [("ecl12", "(?i)12-month"), ("ecl", "(?i)expected credit loss|ecl")])
    return supplier_quarters(spark, sf).select("g", "o", F.concat(F.when(F.col("flow") > 2000000, "L").otherwise("S"), F.lit("-"), key).alias("key"))


@query(f"""WITH {SUPPLIER}, t AS (SELECT g, o, stock, lag(stock) OVER w AS s1, lag(stock, 4) OVER w AS s4, lag(o) OVER w AS o1, lag(o, 4) OVER w AS o4 FROM sq WINDOW w AS (PARTITION BY g ORDER BY o))
    SELECT g, o, round(CASE WHEN o1 = o - 1 AND s1 <> 0 THEN (stock - s1) * 100 / abs(s1) END, 6) AS qoq, round(CASE WHEN o4 = o - 4 AND s4 <> 0 THEN (stock - s4) * 100 / abs(s4) END, 6) AS yoy, stock > coalesce(s1, 0) AND stock > coalesce(s4, 0) AS gate FROM t""")
def comparatives(spark, sf):
    """A metric against the quarter and the year before, and whether a story of growth may be told."""
    at = lambda n: F.max("stock").over(Window.partitionBy("g").orderBy("o").rangeBetween(-n, -n))
    # lags by row need every row between, as in the lists they come from; ranges by ordinal don't
    rows = supplier_quarters(spark, sf).select("g", "o", "stock", at(1).alias("s1"), F.lag("o", 4).over(Window.partitionBy("g").orderBy("o")).alias("o4"), F.lag("stock", 4).over(Window.partitionBy("g").orderBy("o")).alias("b4"), F.lag("stock").over(Window.partitionBy("g").orderBy("o")).alias("b1"))
    s4 = F.when(F.col("o4") == F.col("o") - 4, F.col("b4"))
    gate = (F.col("stock") > F.coalesce("b1", F.lit(0.0))) & (F.col("stock") > F.coalesce("b4", F.lit(0.0)))
    return rows.select("g", "o", r6(S.magnitude_growth(F.col("stock"), F.col("s1")), "qoq"), r6(S.magnitude_growth(F.col("stock"), s4), "yoy"), gate.alias("gate"))
