"""Specs, catalogue, gateway, grounding and streams over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dsl
from ..sources.html import html_blocks
from ..sources.tables import daily_orders, monthly_orders, supplier_quarters, table
from ..streaming import weekly as W
from . import catalog, gateway
from .registry import DAILY, MONTHLY, SUPPLIER, query

SPEC = {
    "id": "late-share",
    "title": "Share of finished orders, and growth of all",
    "series": [
        {"key": "f", "source": "F"},
        {"key": "o", "source": "O"},
        {"key": "p", "source": "P"},
        {"key": "all", "transform": "sum", "of": ["f", "o", "p"]},
        {"key": "millions", "transform": "scale", "of": ["all"], "factor": 1e-6},
        {"key": "share", "transform": "ratio", "of": ["f", "all"], "scale": 100},
        {"key": "sum30", "transform": "rolling", "of": ["all"], "n": 30},
        {"key": "growth", "transform": "growth", "of": ["sum30"], "rows": 364, "yoy": True},
        {"key": "mix", "transform": "formula", "formula": {"op": "div", "args": [{"op": "sub", "args": [{"ref": "o"}, {"ref": "f"}]}, {"op": "add", "args": [{"ref": "all"}, {"const": 1}]}]}},
    ],
}


@query(f"""WITH {DAILY}, a AS (SELECT d, sum(v::DECIMAL(38,6))::DOUBLE AS v FROM daily GROUP BY d), s AS (SELECT d, (sum(v::DECIMAL(38,6)) OVER w)::DOUBLE AS v FROM a WINDOW w AS (ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 30),
    f AS (SELECT d, v FROM daily WHERE g = 'F'), o AS (SELECT d, v FROM daily WHERE g = 'O'), w AS (SELECT d, v, lag(v, 364) OVER (ORDER BY d) AS b FROM s)
    SELECT 'share' AS key, d, round(f.v / a.v * 100, 4) AS v FROM f JOIN a USING (d) WHERE a.v <> 0 UNION ALL SELECT 'growth', d, round((v / b - 1) * 100, 4) FROM w WHERE b > 0
    UNION ALL SELECT 'millions', d, round(v * 1e-6, 4) FROM a UNION ALL SELECT 'mix', d, round((o.v - f.v) / (a.v + 1), 4) FROM o JOIN f USING (d) JOIN a USING (d)""")
def dsl_specs(spark, sf):
    at = daily_orders(spark, sf)
    done = dsl.resolve(SPEC, {g: at.where(F.col("g") == g) for g in "FOP"})
    parts = [done[k].select(F.lit(k).alias("key"), "d", F.round("v", 4).alias("v")) for k in ("share", "growth", "millions", "mix")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _facts(spark, sf):
    at = supplier_quarters(spark, sf).withColumn("d", F.make_date((F.col("o") / 4).cast("int"), (F.col("o") % 4) * 3 + 1, F.lit(1)))
    return catalog.long_form(at, ["g", "d"], ["flow", "qty", "stock"])


FACTS = f"""{SUPPLIER}, facts AS (SELECT g, make_date(o // 4, (o % 4) * 3 + 1, 1) AS d, unnest(['flow', 'qty', 'stock']) AS item, unnest([flow, qty, stock]) AS v FROM sq),
    cat AS (SELECT concat('MS.SQ.Q.', lpad(dense_rank() OVER (ORDER BY f, item)::VARCHAR, 3, '0'), '.', g::VARCHAR) AS series_code, item, g, s, e, n FROM (SELECT item, g, min(d) AS s, max(d) AS e, count(v) AS n, min(min(d)) OVER (PARTITION BY item) AS f FROM facts GROUP BY item, g))"""


@query(f"WITH {FACTS} SELECT series_code, item, s AS start_date, e AS end_date, n AS obs_count FROM cat")
def series_catalog(spark, sf):
    return catalog.build(_facts(spark, sf), "SQ", "Q", "g").select("series_code", "item", "start_date", "end_date", "obs_count")


@query(f"WITH {FACTS} SELECT series_code, d, v FROM cat JOIN facts USING (item, g) WHERE series_code IN ('MS.SQ.Q.001.1', 'MS.SQ.Q.003.2') AND d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def series_by_code(spark, sf):
    facts = _facts(spark, sf)
    return catalog.observations(catalog.build(facts, "SQ", "Q", "g"), facts, ["MS.SQ.Q.001.1", "MS.SQ.Q.003.2"], "g", "1996-01-01", "1999-12-31")


@query("""SELECT o_orderstatus AS g, 'counted' AS how, count(*)::DOUBLE AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1
    UNION ALL SELECT o_orderstatus, 'inside', coalesce(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice::DECIMAL(18,2) END), 0)::DOUBLE FROM orders GROUP BY 1
    UNION ALL SELECT o_orderpriority, 'apart', sum(o_totalprice::DECIMAL(18,2))::DOUBLE FROM orders GROUP BY 1""")
def guarded_sql(spark, sf):
    """Rows of three statements that the gateway lets through: codes pinned, pinned inside the sum, kept apart. Their wider twins must be refused."""
    amount = "CAST(o_totalprice AS DECIMAL(18,2))"
    statements = {
        "SELECT o_orderstatus AS g, 'counted' AS how, CAST(count(*) AS DOUBLE) AS v FROM gate_orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1": None,
        f"SELECT o_orderstatus AS g, 'inside' AS how, CAST(coalesce(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN {amount} END), 0) AS DOUBLE) AS v FROM gate_orders GROUP BY 1": ("IN ('1-URGENT', '2-HIGH')", "<> '5-LOW'"),
        f"SELECT o_orderpriority AS g, 'apart' AS how, CAST(sum({amount}) AS DOUBLE) AS v FROM gate_orders GROUP BY 1": ("o_orderpriority AS g", "o_orderstatus AS g"),
    }
    table(spark, sf, "orders").createOrReplaceTempView("gate_orders")
    policy = gateway.Policy(frozenset({"gate_orders"}), {"o_orderpriority": {"1-URGENT": "a", "2-HIGH": "a", "5-LOW": "b"}}, cap=10**6)
    out = None
    for sql, twin in statements.items():
        if twin and not (gateway.ask(spark, sql.replace(*twin), policy).reason or "").startswith("it adds up overlapping codes"):
            raise ValueError(f"let through: {sql.replace(*twin)}")
        got = gateway.ask(spark, sql, policy)
        if got.reason:
            raise ValueError(f"{got.reason}: {sql}")
        out = got.rows if out is None else out.unionByName(got.rows)
    spark.catalog.dropTempView("gate_orders")
    return out


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?')) AS printed, n_chars FROM documents), f AS (SELECT DISTINCT doc_id, printed, replace(printed, ',', '')::DOUBLE AS figure FROM t)
    SELECT doc_id, printed FROM f WHERE figure >= 1000 AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = f.doc_id AND abs(figure - n_chars) <= greatest(0.01, n_chars * 1e-4))""")
def grounding(spark, sf):
    """Figures in documents that their own data doesn't hold."""
    docs = table(spark, sf, "documents", ["doc_id", "text", "n_chars"])
    return gateway.unsupported_figures(docs, "doc_id", "text", docs.select("doc_id", F.col("n_chars").cast("double").alias("v")), "v").select("doc_id", "printed")


@query("""SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL""")
def batch_weekly(spark, sf):
    return W.weekly_counts(table(spark, sf, "events"))


@query()
def html_body(spark, sf):
    """Text blocks of every page."""
    return table(spark, sf, "pages", ["page_id", "html"]).select("page_id", F.posexplode(html_blocks("html")).alias("pos", "block"))


@query(f"""WITH {MONTHLY}, t AS (SELECT g, y * 12 + m - 1 AS o, v FROM monthly) SELECT a.g, a.o::INT AS o, round(100 * sum(b.v::DECIMAL(38,6))::DOUBLE / sum(c.v::DECIMAL(38,6))::DOUBLE, 4) AS ratio
    FROM t a JOIN t b ON b.g = a.g AND b.o BETWEEN a.o - 2 AND a.o JOIN t c ON c.g = 'BUILDING' AND c.o = b.o WHERE a.g <> 'BUILDING' GROUP BY a.g, a.o HAVING count(*) = 3""")
def rolling_ratio(spark, sf):
    """Ratio of rolling sums on shared months, both in one window."""
    at = monthly_orders(spark, sf).select("g", (F.col("y") * 12 + F.col("m") - 1).cast("int").alias("o"), "v")
    base = at.where("g = 'BUILDING'").select("o", F.col("v").alias("w"))
    w = Window.partitionBy("g").orderBy("o").rangeBetween(-2, 0)
    num, den = (F.sum(F.col(c).cast("decimal(38,6)")).over(w).cast("double") for c in "vw")
    got = at.where("g != 'BUILDING'").join(base, "o").select("g", "o", F.round(100 * num / den, 4).alias("ratio"), F.count("*").over(w).alias("n"))
    return got.where("n = 3").drop("n")
