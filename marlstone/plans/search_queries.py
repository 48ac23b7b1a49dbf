"""Text search through an index, stakes between entities, contradictions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import contradictions as X
from ..operators import ownership as O
from ..operators.textindex import TextIndex
from ..sources.tables import money, shared_dir, table
from .registry import query

#: Terms of the search, any of which may stand.
TERMS = "idiot OR license, version OR CC by-nc OR enti"


@query("""WITH f AS (SELECT doc_id, text, lower(translate(text, 'çğıöşüÇĞİÖŞÜâîûÂÎÛ', 'cgiosucgiosuaiuaiu')) AS t FROM documents WHERE doc_id IS NOT NULL), q(term) AS (VALUES ('idiot'), ('license, version'), ('cc by-nc'), ('enti')),
    h AS (SELECT term, doc_id, text, string_split(t, term) AS s FROM f, q WHERE contains(t, term)), p AS (SELECT *, unnest(range(1, len(s))) AS k FROM h),
    a AS (SELECT term, doc_id, text, (list_sum(list_transform(s[1:k], lambda x: length(x))) + (k - 1) * length(term) + 1)::BIGINT AS place FROM p)
    SELECT term, doc_id, place AS "at", regexp_replace(substr(text, greatest(1, place - 160)::BIGINT, (place + length(term) + 160 - greatest(1, place - 160))::BIGINT), '\\s+', ' ', 'g') AS context, count(*) OVER (PARTITION BY term) AS found FROM a""")
def text_search_context(spark, sf):
    """Every place of some terms with what is around it, and how often each term stands, through an index of words."""
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    index = TextIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", 8)
    index.build(docs, "doc_id", "text")
    return index.search(docs, "doc_id", "text", TERMS)


STAKES = """m AS (SELECT c_nationkey AS n, l_suppkey AS s, l_quantity AS q, l_extendedprice::DECIMAL(18,2) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
    h AS (SELECT n, s, sum(v)::DOUBLE AS share FROM m WHERE q >= 49 GROUP BY ALL), u AS (SELECT s AS n, n AS other, sum(v)::DOUBLE AS share FROM m WHERE q >= 48 AND s < 25 GROUP BY ALL)"""


def _stakes(spark, sf):
    """Suppliers that a nation names as holders, nations that a supplier of the same number as a nation names as subsidiaries; and the entities by key."""
    lines, orders, customers = table(spark, sf, "lineitem", ["l_suppkey", "l_orderkey", "l_quantity", "l_extendedprice"]), table(spark, sf, "orders", ["o_orderkey", "o_custkey"]), table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    met = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    total = F.sum(money("l_extendedprice")).cast("double").alias("share")
    holders = met.where("l_quantity >= 49").groupBy(F.col("c_nationkey").cast("long").alias("n"), F.format_string("  SUPPLIER  No.%d", F.col("l_suppkey")).alias("name")).agg(total).withColumn("kind", F.lit("holder"))
    subs = met.where("l_quantity >= 48 and l_suppkey < 25").groupBy(F.col("l_suppkey").alias("n"), F.format_string("Nation (%d)", F.col("c_nationkey")).alias("name")).agg(total).withColumn("kind", F.lit("sub"))
    key = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "))
    stakes = O.links(holders.unionByName(subs), "n", "kind", "name", "share", key)
    nations = table(spark, sf, "nation", ["n_nationkey"]).select(F.col("n_nationkey").cast("long").alias("entity"))
    keys = [F.format_string("supplier no %d", F.col("entity")), F.format_string("nation %d", F.col("entity"))]
    return stakes, nations.select(F.explode(F.array(*keys)).alias("key"), "entity")


@query(f"""WITH {STAKES}, e AS (SELECT s AS owner, n AS owned, 'holder' AS kind, share FROM h WHERE s < 25 UNION ALL SELECT n, other, 'sub', share FROM u) SELECT owner, owned, arg_min(kind, kind) AS kind, arg_min(share, kind) AS share FROM e GROUP BY ALL""")
def ownership_edges(spark, sf):
    """Who owns whom: what the owned side files counts before what the owner files."""
    return O.edges(*_stakes(spark, sf))


@query(f"""WITH {STAKES}, l AS (SELECT DISTINCT s, n FROM h WHERE s >= 25), d AS (SELECT s, count(*) AS degree FROM l GROUP BY s HAVING count(*) >= 2), x AS (SELECT * FROM l JOIN d USING (s))
    SELECT x.n AS a, y.n AS b, NULL AS holder, round(sum(1 / (x.degree - 1)), 6) AS weight, count(*) AS names FROM x JOIN x y ON x.s = y.s AND x.n < y.n WHERE x.degree <= 15 GROUP BY ALL UNION ALL SELECT n, NULL, 'supplier no ' || s, 1, 1 FROM x WHERE degree > 15""")
def shared_holders(spark, sf):
    """Nations joined by the suppliers they share; suppliers of over 15 nations stay hubs."""
    return O.projection(*_stakes(spark, sf), up_to=15).withColumn("weight", F.round("weight", 6))


@query("""WITH s AS (SELECT o_orderpriority AS g, o_custkey AS k, list(DISTINCT o_orderstatus) AS v FROM orders GROUP BY ALL) SELECT a.g, a.k, count(*) FILTER (NOT list_has_any(a.v, b.v)) AS conflicts, count(*) AS statements FROM s a JOIN s b ON a.g = b.g GROUP BY ALL""")
def contradictions(spark, sf):
    """For each statement on a subject, how many others share no value with it."""
    said = table(spark, sf, "orders", ["o_orderpriority", "o_custkey", "o_orderstatus"]).groupBy(F.col("o_orderpriority").alias("g"), F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderstatus").alias("v"))
    return X.conflicts(said, "g", "k", "v")
