"""Statements whose sums keep to one family of codes are let through, their wider twins are not."""

import pytest

from marlstone.plans import gateway

FAMILIES = {"T": "total", "L1": "licence", "L2": "licence", "O1": "owner", "O2": "owner"}


@pytest.fixture(scope="module")
def ask(spark):
    rows = [("b1", c, "x", 1.0) for c in (*FAMILIES, None, "new")]
    spark.createDataFrame(rows, "bank string, code string, item string, v double").createOrReplaceTempView("pop_t")
    spark.createDataFrame([("T", "whole"), ("L1", "part")], "code string, name string").createOrReplaceTempView("pop_names")
    policy = gateway.Policy(frozenset({"pop_t", "pop_names"}), {"code": FAMILIES}, frozenset({"bank"}))
    yield lambda sql, question="": gateway.ask(spark, sql, policy, question).reason
    for v in ("pop_t", "pop_names"):
        spark.catalog.dropTempView(v)


S = "SELECT sum(v) AS s FROM pop_t"
FINE = [
    f"{S} WHERE code = 'T'",
    f"{S} WHERE 'T' = code AND v > 0",
    f"{S} WHERE code IN ('L1', 'L2')",
    f"{S} WHERE code = 'L1' OR code = 'L2'",
    f"{S} WHERE (code = 'L1' AND v > 0) OR (v < 0 AND code = 'L2')",
    f"{S} WHERE NOT (code <> 'T')",
    f"{S} WHERE NOT (code <> 'L1' AND code <> 'L2')",
    f"{S} WHERE code IN ('T', 'L1') AND code NOT IN ('L1')",
    f"{S} WHERE code = 'T' GROUP BY bank",
    f"{S} WHERE code = 'T' AND bank IN (SELECT bank FROM pop_t)",
    f"{S} WHERE upper(code) = 'T' AND code IN ('T', 'O1')",
    f"{S} WHERE CASE WHEN code = 'T' THEN true ELSE false END",
    "SELECT code, sum(v) AS s FROM pop_t GROUP BY code",
    "SELECT code AS c, avg(v) AS s FROM pop_t GROUP BY 1 HAVING sum(v) > 0",
    "SELECT count(*) AS n, max(v) AS m FROM pop_t",
    "SELECT v FROM pop_t",
    "SELECT sum(CASE WHEN code = 'T' THEN v END) AS s FROM pop_t",
    "SELECT sum(CASE WHEN code = 'T' THEN v ELSE 0 END) AS s, sum(v) FILTER (WHERE code IN ('O1', 'O2')) AS o FROM pop_t",
    "SELECT sum(if(code = 'L1', 1, 0) * v) AS s FROM pop_t",
    "SELECT sum(CASE WHEN code = 'L1' THEN v END) / sum(CASE WHEN code = 'T' THEN v END) AS share FROM pop_t",
    "SELECT sum(CASE WHEN code = 'L1' THEN v END) + sum(CASE WHEN code = 'L2' THEN v END) AS s FROM pop_t",
    "SELECT sum(v) OVER (PARTITION BY code) AS s FROM pop_t",
    "SELECT row_number() OVER (ORDER BY v) AS k FROM pop_t",
    "SELECT sum(v) OVER (ORDER BY v) AS s FROM pop_t WHERE code = 'T'",
    "WITH a AS (SELECT code AS c, v FROM pop_t WHERE code = 'T') SELECT sum(v) AS s FROM a",
    "WITH a AS (SELECT code AS c, v FROM pop_t) SELECT sum(v) AS s FROM a WHERE c = 'T'",
    "SELECT sum(s) AS s FROM (SELECT code, sum(v) AS s FROM pop_t GROUP BY code) WHERE code = 'T'",
    "SELECT sum(v) AS s FROM (SELECT * FROM pop_t WHERE code = 'L1' UNION ALL SELECT * FROM pop_t WHERE code = 'L2')",
    "SELECT sum(t.v) AS s FROM pop_t t JOIN pop_names n ON t.code = n.code WHERE n.code = 'T'",
    "SELECT t.code, sum(t.v) AS s FROM pop_t t JOIN pop_names n ON t.code = n.code GROUP BY t.code",
    "SELECT sum(v) AS s FROM pop_t WHERE code IN (SELECT code FROM pop_names WHERE code = 'T')",
    "SELECT code, v / (SELECT sum(v) FROM pop_t WHERE code = 'T') AS share FROM pop_t",
    "SELECT a.code, (SELECT sum(b.v) FROM pop_t b WHERE b.code = a.code) AS s FROM pop_t a",
    "SELECT sum(v) AS s FROM pop_t WHERE code LIKE 'L_' AND code IN ('L1', 'L2', 'T')",
    "SELECT sum(v) AS s FROM (SELECT v, code FROM pop_t ORDER BY v LIMIT 3) WHERE code = 'O1'",
]
MIXED = [
    S,
    f"{S} WHERE code <> 'T'",
    f"{S} WHERE code = 'T' OR v > 0",
    f"{S} WHERE code = 'T' OR code = 'L1'",
    f"{S} WHERE code IN ('T', 'L1', 'L2')",
    f"{S} WHERE code IN ('L1', 'O1')",
    f"{S} WHERE code NOT IN ('T')",
    f"{S} WHERE NOT (code = 'T')",
    f"{S} WHERE NOT (code <> 'T' AND v > 0)",
    f"{S} WHERE code LIKE 'L%'",
    f"{S} WHERE code >= 'L'",
    f"{S} WHERE code = item",
    f"{S} WHERE code IS NOT NULL",
    f"{S} WHERE substring(code, 1, 1) = 'L'",
    f"{S} WHERE code = 'new'",
    f"{S} WHERE code IN ('T', 'L1') /* code = 'T' */",
    f"{S} WHERE coalesce(code, 'T') = 'T'",
    "SELECT avg(v) AS s FROM pop_t GROUP BY bank",
    "SELECT sum(v) AS s FROM pop_t GROUP BY upper(code)",
    "SELECT sum(v) OVER () AS s FROM pop_t",
    "SELECT sum(v) OVER (PARTITION BY bank ORDER BY v) AS s FROM pop_t",
    "SELECT code, sum(v) AS s FROM pop_t GROUP BY ROLLUP (code)",
    "SELECT sum(s) AS s FROM (SELECT code, sum(v) AS s FROM pop_t GROUP BY code)",
    "SELECT sum(v) AS s FROM (SELECT v FROM pop_t)",
    "SELECT sum(v) AS s FROM (SELECT 'T' AS code, v FROM pop_t) WHERE code = 'T'",
    "SELECT sum(CASE WHEN code = 'T' THEN v ELSE 1 END) AS s FROM pop_t",
    "SELECT avg(CASE WHEN code = 'T' THEN v ELSE 0 END) AS s FROM pop_t",
    "SELECT sum(CASE WHEN v > 0 THEN v END) AS s FROM pop_t",
    "SELECT sum(CASE WHEN code = 'T' THEN v END) + sum(CASE WHEN code = 'L1' THEN v END) AS s FROM pop_t",
    "SELECT (SELECT sum(v) FROM pop_t WHERE code = 'T') + (SELECT sum(v) FROM pop_t WHERE code = 'O1') AS s",
    "SELECT a + b AS s FROM (SELECT sum(CASE WHEN code = 'T' THEN v END) AS a, sum(CASE WHEN code = 'L1' THEN v END) AS b FROM pop_t)",
    "SELECT max(v) AS m, (SELECT sum(v) FROM pop_t) AS s FROM pop_t WHERE code = 'T'",
    "SELECT code FROM pop_t WHERE v < (SELECT avg(v) FROM pop_t)",
    "SELECT code FROM pop_t WHERE v IN (SELECT sum(v) FROM pop_t GROUP BY bank)",
    "WITH a AS (SELECT code AS c, v FROM pop_t) SELECT sum(v) AS s FROM a",
    "WITH a AS (SELECT * FROM pop_t WHERE code = 'T'), b AS (SELECT * FROM a UNION ALL SELECT * FROM pop_t WHERE code = 'O1') SELECT sum(v) AS s FROM b",
    "SELECT sum(t.v) AS s FROM pop_t t LEFT JOIN pop_names n ON t.code = n.code AND n.code = 'T'",
    "SELECT sum(t.v) AS s FROM pop_t t JOIN pop_names n ON t.item = n.name WHERE n.code = 'T'",
    "SELECT sum(t.v) AS s FROM pop_t t JOIN pop_t u ON t.bank = u.bank WHERE t.code = 'T'",
    "SELECT sum(v) AS s FROM pop_t WHERE code NOT IN (SELECT code FROM pop_names WHERE code = 'T')",
    "SELECT sum(v) AS s FROM pop_t WHERE EXISTS (SELECT 1 FROM pop_names WHERE pop_names.code = 'T')",
    "SELECT stddev(v) AS s FROM pop_t",
    "SELECT bank, sum(v) AS s FROM (SELECT bank, code, v FROM pop_t) PIVOT (sum(v) FOR item IN ('x')) GROUP BY bank",
]


@pytest.mark.parametrize("sql", FINE)
def test_one_family(ask, sql):
    assert ask(sql) is None


@pytest.mark.parametrize("sql", MIXED)
def test_several_families(ask, sql):
    assert ask(sql)


NAMED = [
    ("bank IN ('alpha', 'beta')", "how is alpha against beta", True),
    ("bank IN ('alpha', 'beta')", "how is alpha", False),
    ("bank = 'alpha' OR bank = 'beta'", "rank all", False),
    ("bank = 'alpha'", "rank all", True),
    ("bank NOT IN ('alpha', 'beta')", "rank all", False),
    ("bank <> 'alpha' AND bank <> 'beta'", "rank all but alpha and beta", True),
    ("bank LIKE 'al%' OR bank LIKE 'be%'", "rank all", False),
    ("bank LIKE 'al%'", "those that begin with al", True),
    ("substring(bank, 1, 1) = 'a'", "rank all", False),
    ("bank > 'm'", "rank all", False),
    ("bank IS NOT NULL AND v > 3", "rank all", True),
    ("(bank = 'alpha' AND v > 1) OR (bank = 'beta' AND v > 2)", "rank all", False),
]


@pytest.mark.parametrize("where, question, fine", NAMED)
def test_codes_that_the_question_names(ask, where, question, fine):
    reason = ask(f"SELECT v FROM pop_t WHERE {where}", question)
    assert (reason is None) == fine and (fine or "doesn't name" in reason)
    inside = ask(f"SELECT * FROM (SELECT bank AS b, v FROM pop_t) WHERE {where.replace('bank', 'b')}", question)
    assert (inside is None) == fine
