"""Constraints by hand, and each seeded fault found by its own rule and no other."""

from pyspark.sql import functions as F

from marlstone.operators import constraints as C
from marlstone.plans import constraint_queries as Q


def judged(spark, rules, **tables):
    frames = {n: spark.createDataFrame(rows, schema) for n, (rows, schema) in tables.items()}
    got = C.Compiled(["g"], "o", rules).verdicts(frames)
    return {(r.g, r.o, r.rule): r.verdict for r in got.collect()}


def test_sums_skip_and_tolerate(spark):
    rules = [
        C.equal("s", "sum", C.total("s", "v", "k = 'p'"), C.one("s", "v", "k = 't'")),
        C.equal("s", "loose", C.total("s", "v", "k = 'p'", whole=False), C.one("s", "v", "k = 't'")),
        C.between("s", "band", C.one("s", "v", "k = 't'") / C.total("s", "v", "k = 'p'"), 0.9, 1.1),
        C.every("s", "positive", "v > 0"),
        C.required("s", "filled", ["k", "v"]),
        C.less("s", "fewer", C.count("s", "k = 'p'"), C.count("s")),
    ]
    rows = [
        (1, 1, "p", 10.0), (1, 1, "p", 20.0), (1, 1, "t", 33.0),  # three off is allowed
        (1, 2, "p", 10.0), (1, 2, "p", None), (1, 2, "t", 10.0),  # a part is missing
        (1, 3, "p", 1e9), (1, 3, "t", 1e9 + 9000.0), (1, 4, "p", 10.0), (1, 4, "t", 14.0),
        (1, 5, "t", 4.0), (1, 6, "p", 0.0), (1, 6, "t", 1.0), (1, 7, None, None),
    ]
    got = judged(spark, rules, s=(rows, "g int, o int, k string, v double"))
    of = lambda rule: [got[1, o, rule] for o in range(1, 8)]
    assert of("sum") == ["pass", "skip", "pass", "fail", "skip", "pass", "skip"]
    assert of("loose") == ["pass", "pass", "pass", "fail", "skip", "pass", "skip"]
    assert of("band") == ["pass", "skip", "pass", "fail", "skip", "skip", "skip"]
    assert of("positive") == ["pass", "pass", "pass", "pass", "pass", "fail", "skip"]
    assert of("filled") == ["pass", "fail", "pass", "pass", "pass", "pass", "fail"]
    assert of("fewer") == ["pass"] * 7


def test_other_tables_and_periods(spark):
    rules = [
        C.equal("a", "cross", C.one("a", "v"), C.one("b", "w") + 1),
        C.equal("a", "roll", C.one("a", "v").before() + C.one("b", "w").before(2) * 10, C.one("a", "v")),
        C.at_most("b", "most", C.one("b", "w"), C.one("a", "v"), 5),
    ]
    got = judged(spark, rules, a=([(1, 1, 3.0), (1, 2, 7.0), (1, 3, 27.0)], "g int, o int, v double"), b=([(1, 1, 2.0), (1, 4, 99.0), (2, 1, None)], "g int, o int, w double"))
    assert got[1, 1, "cross"] == "pass" and got[1, 2, "cross"] == "skip" and got[1, 3, "roll"] == "pass" and got[1, 2, "roll"] == "skip"
    assert got[1, 4, "most"] == "skip" and got[2, 1, "most"] == "skip" and got[1, 1, "most"] == "pass"
    assert (1, 5, "roll") not in got  # only an earlier period is known


def test_each_fault_is_found_by_its_rule_alone(spark, sf):
    got = Q.statement_constraints(spark, sf).where("verdict = 'fail'").withColumn("h", F.pmod(F.col("g") * 31 + F.col("o"), F.lit(41))).collect()
    assert got and all(Q.FAULTS[r.h] == (r.statement, r.rule) for r in got)
    assert {r.h for r in got} == set(Q.FAULTS)
    assert {(r.statement, r.name) for r in Q.RULES} == set(Q.FAULTS.values())
