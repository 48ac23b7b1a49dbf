"""A read-only gateway: SQL is analysed by Spark, and its plan is checked before it runs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .populations import Populations, Refused

MAX_TEXT, ROW_CAP = 2000, 200
#: Leaves of plans that read nothing: literals, and references to what was walked elsewhere.
NO_DATA = frozenset({"OneRowRelation", "LocalRelation", "CTERelationRef"})
#: Functions that reach beyond the data.
REACH = re.compile(r"\b(try_)?(reflect|java_method)\s*\(|\binput_file_", re.I)


@dataclass(frozen=True)
class Policy:
    """What statements may read.

    ``tables``: views that may be read. ``partitions``: column -> family of each code,
    for columns whose families overlap; a sum over such a column must keep to one
    family or group by it. ``named``: columns whose literals the question must name.
    """

    tables: frozenset[str]
    partitions: dict[str, dict[str, str]] = field(default_factory=dict)
    named: frozenset[str] = frozenset()
    cap: int = ROW_CAP


@dataclass(frozen=True)
class Answer:
    reason: str | None
    rows: DataFrame | None = None


def _nodes(plan) -> list:
    """All nodes of a logical plan."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        for seq in (p.children(), p.subqueries(), p.innerChildren()):
            todo += [x for x in (seq.apply(i) for i in range(seq.size())) if hasattr(x, "children") and hasattr(x, "subqueries")]
    return out


def _outside(plan, allowed: frozenset[str]) -> set[str]:
    """What a plan reads that is not inside an allowed view: other views, tables, files."""
    found, todo = set(), [plan]
    while todo:
        p = todo.pop()
        if p.nodeName() == "View" and (name := p.desc().identifier().table()) in allowed:
            continue
        if p.nodeName() == "View":
            found.add(name)
            continue
        kids = [x for seq in (p.children(), p.subqueries(), p.innerChildren()) for x in (seq.apply(i) for i in range(seq.size())) if hasattr(x, "children") and hasattr(x, "subqueries")]
        if not kids and p.nodeName() not in NO_DATA:
            found.add(p.nodeName())
        todo += kids
    return found


def ask(spark: SparkSession, sql: str, policy: Policy, question: str = "") -> Answer:
    """Check a statement and give its rows, one more than the cap at most, so that cut results show."""
    if len(sql) > MAX_TEXT:
        return Answer("too long")
    try:
        frame = spark.sql("SELECT * FROM (\n" + sql.strip().rstrip(";") + "\n) AS asked")
    except (ParseException, AnalysisException) as e:
        return Answer(f"not a single query over known tables: {str(e).splitlines()[0][:120]}")
    nodes = _nodes(frame._jdf.queryExecution().analyzed())
    names = [n.nodeName() for n in nodes]
    if any("Command" in n or "Insert" in n for n in names):
        return Answer("it writes")
    if REACH.search(sql):
        return Answer("it calls a function that reaches beyond the data")
    if outside := _outside(frame._jdf.queryExecution().analyzed(), policy.tables):
        return Answer(f"it reads {sorted(outside)}")
    found = Populations(policy.partitions, policy.named, policy.tables)
    try:
        found.check(frame._jdf.queryExecution().analyzed())
    except Refused as e:
        return Answer(str(e))
    if column := found.unnamed(question):
        return Answer(f"it pins codes of {column} that the question doesn't name")
    return Answer(None, frame.limit(policy.cap + 1))


def unsupported_figures(answers: DataFrame, key: str, text: str, allowed: DataFrame, value: str, least: float = 1000.0, rel: float = 1e-4) -> DataFrame:
    """Figures of ``least`` or more in texts that are near no allowed value of the same key."""
    found = F.explode(F.regexp_extract_all(text, F.lit(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"), F.lit(0)))
    figures = answers.select(key, found.alias("printed")).withColumn("figure", F.replace("printed", F.lit(","), F.lit("")).cast("double")).where(F.col("figure") >= least).distinct()
    near = (F.col("x.figure") - F.col(f"y.{value}"))
    close = F.abs(near) <= F.greatest(F.lit(0.01), F.abs(F.col(f"y.{value}")) * rel)
    return figures.alias("x").join(allowed.alias("y"), (F.col(f"x.{key}") == F.col(f"y.{key}")) & close, "left_anti").select(key, "printed", "figure")
