"""Constraints over sets of rows, written as data and compiled to one aggregation for each statement.

An operand is a sum, a count or a single value over the rows of a statement that meet a
condition, of the period itself or of one before it; operands are put together by
arithmetic. A rule compares two of them, holds one to a band, or asks something of every row.
All operands of a statement are worked out in one aggregation by key, statements and
earlier periods meet in one more, and a rule whose operands aren't all there is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AMOUNT = "decimal(38,6)"


class Operand:
    """Something with a value for each key; arithmetic makes larger ones."""

    def __add__(self, other):
        return Formula(lambda a, b: a + b, (self, lift(other)))

    def __sub__(self, other):
        return Formula(lambda a, b: a - b, (self, lift(other)))

    def __mul__(self, other):
        return Formula(lambda a, b: a * b, (self, lift(other)))

    def __truediv__(self, other):
        return Formula(lambda a, b: a / F.nullif(b, F.lit(0.0)), (self, lift(other)))


@dataclass(frozen=True)
class Constant(Operand):
    value: float


@dataclass(frozen=True)
class Formula(Operand):
    of: object
    parts: tuple


@dataclass(frozen=True)
class Leaf(Operand):
    """``how``: sum (null if ``whole`` and any of its values is null), count or value. ``back``: periods before."""

    statement: str
    how: str
    value: str | None = None
    where: str | None = None
    back: int = 0
    whole: bool = True

    def before(self, back: int = 1) -> Leaf:
        return Leaf(self.statement, self.how, self.value, self.where, back, self.whole)

    def column(self) -> Column:
        held = F.expr(self.where) if self.where else F.lit(True)
        if self.how == "count":
            return F.count_if(held).cast("double")
        v = F.when(held, F.expr(self.value))
        if self.how == "value":
            return F.max(v).cast("double")
        total = F.sum(v.cast(AMOUNT)).cast("double")
        return F.when(F.count_if(held & F.expr(self.value).isNull()) == 0, total) if self.whole else total


def lift(x) -> Operand:
    return x if isinstance(x, Operand) else Constant(float(x))


def total(statement: str, value: str, where: str | None = None, whole: bool = True) -> Leaf:
    return Leaf(statement, "sum", value, where, 0, whole)


def one(statement: str, value: str, where: str | None = None) -> Leaf:
    return Leaf(statement, "value", value, where)


def count(statement: str, where: str | None = None) -> Leaf:
    return Leaf(statement, "count", None, where)


@dataclass(frozen=True)
class Rule:
    """``verdict``: from the operands' columns, true, false, or null for skip."""

    statement: str
    name: str
    operands: tuple
    verdict: object


def equal(statement: str, name: str, a, b, least: float = 3.0, rel: float = 1e-5) -> Rule:
    """Within ``least``, or ``rel`` of the larger side."""
    return Rule(statement, name, (lift(a), lift(b)), lambda x, y: F.abs(x - y) <= F.greatest(F.lit(least), rel * F.greatest(F.abs(x), F.abs(y))))


def at_most(statement: str, name: str, a, b, slack: float = 0.0) -> Rule:
    return Rule(statement, name, (lift(a), lift(b)), lambda x, y: x <= y + slack)


def less(statement: str, name: str, a, b) -> Rule:
    return Rule(statement, name, (lift(a), lift(b)), lambda x, y: x < y)


def between(statement: str, name: str, x, low: float, high: float) -> Rule:
    return Rule(statement, name, (lift(x),), lambda v: v.between(low, high))


def every(statement: str, name: str, condition: str, where: str | None = None) -> Rule:
    """Each row that can be judged meets the condition; skipped if there is none."""
    held = f"({where}) AND " if where else ""
    return Rule(statement, name, (count(statement, f"{held}NOT ({condition})"), count(statement, f"{held}({condition}) IS NOT NULL")), lambda bad, n: F.when(n > 0, bad == 0))


def required(statement: str, name: str, columns: list[str]) -> Rule:
    """A row is there, and none lacks one of the columns."""
    lacks = " OR ".join(f"{c} IS NULL" for c in columns)
    return Rule(statement, name, (count(statement, lacks), count(statement)), lambda bad, n: F.when(n > 0, bad == 0))


@dataclass
class Compiled:
    keys: list[str]
    period: str
    rules: list[Rule]
    leaves: dict = field(default_factory=dict)

    def __post_init__(self):
        for r in self.rules:
            for o in r.operands:
                self._collect(o)

    def _collect(self, o: Operand) -> None:
        if isinstance(o, Leaf):
            self.leaves.setdefault(o, f"_{len(self.leaves)}")
        elif isinstance(o, Formula):
            for p in o.parts:
                self._collect(p)

    def _column(self, o: Operand) -> Column:
        if isinstance(o, Constant):
            return F.lit(o.value)
        return F.col(self.leaves[o]) if isinstance(o, Leaf) else o.of(*map(self._column, o.parts))

    def operands(self, statements: dict[str, DataFrame]) -> DataFrame:
        """A row for each key of any statement, with all leaves."""
        parts = []
        for name, rows in statements.items():
            mine = {x: c for x, c in self.leaves.items() if x.statement == name}
            if not mine:
                continue
            flat = {x.before(0): f"{c}_own" for x, c in mine.items()}
            held = rows.groupBy(*self.keys, self.period).agg(*(x.column().alias(c) for x, c in flat.items()))
            for back in sorted({x.back for x in mine}):
                now = [F.col(flat[x.before(0)]).alias(c) for x, c in mine.items() if x.back == back]
                parts.append(held.select(*self.keys, (F.col(self.period) + back).cast("int").alias(self.period), *now, F.lit(back == 0).alias("_here")))
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        got = both.groupBy(*self.keys, self.period).agg(*(F.max(c).alias(c) for c in self.leaves.values()), F.max("_here").alias("_here"))
        return got.where("_here").drop("_here")  # keys of which only an earlier period is known say nothing

    def verdicts(self, statements: dict[str, DataFrame]) -> DataFrame:
        """``keys, period, statement, rule, verdict``: pass, fail or skip."""
        out = []
        for r in self.rules:
            ok = r.verdict(*map(self._column, r.operands))
            # counts of a statement that isn't there are null
            out.append(F.struct(F.lit(r.statement).alias("statement"), F.lit(r.name).alias("rule"), F.when(ok, "pass").when(~ok, "fail").otherwise("skip").alias("verdict")))
        return self.operands(statements).select(*self.keys, self.period, F.inline(F.array(*out)))
