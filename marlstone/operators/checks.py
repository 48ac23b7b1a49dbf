"""Row-set validators and detectors across periods. A missing operand skips a check; it never passes or fails."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import quantiles

#: Rows of a group up to which runs are found side by side with those of other groups.
SIDE_BY_SIDE = 64
#: Rows of a task that counts distinct labels.
ROWS_A_TASK = 250_000


def tolerance(x: Column, base: float, rel: float) -> Column:
    return F.greatest(F.lit(float(base)), F.abs(x) * rel)


def verdict(left: Column, right: Column, base: float, rel: float) -> Column:
    """pass, fail, or skip where an operand is null."""
    return F.when(left.isNull() | right.isNull(), "skip").when(F.abs(left - right) <= tolerance(right, base, rel), "pass").otherwise("fail")


def parent_sums(nodes: DataFrame, child: str, parent: str, value: str, base: float = 3.0, rel: float = 5e-5) -> DataFrame:
    """Each parent against the sum of its direct children; a null child skips it."""
    kids = nodes.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("p")).agg(F.sum(F.col(value).cast("decimal(38,6)")).cast("double").alias("total"), F.count("*").alias("n"), F.count(value).alias("there"))
    got = nodes.select(F.col(child).alias("p"), F.col(value).alias("own")).join(kids, "p")
    total = F.when(F.col("n") == F.col("there"), F.col("total"))
    slack = base + F.col("n")
    ok = F.abs(F.col("own") - total) <= F.greatest(slack, F.abs(F.col("own")) * rel)
    return got.select(F.col("p").alias(child), "own", "total", F.when(total.isNull() | F.col("own").isNull(), "skip").when(ok, "pass").otherwise("fail").alias("verdict"))


def duplicate_keys(df: DataFrame, keys: list[str], label: str, value: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """Keys with more than one label and at least two non-zero values.

    Tasks grow in number with the rows, ``rows`` to each, and not in memory. A key's labels are spread
    over tasks, each label once; only their counts meet by key.
    """
    parts = max(1, -(-df.count() // rows))
    each = df.select(*keys, label, value).repartition(parts, *keys, label).groupBy(*keys, label).agg(F.count_if(F.col(value) != 0).alias("values"))
    return each.repartition(parts, *keys).groupBy(*keys).agg(F.count(label).alias("labels"), F.sum("values").alias("values")).where("labels > 1 and values >= 2")


def roll_up(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Passed, failed and skipped checks of each key, and whether it is in error: nothing passed or something failed."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    got = checks.groupBy(*keys).agg(n("pass").alias("passed"), n("fail").alias("failed"), n("skip").alias("skipped"))
    return got.withColumn("error", (F.col("passed") == 0) | (F.col("failed") > 0))


def increasing_spine(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows on the longest strictly increasing run of ``value`` (not always neighbours) along ``order``.

    Rows come sorted by group, and the runs of all groups of a batch are found side by side. A group
    is one statement, so it is bounded by what one statement holds. Of rows of one place the run takes
    one at most.
    """
    cols = [*keys, order, value]
    some = df.select(*cols)
    at = some.repartition(*keys).sortWithinPartitions(*keys, F.col(order).asc_nulls_last(), F.col(value).desc())
    return at.mapInArrow(_spines(len(keys)), some.schema)


def _spines(keys: int):
    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the last group so far
        for b in batches:
            if not b.num_rows:
                continue
            if held:
                seam = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b])
                first = _firsts(seam, keys)[1:] - 1
            else:
                first = _firsts(pa.Table.from_batches([b]), keys)[1:]
            if len(first):
                last = int(first[-1])
                yield from _kept(pa.Table.from_batches([*held, b.slice(0, last)]), keys)
                held = [b.slice(last)]
            else:
                held.append(b)
        if held:
            yield from _kept(pa.Table.from_batches(held), keys)

    return run


def _firsts(t: pa.Table, keys: int) -> np.ndarray:
    """Rows of a sorted table at which a group begins."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        code = t.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _kept(t: pa.Table, keys: int):
    """Rows of whole groups that lie on their group's run."""
    if not t.num_rows:
        return
    first = _firsts(t, keys)
    size = np.diff(np.append(first, t.num_rows))
    value = t.column(t.num_columns - 1)
    rank = pc.rank(value, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    rank[value.is_null().to_numpy()] = -1
    keep, width = np.zeros(t.num_rows, bool), np.frexp(size - 0.5)[1]  # groups of like size together
    for w in np.unique(width[size <= SIDE_BY_SIDE]).tolist():
        some = (width == w) & (size <= SIDE_BY_SIDE)
        _runs(rank, first[some], size[some], keep)
    for a, n in zip(first[size > SIDE_BY_SIDE].tolist(), size[size > SIDE_BY_SIDE].tolist(), strict=True):
        keep[[a + i for i in _run(rank[a : a + n].tolist())]] = True
    yield from t.filter(pa.array(keep)).to_batches()


def _run(ranks: list[int]) -> list[int]:
    """Places of a longest strictly increasing run; negative ranks never lie on it."""
    tails, ends, back = [], [], []
    for i, v in enumerate(ranks):
        if v < 0:
            back.append(None)
            continue
        k = bisect.bisect_left(tails, v)
        tails[k : k + 1] = [v]
        ends[k : k + 1] = [i]
        back.append(ends[k - 1] if k else None)
    at, out = ends[-1] if ends else None, []
    while at is not None:
        out.append(at)
        at = back[at]
    return out


def _runs(rank: np.ndarray, first: np.ndarray, size: np.ndarray, keep: np.ndarray) -> None:
    """``_run`` of many groups at a time, place by place."""
    groups, n, none = np.arange(len(first)), int(size.max()), np.iinfo(np.int64).max
    there = np.arange(n) < size[:, None]
    v = np.where(there, rank.take(first[:, None] + np.arange(n), mode="clip"), -1)
    tails, ends, back = np.full(v.shape, none), np.full(v.shape, -1), np.full(v.shape, -1)
    for j in range(n):
        g = np.flatnonzero(v[:, j] >= 0)
        x = v[g, j]
        k = (tails[g] < x[:, None]).sum(axis=1)
        back[g, j] = np.where(k > 0, ends[g, k - 1], -1)
        tails[g, k], ends[g, k] = x, j
    length = (tails < none).sum(axis=1)
    at = np.where(length > 0, ends[groups, length - 1], -1)
    for _ in range(int(length.max())):
        g = np.flatnonzero(at >= 0)
        keep[first[g] + at[g]] = True
        at[g] = back[g, at[g]]


def repeated_period(df: DataFrame, keys: list[str], line: str, order: str, value: str, least: int = 15, share: float = 0.95) -> DataFrame:
    """Periods in which nearly all comparable lines equal those of the period before."""
    before = df.select(*keys, line, (F.col(order) + 1).alias(order), F.col(value).alias("_was"))
    same = df.join(before, [*keys, line, order]).where(f"{value} is not null and _was is not null")
    got = same.groupBy(*keys, order).agg(F.count("*").alias("lines"), F.avg((F.col(value) == F.col("_was")).cast("int")).alias("same"))
    return got.where((F.col("lines") >= least) & (F.col("same") >= share))


def ratio_breaks(df: DataFrame, keys: list[str], order: str, value: str, low: float = 0.02, high: float = 50.0) -> DataFrame:
    """A value whose ratio to the position before lies outside the bounds: a change of unit."""
    before = df.select(*keys, (F.col(order) + 1).alias(order), F.col(value).alias("before"))
    ratio = F.col(value) / F.col("before")
    return df.join(before, [*keys, order]).where("before > 0").withColumn("ratio", ratio).where(~F.col("ratio").between(low, high))


def mismatch(a: Column, b: Column, floor: float = 1000.0) -> Column:
    """|a - b| over the larger; null if not comparable: one null, one zero, or both small."""
    top = F.greatest(F.abs(a), F.abs(b))
    odd = a.isNull() | b.isNull() | ((a == 0) != (b == 0)) | (top < floor)
    return F.when(~odd, F.abs(a - b) / F.nullif(top, F.lit(0.0)))


def sign_flips(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Series with values of both signs."""
    return df.groupBy(*keys).agg(F.count_if(F.col(value) > 0).alias("up"), F.count_if(F.col(value) < 0).alias("down")).where("up > 0 and down > 0")


def median_outliers(df: DataFrame, keys: list[str], value: str, factor: float = 8.0, least: int = 5) -> DataFrame:
    """Rows beyond ``factor`` times, or under its inverse of, their own key's median."""
    mid = quantiles(df, keys, value, [0.5], ["median"]).withColumnRenamed("there", "n").where(F.col("n") >= least)
    return df.join(mid, keys).where((F.col("median") > 0) & ((F.col(value) > factor * F.col("median")) | (F.col(value) < F.col("median") / factor)))


def coverage(expected: DataFrame, kinds: list[str], found: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected key and kind with its status: missing, error or ok.

    ``found``: keys, kind, rows, failed. The kinds are a short list of the caller.
    """
    every = expected.select(*keys).distinct().withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    got = every.join(found, [*keys, "kind"], "left")
    status = F.when(F.col("rows").isNull() | (F.col("rows") == 0), "missing").when(F.col("failed") > 0, "error").otherwise("ok")
    return got.select(*keys, "kind", status.alias("status"))


def anomaly_delta(now: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Anomalies new against the baseline, and those resolved."""
    new = now.select(key).distinct().join(baseline, key, "left_anti").withColumn("state", F.lit("new"))
    return new.unionByName(baseline.select(key).distinct().join(now, key, "left_anti").withColumn("state", F.lit("resolved")))


def before(column: Column, keys: list[str], order: str) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(order))


def signed_chain(base: Column, parts: list[Column], target: Column, tol: float = 3.0, rel: float = 5e-5) -> Column:
    """Whether parts lead from base to target, read as signed or as magnitudes to subtract; skip if one is null."""
    missing = base.isNull() | target.isNull()
    signed, plain = base, base
    for p in parts:
        missing = missing | p.isNull()
        signed, plain = signed + p, plain - F.abs(p)
    slack = tolerance(target, tol, rel)
    return F.when(missing, "skip").when((F.abs(signed - target) <= slack) | (F.abs(plain - target) <= slack), "pass").otherwise("fail")



def in_band(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNull(), "skip").when(value.between(low, high), "pass").otherwise("fail")


def collapses(df: DataFrame, keys: list[str], order: str, value: str, was: float, now: float) -> DataFrame:
    """Values at least ``was`` at the position before that fall under ``now``."""
    before = df.select(*keys, (F.col(order) + 1).alias(order), F.col(value).alias("before"))
    return df.join(before, [*keys, order]).where((F.col("before") >= was) & (F.col(value) < now))


def seam(old: DataFrame, new: DataFrame, keys: list[str], line: str, value: str, least: int = 3, share: float = 0.6) -> DataFrame:
    """Statement by statement: lines new, lines gone, and the power of ten if most lines moved by one."""
    a, b = old.select(*keys, line, F.col(value).alias("a")), new.select(*keys, line, F.col(value).alias("b"))
    got = a.join(b, [*keys, line], "full")
    log = F.log10(F.when((F.col("a") != 0) & (F.col("b") != 0), F.abs(F.col("b") / F.nullif(F.col("a"), F.lit(0.0)))))
    unit = F.when((F.abs(log - F.round(log)) < 0.01) & F.round(log).isin(-6, -3, 3, 6), F.round(log).cast("int"))
    agg = got.withColumn("u", unit).groupBy(*keys).agg(
        F.count_if(F.col("a").isNull()).alias("new_lines"), F.count_if(F.col("b").isNull()).alias("gone_lines"), F.count("u").alias("scaled"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.mode("u").alias("factor")
    )
    hit = (F.col("scaled") >= least) & (F.col("scaled") >= share * F.col("both"))
    return agg.select(*keys, "new_lines", "gone_lines", F.when(hit, F.col("factor")).alias("unit_switch"))


def flags(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, as an array."""
    return F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules)), lambda x: x.isNotNull())


def signal(kind: str, keys: list[str], payload: list[str]) -> list[Column]:
    """A deterministic id and a JSON payload of a finding."""
    return [F.concat_ws(":", F.lit(kind), *(F.col(k).cast("string") for k in keys)).alias("signal_id"), F.to_json(F.struct(*payload)).alias("payload")]


def capture_share(stored: DataFrame, printed: DataFrame, keys: list[str], value: str, factors=(1, 1000, 1000000)) -> DataFrame:
    """The share of stored amounts found among printed ones, at the factor that finds most."""
    a = stored.where(F.abs(value) >= 1).select(*keys, F.round(F.abs(value)).cast("decimal(38,0)").alias("v"), F.explode(F.array(*(F.lit(int(f)) for f in factors))).alias("factor"))
    b = printed.select(*keys, F.round(F.abs(value)).cast("decimal(38,0)").alias("p")).distinct().withColumn("hit", F.lit(1))
    met = a.withColumn("p", (F.col("v") * F.col("factor")).cast("decimal(38,0)")).join(b, [*keys, "p"], "left")
    each = met.groupBy(*keys, "factor").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("found"))
    return each.groupBy(*keys).agg(F.max("found").alias("found"), F.max_by("factor", F.struct("found", -F.col("factor"))).alias("factor"))
