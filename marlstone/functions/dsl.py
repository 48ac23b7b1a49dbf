"""A declarative language of derived series, compiled to DataFrames.

A spec lists series in order. Each has a key and one source: a base series of the
caller, or a transform of siblings listed before it. Nothing is computed here; each
series is a plan over columns ``d`` (date) and ``v``.

Transforms: scale(series, factor), sum(series...), ratio(num, den, scale),
growth(series, rows, yoy), rolling(series, n, scale), formula(node), where a node is
``{"ref": key}``, ``{"const": x}`` or ``{"op": add|sub|mul|div, "args": [a, b]}``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import series as S

ARITY = {"scale": 1, "sum": None, "ratio": 2, "growth": 1, "rolling": 1}


def _refs(node) -> list[str]:
    if not isinstance(node, dict):
        return []
    if "ref" in node:
        return [node["ref"]]
    return [r for a in node.get("args", []) for r in _refs(a)]


def _nodes(node) -> list[str]:
    """What is wrong with the nodes of a formula."""
    if not isinstance(node, dict) or not {"ref", "const", "op"} & set(node):
        return ["a node is a ref, a const or an op"]
    if "op" not in node:
        return []
    args = node.get("args", [])
    wrong = [] if node["op"] in ("add", "sub", "mul", "div") else [f"unknown operation {node['op']}"]
    wrong += [] if len(args) == 2 else ["an operation takes two arguments"]
    return wrong + [w for a in args for w in _nodes(a)]


def problems(spec: dict, known: set[str]) -> list[str]:
    """What is wrong with a spec: missing fields, doubled keys, unknown or later references, wrong arity."""
    out, seen = [], set()
    for field in ("id", "title", "series"):
        if not spec.get(field):
            out.append(f"missing {field}")
    for s in spec.get("series", []):
        key, kind = s.get("key"), s.get("transform")
        if not key or key in seen:
            out.append(f"key {key} is missing or doubled")
        if kind is None:
            if s.get("source") not in known:
                out.append(f"{key}: unknown source {s.get('source')}")
        elif kind == "formula":
            out += [f"{key}: {r} is not listed before" for r in _refs(s.get("formula")) if r not in seen]
            out += [f"{key}: {w}" for w in _nodes(s.get("formula"))]
            if not _refs(s.get("formula")):
                out.append(f"{key}: a formula needs a series")
        elif kind not in ARITY:
            out.append(f"{key}: unknown transform {kind}")
        else:
            refs = s.get("of", [])
            out += [f"{key}: {r} is not listed before" for r in refs if r not in seen]
            if ARITY[kind] is not None and len(refs) != ARITY[kind] or not refs:
                out.append(f"{key}: {kind} takes {ARITY[kind] or 'some'} series")
        seen.add(key)
    return out


def _formula(node: dict, done: dict[str, DataFrame]):
    if "ref" in node:
        return done[node["ref"]]
    if "const" in node:
        return float(node["const"])
    a, b = (_formula(x, done) for x in node["args"])
    op = node["op"]
    if isinstance(a, DataFrame) and isinstance(b, DataFrame):
        return S.combine(a, b, ["d"], "v", op)
    if isinstance(a, float) and isinstance(b, float):
        raise ValueError("a formula needs a series")
    df, x, y = (a, F.col("v"), F.lit(b)) if isinstance(a, DataFrame) else (b, F.lit(a), F.col("v"))
    if op == "div":
        df = df.where(y != 0)
    return df.select("d", {"add": x + y, "sub": x - y, "mul": x * y, "div": x / y}[op].alias("v"))


def resolve(spec: dict, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every series of the spec as a DataFrame ``d, v``; ValueError if the spec is wrong."""
    wrong = problems(spec, set(sources))
    if wrong:
        raise ValueError("; ".join(wrong))
    done: dict[str, DataFrame] = {}
    for s in spec["series"]:
        kind, of = s.get("transform"), [done[r] for r in s.get("of", [])]
        if kind is None:
            got = sources[s["source"]].select("d", "v")
        elif kind == "scale":
            got = of[0].select("d", (F.col("v") * float(s["factor"])).alias("v"))
        elif kind == "sum":
            got = reduce(DataFrame.unionByName, of).groupBy("d").agg(F.sum(F.col("v").cast("decimal(38,6)")).cast("double").alias("v"))
        elif kind == "ratio":
            got = S.combine(of[0], of[1], ["d"], "v", "div").select("d", (F.col("v") * float(s.get("scale", 1))).alias("v"))
        elif kind == "growth":
            n = int(s["rows"])
            got = S.lag_growth(of[0].withColumn("k", F.lit(s["key"])), ["k"], "d", "v", n, 1.0 if s.get("yoy") else 52 / n).select("d", F.col("growth").alias("v"))
        elif kind == "rolling":
            got = S.rolling(of[0].withColumn("k", F.lit(s["key"])), ["k"], "d", "v", int(s["n"]), "sum", "r").select("d", (F.col("r") * float(s.get("scale", 1))).alias("v"))
        else:
            got = _formula(s["formula"], done)
        done[s["key"]] = got
    return done


def check_rows(spec: dict, done: dict[str, DataFrame]) -> DataFrame:
    """The spec's assertions as rows: series, date prefix, value at its last date, whether it is near enough. One plan for all."""
    rows = []
    for c in spec.get("verify", []):
        want, tol = float(c["value"]), float(c["tolerance"])
        slack = abs(want) * tol / 100 if c.get("tolerance_unit") == "percent" else tol
        got = done[c["series"]].where(F.col("d").cast("string").startswith(c["date"])).agg(F.max_by("v", "d").cast("double").alias("got"))
        rows.append(got.select(F.lit(c["series"]).alias("series"), F.lit(c["date"]).alias("date"), "got", F.coalesce(F.abs(F.col("got") - want) <= slack, F.lit(False)).alias("near")))
    return reduce(DataFrame.unionByName, rows)


def checks(spec: dict, done: dict[str, DataFrame]) -> list[tuple[str, str, float | None, bool]]:
    """The rows of ``check_rows`` as a list."""
    return [tuple(r) for r in check_rows(spec, done).collect()] if spec.get("verify") else []
