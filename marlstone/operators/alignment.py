"""Ordered labels against ordered names: statement lines to the roles of templates, header fragments to bands.

Both are one dynamic programme: names keep their order, labels keep theirs, each is used once
at most, and what fits best wins. A statement or a header is a few dozen labels, gathered
per filing; the programme runs inside Arrow batches of filings.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def order_match(fits: list[list[float]]) -> list[int | None]:
    """For each name the label it takes, or None, at the greatest sum of fits; ties: earlier labels, first names first.

    ``fits[name][label]``: 0 where they don't meet.
    """
    names, labels = len(fits), len(fits[0]) if fits else 0
    best = [[0.0] * (labels + 1) for _ in range(names + 1)]  # of names from i on and labels from j on
    for i in range(names - 1, -1, -1):
        for j in range(labels - 1, -1, -1):
            take = fits[i][j] + best[i + 1][j + 1] if fits[i][j] else 0.0
            best[i][j] = max(take, best[i + 1][j], best[i][j + 1])
    out, j = [], 0
    for i in range(names):
        at = next((k for k in range(j, labels) if fits[i][k] and fits[i][k] + best[i + 1][k + 1] == best[i][j]), None)
        out.append(at)
        j = j if at is None else at + 1
    return out


@dataclass(frozen=True)
class Role:
    name: str
    pattern: str
    weight: float = 1.0
    required: bool = False


@dataclass(frozen=True)
class Template:
    name: str
    roles: tuple[Role, ...]


def align(labels: list[str | None], templates: tuple[Template, ...]) -> tuple[str | None, float, list[tuple[str, int]]]:
    """The template that labels fit best, its score, and each role found with its place (from 1).

    A template counts only if all its required roles are found in order; of equal scores the first wins.
    """
    top: tuple[str | None, float, list[tuple[str, int]]] = (None, 0.0, [])
    for t in templates:
        must = 1 + sum(r.weight for r in t.roles)  # a required role goes before all others together
        fits = [[r.weight + must * r.required if x is not None and re.search(r.pattern, x) else 0.0 for x in labels] for r in t.roles]
        at = order_match(fits) if labels else [None] * len(t.roles)
        score = sum(r.weight for r, k in zip(t.roles, at, strict=True) if k is not None)
        if all(k is not None for r, k in zip(t.roles, at, strict=True) if r.required) and score > top[1]:
            top = (t.name, score, [(r.name, k + 1) for r, k in zip(t.roles, at, strict=True) if k is not None])
    return top


def aligned(labels: str | Column, templates: tuple[Template, ...]) -> Column:
    """A struct of ``template, score, roles`` (a map of role to place) for an array of labels in order."""
    kind = T.StructType([T.StructField("template", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("roles", T.MapType(T.StringType(), T.IntegerType()))])

    @arrow_udf(kind)
    def run(rows: pa.Array) -> pa.Array:
        known = functools.cache(lambda x: align(list(x), templates))
        found = [known(tuple(x or ())) for x in rows.to_pylist()]
        shape = pa.struct([("template", pa.string()), ("score", pa.float64()), ("roles", pa.map_(pa.string(), pa.int32()))])
        return pa.array([{"template": n, "score": s, "roles": r} for n, s, r in found], shape)

    return run(labels)


def chain_verdict(base: Column, deductions: list[Column], target: Column, least: float = 3.0, rel: float = 5e-5) -> Column:
    """``filed`` if deductions are filed with their sign, ``absolute`` if as amounts to take off, ``fail``, or ``skip`` if a part is missing.

    Where both hold, because there is nothing to deduct, they are ``filed``.
    """
    room = F.greatest(F.lit(least), rel * F.abs(target))
    signed = functools.reduce(lambda a, b: a + b, deductions, base)
    absolute = functools.reduce(lambda a, b: a - F.abs(b), deductions, base)
    return F.when(F.abs(signed - target) <= room, "filed").when(F.abs(absolute - target) <= room, "absolute").when(F.abs(signed - target).isNotNull(), "fail").otherwise("skip")


def headers(columns: list[float], fragments: list[tuple[float, float, str]]) -> list[str]:
    """The header text of each column: every fragment goes to the column nearest to it, those of one column are read from above, then from the left.

    ``fragments``: place across, place down, text.
    """
    texts: list[list] = [[] for _ in columns]
    for x, y, text in fragments:
        near = min(range(len(columns)), key=lambda k: (abs(columns[k] - x), k))
        texts[near].append((y, x, text))
    return [" ".join(t for _, _, t in sorted(part)) for part in texts]


def column_model(columns: list[float], fragments: list[tuple[float, float, str]], bands: tuple[tuple[str, str], ...], least: int = 4) -> list[str | None] | None:
    """The band of each column, or None where it has none; None altogether if fewer than ``least`` are named.

    Bands and columns keep their order. Columns without a name of their own between two
    neighbouring ones take the bands between those, if there are just as many.
    """
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    texts = headers([columns[k] for k in order], fragments) if columns else []
    if not texts:
        return None
    at = order_match([[1.0 if re.search(p, t) else 0.0 for t in texts] for _, p in bands])
    named = {k: b for b, k in enumerate(at) if k is not None}
    if len(named) < least:
        return None
    places = sorted(named)
    for a, b in zip(places[:-1], places[1:], strict=True):
        if b - a > 1 and named[b] - named[a] == b - a:
            named.update({a + i: named[a] + i for i in range(1, b - a)})
    out: list[str | None] = [None] * len(columns)
    for k, b in named.items():
        out[order[k]] = bands[b][0]
    return out


def banded(columns: str, fragments: str, bands: tuple[tuple[str, str], ...], least: int = 4) -> Column:
    """``column_model`` for arrays of column places and of ``x, y, text``; null where there is no model.

    Headers repeat, so a worker works each out once and knows it again by its bytes.
    """

    @arrow_udf(T.ArrayType(T.StringType()))
    def run(places: pa.Array, parts: pa.Array) -> pa.Array:
        return _models(places, parts, bands, least)

    return run(columns, fragments)


#: Headers, and texts of fragments, that a worker remembers.
REMEMBERED = 1 << 17


@functools.cache
def _headers_met(bands: tuple[tuple[str, str], ...], least: int) -> tuple[dict[str, int], dict[bytes, list[str | None] | None]]:
    return {}, {}


def _models(places: pa.ListArray, parts: pa.ListArray, bands: tuple[tuple[str, str], ...], least: int) -> pa.Array:
    codes, known = _headers_met(bands, least)
    keys = _header_keys(places, parts, codes)
    fresh = {k: i for i, k in enumerate(keys) if k not in known}
    rows, own = pa.array(fresh.values(), pa.int64()), {}
    for key, c, f in zip(fresh, places.take(rows).to_pylist(), parts.take(rows).to_pylist(), strict=True):
        own[key] = column_model(c or [], [(p["x"], p["y"], p["text"]) for p in f or []], bands, least)
        if isinstance(key, bytes) and len(known) < REMEMBERED:
            known[key] = own[key]
    return pa.array([own[k] if k in own else known[k] for k in keys], pa.list_(pa.string()))


def _header_keys(places: pa.ListArray, parts: pa.ListArray, codes: dict[str, int]) -> list[bytes] | list[int]:
    """The places and fragments of each header as bytes; numbers of the rows where one lacks something, for these aren't remembered."""
    spots, flat = places.values, parts.values
    x, y, text = (flat.field(n) for n in ("x", "y", "text"))
    if len(codes) > REMEMBERED or any(a.null_count for a in (places, parts, spots, flat, x, y, text)):
        return list(range(len(places)))
    names = text.dictionary_encode()
    code = np.array([codes.setdefault(t, len(codes)) for t in names.dictionary.to_pylist()], np.float64)
    rows = np.empty((len(flat), 3))
    rows[:, 0], rows[:, 1], rows[:, 2] = x.to_numpy(), y.to_numpy(), code[names.indices.to_numpy()]
    a, b = spots.to_numpy().astype(np.float64).tobytes(), rows.tobytes()
    at, to = places.offsets.to_numpy().tolist(), parts.offsets.to_numpy().tolist()
    size = np.diff(at).astype("<i4").tobytes()
    return [size[4 * i : 4 * i + 4] + a[8 * at[i] : 8 * at[i + 1]] + b[24 * to[i] : 24 * to[i + 1]] for i in range(len(places))]
