"""Why a total and its parts disagree, told from the figures themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = (1000.0, 1e6)


def near(a: Column, b: Column, least: float, rel: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(least), rel * F.greatest(F.abs(a), F.abs(b)))


def cause(told: Column, parts: Column, page: Column, least: float = 0.5, rel: float = 1e-9) -> Column:
    """``clean``, or the first cause that the evidence bears out.

    ``parts``: amounts as captured; ``page``: all amounts that stand on the pages around. Null amounts are none.
    ``not captured``: there are no parts. ``unit``: the total is the parts' in another unit. ``sign``: it is with one part's sign turned.
    ``double``: it is without one of two equal parts. ``missing row``: it is with one amount of the page that is no part.
    ``total not read``: no total, but the parts' sum stands on the page. ``source``: none of these, so it is filed so.
    """
    held = F.filter(parts, lambda p: p.isNotNull())
    total = F.aggregate(held, F.lit(0.0), lambda a, p: a + p)
    same = lambda a, b: near(a, b, least, rel)
    times = lambda p: F.size(F.filter(held, lambda q: same(p, q)))
    unit = F.lit(False)
    for u in UNITS:
        unit = unit | same(told, total * u) | same(told * u, total)
    other = F.filter(page, lambda v: v.isNotNull() & ~F.exists(held, lambda p: same(p, v)))
    return (
        F.when(F.size(held) == 0, "not captured")
        .when(told.isNull(), F.when(F.exists(page, lambda v: same(v, total)), "total not read").otherwise("source"))
        .when(same(told, total), "clean")
        .when(unit & (total != 0), "unit")
        .when(F.exists(held, lambda p: (p != 0) & same(told, total - 2 * p)), "sign")
        .when(F.exists(held, lambda p: (p != 0) & (times(p) > 1) & same(told, total - p)), "double")
        .when(F.exists(other, lambda v: (v != 0) & same(told, total + v)), "missing row")
        .otherwise("source")
    )
