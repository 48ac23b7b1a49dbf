"""Ranges of keys that follow from the rows alone, not from how they are partitioned.

Files that are written by range are the same on every run only if the ranges are. The
bounds are quantiles, by bytes, of a sample that a hash of the key chooses, and the
number of ranges follows from the sampled bytes.
"""

from __future__ import annotations

import bisect
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import tidy


def place(key: int | None, tie: int) -> tuple:
    """What keys are ordered by: null first, then the key, then the tie."""
    return key is not None, key or 0, tie


def bounds(rows: DataFrame, key: str, tie: str, size: str, part_bytes: int) -> list[tuple]:
    """Upper bounds of all ranges but the last, for ranges of about ``part_bytes``.

    The sample has about 8 times the square root of the number of rows, and a range
    16 sampled rows at least. Where the bytes ask for more ranges than that, a second
    sample has 4 rows for each.
    """
    count, least = rows.count(), 16
    every = max(1, math.isqrt(count) // 8)

    def sample():
        few = rows.where(F.pmod(F.xxhash64(key, tie), F.lit(every)) == 0).select(key, tie, size).collect()
        few = sorted((place(r[0], r[1]), r[2]) for r in few)
        total = sum(n for _, n in few)
        return few, total, -(-total * every // part_bytes)

    few, total, wanted = sample()
    if wanted * least > len(few) and every > 1:
        least, every = 4, max(1, min(every, count // (4 * wanted)))
        few, total, wanted = sample()
    parts = max(1, min(len(few) // least, wanted))
    out, seen = [], 0
    for at, n in few:
        if seen * parts >= total * (len(out) + 1) and (not out or at > out[-1]):
            out.append(at)
        seen += n
    return out


def in_ranges(rows: DataFrame, key: str, tie: str, at: list[tuple], part: str) -> DataFrame:
    """``rows`` with their range's number in ``part``, a partition for each range."""

    @arrow_udf(T.IntegerType())
    @tidy
    def number(keys: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(at, place(k, t)) for k, t in zip(keys.to_pylist(), ties.to_pylist(), strict=True)], pa.int32())

    return rows.withColumn(part, number(key, tie)).repartitionById(len(at) + 1, part)
