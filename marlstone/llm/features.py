"""Hashed byte n-gram counts of whole texts, and bounded training samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, text_view

STEP_BYTES = 1 << 20
STEP_ROWS = 256
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def ngram_counts(data: np.ndarray, docs: np.ndarray, width: int, orders=(1, 2, 3), fold: bool = False) -> np.ndarray:
    """A row of ``width`` counts for each text: its byte n-grams by hash. ``width``: a power of 2."""
    n, rows = len(data), len(docs) - 1
    total = np.zeros(rows * width, np.int64)
    b = (_FOLD[data] if fold else data).astype(np.uint32)
    of = np.repeat(np.arange(rows, dtype=np.int64) * width, np.diff(docs))
    shift = np.uint32(32 - (width.bit_length() - 1))
    code = np.zeros(n, np.uint32)
    for k in range(1, max(orders) + 1):
        code = (code[: n - k + 1] * np.uint32(257) + b[k - 1 :]) if n >= k else code[:0]
        if k in orders and n >= k:
            inside = of[: n - k + 1] == of[k - 1 :]
            h = ((code + np.uint32(k)) * np.uint32(2654435761)) >> shift
            total += np.bincount((of[: n - k + 1] + h)[inside], minlength=rows * width)
    return total.reshape(rows, width)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def by_steps(texts: pa.Array, run):
    """``run(data, offsets, texts)`` over pieces of bounded size; its rows one after another."""
    for block in text_blocks([pa.RecordBatch.from_arrays([texts], names=["t"])], "t", STEP_BYTES):
        col = block.column("t").combine_chunks()
        for a in range(0, len(col), STEP_ROWS):
            part = col.slice(a, STEP_ROWS)
            yield run(*text_view(part), part)


def bounded_sample(rows: DataFrame, wanted: dict, key: str, salt: int, by: list[str]) -> DataFrame:
    """Rows of each ``key`` with the share wanted of it, chosen by a hash of the columns ``by``.

    ``wanted``: key -> (rows there, rows wanted). The choice doesn't depend on how
    rows are dealt out, and no key is gathered in one task.
    """
    share = F.create_map(*(F.lit(x) for k, (n, m) in wanted.items() for x in (k, min(1.0, m / max(1, n)))))
    spin = F.pmod(F.xxhash64(F.lit(salt), *by), F.lit(1 << 20)) / float(1 << 20)
    return rows.where(spin < F.coalesce(share[F.col(key)], F.lit(0.0)))
