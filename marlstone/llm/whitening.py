"""Whitening of embeddings by the covariance of their distinct vectors.

Entries become whole numbers, so equal vectors are equal exactly: they are grouped, and
each distinct vector is fitted and whitened once, with weight one or the number of its
rows. Vectors are centred on the whole numbers nearest to their mean before they are
multiplied; products of small whole numbers are exact in a float64 matrix product, their
sums are added up as whole numbers, and what is left of the mean is taken off in whole
numbers too. So the covariance is that of the fit list to the last bit, however rows are
dealt out. The whitened vectors are joined back to their rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, table, tidy
from .quality_rules import free_name

COMPONENTS = 4
#: What entries are multiplied by before they are floored.
SCALE = 256
#: Vectors that are multiplied at a time.
BLOCK_ROWS = 4096
#: An eigenvalue below this share of their sum counts as none.
NO_SPREAD = 1e-12
#: Float64 keeps whole numbers apart below this.
EXACT = 1 << 53
#: Partitions to which the tasks' sums are sent before they reach the driver.
SUM_PARTS = 32


def _vectors(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _sums(rows: DataFrame, make, width: int) -> np.ndarray:
    """The sum of ``make(batch)`` over all batches: a matrix of whole numbers of any size, with rows of ``width``.

    Tasks add up their own; their rows meet by number in ``SUM_PARTS`` partitions, so that
    the driver gets each row of the matrix as many times at most, not once a task. Numbers travel as text.
    """

    def put(total):
        for i, row in enumerate(total):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "row": pa.array([[str(v) for v in row]], pa.list_(pa.string()))})

    @tidy
    def own(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = make(b)
                total = part if total is None else total + part
        if total is not None:
            yield from put(total)

    @tidy
    def meet(batches):
        total: dict = {}
        for b in batches:
            for i, row in zip(b.column("i").to_pylist(), b.column("row").to_pylist(), strict=True):
                row = [int(v) for v in row]
                total[i] = [a + c for a, c in zip(total[i], row, strict=True)] if i in total else row
        for i, row in total.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "row": pa.array([[str(v) for v in row]], pa.list_(pa.string()))})

    schema = "i int, row array<string>"
    got = rows.mapInArrow(own, schema).repartition(SUM_PARTS, "i").mapInArrow(meet, schema).collect()
    out = np.zeros((1 + max((r["i"] for r in got), default=-1), width), object)
    for r in got:
        out[r["i"]] += np.array([int(v) for v in r["row"]], object)
    return out


def _product(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``y.T @ diag(w) @ y`` as exact whole numbers."""
    big = int(np.abs(y).max(initial=0))
    if big * big * max(1, int(w.sum())) < EXACT:
        return np.rint((y.T * w.astype(np.float64)) @ y.astype(np.float64)).astype(np.int64).astype(object)
    wide = y.astype(object)
    return (wide.T * w.astype(object)) @ wide


def whole_vectors(rows: DataFrame, vector_col: str = "embedding", out: str = "x", scale: int = SCALE) -> DataFrame:
    """Rows whose vector has entries, all finite, with each as ``floor(scale * entry)`` in ``out``.

    Rows are dropped if the vector is null or empty, or holds a null, a NaN, an infinity or
    an entry beyond what a long holds at this scale. Vectors of different lengths are an error in ``whiten``.
    """
    v = F.col(vector_col)
    big = float(1 << 62) / scale
    fit = F.forall(v, lambda c: c.isNotNull() & F.coalesce(F.abs(c.cast("double")) < big, F.lit(False)))
    kept = rows.where(v.isNotNull() & (F.size(v) > 0) & fit)
    return kept.withColumn(out, F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")))


class Fit:
    """Mean, components and eigenvalues of distinct vectors ``x`` with weights ``w``."""

    def __init__(self, distinct: DataFrame, weight: str):
        size = distinct.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
        if size[0] != size[1]:
            raise ValueError(f"vectors of {size[0]} to {size[1]} entries")
        d = self.dims = size[0]

        def totals(b):
            x, w = _vectors(b.column("x")), np.asarray(b.column(weight))
            return np.concatenate([[np.array([int(w.sum())] + [0] * (d - 1), object)], [(x.astype(object) * w.astype(object)[:, None]).sum(axis=0)]])

        got = _sums(distinct.select("x", weight), totals, d)
        self.n, self.sums = int(got[0][0]), [int(v) for v in got[1]]
        centre = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

        def products(b):
            x, w = _vectors(b.column("x")), np.asarray(b.column(weight))
            return sum(_product(x[k : k + BLOCK_ROWS] - centre, w[k : k + BLOCK_ROWS]) for k in range(0, len(x), BLOCK_ROWS))

        left = [s - self.n * int(c) for s, c in zip(self.sums, centre, strict=True)]
        raw = _sums(distinct.select("x", weight), products, d)
        square = self.n * self.n
        v = np.array([[float(Fraction(self.n * int(raw[i][j]) - left[i] * left[j], square)) for j in range(d)] for i in range(d)])
        values, axes = np.linalg.eigh((v + v.T) / 2)
        order = np.argsort(-values, kind="stable")
        self.trace = float(np.trace(v))
        self.values, self.axes = values[order], axes[:, order]

    def components(self, k: int) -> int:
        """How many of the first ``k`` components have any spread."""
        return int((self.values[:k] > NO_SPREAD * max(self.trace, 0.0)).sum()) if self.trace > 0 else 0


def _whitener(fit: Fit, k: int):
    n, sums, dims = fit.n, fit.sums, fit.dims
    axes = fit.axes[:, :k] / np.sqrt(fit.values[:k])
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([float(Fraction(s - n * int(c), n)) for s, c in zip(sums, centre, strict=True)])

    @tidy
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column("x"))
            z = ((x - centre).astype(np.float64) - rest) @ axes
            big = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
            if big * big * dims < 1 << 62:
                far = ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                far = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * k, pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("n_rows"), pa.array([str(f) for f in far]), lists], names=["x", "n_rows", "far", "white"])

    return run


def identity_error(white: DataFrame, k: int, weight: str) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity.

    Means first, then products of centred values; both are sums over tasks.
    """
    w = F.col(weight).cast("double")
    total, *sums = white.agg(F.sum(w), *(F.sum(w * F.col("white")[i]) for i in range(k))).first()
    mean = [s / total for s in sums]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = white.agg(*(F.sum(w * (F.col("white")[i] - mean[i]) * (F.col("white")[j] - mean[j])) for i, j in pairs)).first()
    return max(abs(v / total - (i == j)) for (i, j), v in zip(pairs, got, strict=True))


def _join_back(rows: DataFrame, white: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of the distinct vector they hold.

    A vector that a thousandth of all rows hold is one of 1000 at most: those are
    broadcast, so that no task gets all rows of a vector. The others meet in a shuffle.
    """
    total = white.agg(F.sum("n_rows")).first()[0] or 0
    heavy = F.col("n_rows") * 1000 > total
    flag = free_name(rows, "whitening_x")
    fields = [F.col("hot.x").isNotNull().alias(flag), *(F.col(f"hot.{c}").alias(c) for c in columns)]
    hot = white.where(heavy & (F.col("n_rows") > 1)).select("x", *columns).alias("hot")
    cold = white.where(~(heavy & (F.col("n_rows") > 1))).select("x", *columns)
    mixed = rows.alias("own").join(F.broadcast(hot), F.col("own.x") == F.col("hot.x"), "left").select(*(F.col(f"own.{c}") for c in rows.columns), *fields)
    met = mixed.where(flag).select(*rows.columns, *columns)
    return met.union(mixed.where(~F.col(flag)).select(*rows.columns).join(cold, "x").select(*rows.columns, *columns))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weights: str = "one", scale: int = SCALE) -> DataFrame:
    """For each row that keeps its vector and each of the first components: the whitened coordinate.

    Columns: id, component (from 1, by falling eigenvalue), n (sum of the weights), deviation
    (exact, a decimal), whitened, explained, identity_error. ``weights``: ``one`` fits each distinct vector
    once, ``count`` as often as rows hold it. Components without spread are left out,
    so a single distinct vector gives no rows; nor does an empty table. Repeated
    ids and rows keep a row each; a null id stays null; other columns are ignored.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights {weights}")
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    spark, held = rows.sparkSession, free_name(rows, "whitening_id")
    own = whole_vectors(rows.select(F.col(id_col).alias(held), F.col(vector_col).alias("v")), "v", "x", scale).select(held, "x")
    distinct = cut(own.groupBy("x").agg(F.count("*").alias("n_rows")).withColumn("one", F.lit(1).cast("long")), "vectors")
    if distinct.isEmpty():
        return spark.createDataFrame([], schema)
    weight = "one" if weights == "one" else "n_rows"
    fit = Fit(distinct, weight)
    k = fit.components(min(components, fit.dims))
    if not k:
        return spark.createDataFrame([], schema)
    white = cut(distinct.select("x", "n_rows").mapInArrow(_whitener(fit, k), "x array<long>, n_rows long, far string, white array<double>").withColumn("one", F.lit(1).cast("long")), "whitened")
    discard(distinct)
    error = identity_error(white, k, weight)
    shares = F.array(*(F.lit(float(v / fit.trace)) for v in fit.values[:k]))
    got = _join_back(own, white, ["far", "white"]).select(held, "far", F.posexplode("white").alias("at", "whitened"))
    return got.select(
        F.col(held).alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), F.col("far").cast("decimal(38,0)").alias("deviation"),
        "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened coordinates of every embedding whose entries are all finite.

    Null, empty and non-finite vectors are dropped. Repeated vectors are fitted once and
    keep a row each, as do repeated and null ids. An empty table, or one distinct vector,
    gives no rows. A deviation beyond a long (from some millions of distinct vectors) is null; ``whiten`` has it whole.
    """
    got = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return got.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
