"""Whitening against numpy over the distinct vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import whitening


def brute(vectors, k, weights):
    x = np.floor(np.array(vectors, np.float64) * 256).astype(np.int64)
    fit, counts = np.unique(x, axis=0, return_counts=True)
    w = counts if weights == "count" else np.ones(len(fit), np.int64)
    n, s = int(w.sum()), (fit * w[:, None]).sum(axis=0)
    z = fit - s / n
    v = (z.T * w) @ z / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)
    e, u = e[order], u[:, order]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_against_numpy(spark, weights):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) * 0.3 + 5
    data = np.concatenate([data, np.repeat(data[:1], 300, axis=0), data[1:50]])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(data)], "vec_id long, embedding array<double>").repartition(7)
    got = whitening.whiten(rows, weights=weights).toPandas()
    n, far, white, share = brute(data, 4, weights)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(len(data))].to_numpy()
    sign = np.sign((table * white).sum(axis=0))
    assert len(got) == 4 * len(data) and np.abs(table * sign - white).max() < 1e-9
    assert got.groupby("vec_id").deviation.first().loc[range(len(data))].astype(int).tolist() == far.tolist()
    assert set(got.n) == {n} and got.identity_error.max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), share, rtol=1e-9)


def test_same_at_any_partitioning(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    a, b = (whitening.whiten(rows.repartition(k)).select("vec_id", "component", "whitened").toPandas().sort_values(["vec_id", "component"]) for k in (2, 9))
    assert (a.whitened.to_numpy() == b.whitened.to_numpy()).all()


def test_large_entries(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(60, 3)) * 1e9 + 1e12
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(data)], "vec_id long, embedding array<double>")
    got = whitening.whiten(rows).toPandas()
    x = np.floor(data * 256).astype(np.int64).astype(object)
    far = ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert got.groupby("vec_id").deviation.first().astype(str).tolist() == [str(v) for v in far]
    assert got.identity_error.max() < 1e-6


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, x int, hot int, component int"
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.1, 0.2], 1, 1, 1), (2, None, 1, 1, 1), (3, [0.1, None], 1, 1, 1), (4, [nan, 0.0], 1, 1, 1), (5, [inf, 0.0], 1, 1, 1), (6, [], 1, 1, 1)]
    odd = spark.createDataFrame(rows, schema)
    assert whitening.whiten(odd).count() == 0  # one distinct vector has no spread
    assert whitening.whiten(odd.limit(0)).count() == 0
    more = odd.union(spark.createDataFrame([(None, [0.5, 0.2], 1, 1, 1), (7, [0.5, 0.2], 1, 1, 1), (7, [0.5, 0.2], 1, 1, 1)], schema))
    got = whitening.whiten(more).collect()
    assert len(got) == 4 and {r["component"] for r in got} == {1} and {r["n"] for r in got} == {2}
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "7", "7", "None"]
    with pytest.raises(ValueError):
        whitening.whiten(more.union(spark.createDataFrame([(8, [0.5], 1, 1, 1)], schema)))


def test_query(spark, sf):
    got = whitening.op13_embedding_whitening(spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert got.count() == 4 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert got.agg(F.max("identity_error")).first()[0] < 1e-4
