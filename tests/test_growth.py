"""Ties that an order must settle, and steps whose cost or memory must not outgrow the input."""

import bisect
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone import plans
from marlstone.operators import alignment as L
from marlstone.operators import checks as C
from marlstone.operators import textindex as X

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"


def against_sql(spark, name, rows, schema, at):
    """Rows of a query and of its SQL on lines given by hand."""
    path = f"{at}/lineitem.parquet"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{path}")
    got = plans.QUERIES[name](spark, f"file://{at}")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{path}/*.parquet'")
    rel = con.sql(plans.ORACLES[name])
    want = rel.select(*(duckdb.ColumnExpression(c) for c in got.columns)).fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


def test_page_tables_settles_ties(spark, tmp_path):
    rng = random.Random(5)
    flag = lambda x: rng.choice(x)
    rows = [(rng.choice([*range(30), None]), 1, 1, rng.choice([1, 2, None]), rng.choice([1.0, None]), flag(["R", "A", "N", None]), flag(["F", "O", None])) for _ in range(600)]
    got, want = against_sql(spark, "page_tables", rows, LINES, tmp_path)
    assert len(got) == 600 and got == want


def spine_of(rows):
    """Rows (order, value) of one group on its run, found row by row."""
    rows = sorted(rows)
    tails, ends, back = [], [], {}
    for i, (_, v) in enumerate(rows):
        if v is not None:
            k = bisect.bisect_left(tails, v)
            tails[k : k + 1], ends[k : k + 1], back[i] = [v], [i], ends[k - 1] if k else None
    at, out = ends[-1] if ends else None, []
    while at is not None:
        out.append(rows[at])
        at = back[at]
    return out


@pytest.mark.parametrize("batch", [5, 10000])
def test_spines_of_many_groups_without_a_call_for_each(spark, batch):
    rng = random.Random(batch)
    rows = []
    for a in [*range(150), None]:
        for b in ("x", None):
            n = rng.choice([0, 1, 2, 3, 4, 5, 7, 8, 9, 17, 64, 65, 150])
            rows += [(a, b, o, rng.choice([None, *range(n)])) for o in rng.sample(range(1000), n)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = C.increasing_spine(spark.createDataFrame(rows, "a int, b string, o int, v int"), ["a", "b"], "o", "v")
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
        found = sorted(map(tuple, got.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    groups = {}
    for a, b, o, v in rows:
        groups.setdefault((a, b), []).append((o, v))
    assert found == sorted(((*k, *r) for k, g in groups.items() for r in spine_of([(o, v) for o, v in g])), key=str)


def test_a_spine_takes_one_row_of_a_place(spark):
    rows = [(1, 1, v) for v in range(20)] + [(1, 2, 5), (1, 3, 30)]
    for _ in range(3):
        random.Random(1).shuffle(rows)
        got = C.increasing_spine(spark.createDataFrame(rows, "g int, o int, v int"), ["g"], "o", "v").collect()
        assert [r.o for r in got] == [1, 2, 3] and got[0].v < 5


def test_a_header_is_read_once(monkeypatch):
    calls, whole = [], L.column_model
    monkeypatch.setattr(L, "column_model", lambda *a: calls.append(1) or whole(*a))
    bands = (("a", "^lo w$"), ("b", "^hi$"))
    low, high = [{"x": 1.0, "y": 1.0, "text": "w"}, {"x": 1.5, "y": 0.0, "text": "lo"}], [{"x": 8.0, "y": 0.0, "text": "hi"}]
    headers = [([0.0, 9.0], low + high), ([0.0, 9.0], high + low), ([0.0], low), ([0.0, 9.0], low), ([], []), ([9.0, 0.0], low + high)]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("text", pa.string())]))
    every = headers * 500
    places, parts = pa.array([h[0] for h in every], pa.list_(pa.float64())), pa.array([h[1] for h in every], kind)
    want = [whole(c, [(p["x"], p["y"], p["text"]) for p in f], bands, 1) for c, f in headers] * 500
    assert want[0] == ["a", "b"] and want[5] == ["b", "a"] and want[4] is None
    for a, b in ((places, parts), (places.slice(7, 900), parts.slice(7, 900))):
        assert L._models(a, b, bands, 1).to_pylist() == (want if len(a) == len(want) else want[7:907])
    assert len(calls) == len(headers)
    some = pa.array([*headers[0][:1], None], pa.list_(pa.float64())), pa.array([headers[0][1], None], kind)
    assert L._models(*some, bands, 1).to_pylist() == [["a", "b"], None]


def test_places_are_handed_on_in_small_batches():
    texts = ["ab, cd ab"] * 30_000 + [None, "", "12 x " * 200_000]
    got = list(X._places([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "t"])]))
    assert max(sum(map(len, b.column("places").to_pylist())) for b in got) <= 2 * X.HELD
    found = {}
    for r in (r for b in got for r in b.to_pylist()):
        found.setdefault((r["id"], r["word"]), []).extend(r["places"])
    assert len(found) == 2 * 30_000 + 2 and found[29_999, "ab"] == [1, 8] and found[0, "cd"] == [5]
    assert found[30_002, "12"] == [1 + 5 * k for k in range(200_000)] and found[30_002, "x"] == [4 + 5 * k for k in range(200_000)]


def test_tasks_of_duplicate_keys_grow_in_number_with_the_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice([*range(40), None]), rng.choice([1, 2]), rng.choice([1, 2, None]), rng.choice([0.0, 1.0, None])) for _ in range(400)] + [(99, 1, k, 1.0) for k in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, l int, v double")
    got = C.duplicate_keys(df, ["a", "b"], "l", "v", rows=50)
    want = df.groupBy("a", "b").agg(F.countDistinct("l").alias("labels"), F.count_if(F.col("v") != 0).alias("values")).where("labels > 1 and values >= 2")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.rdd.getNumPartitions() == 14


def test_statements_look_earlier_quarters_up_without_joins(spark, sf):
    plan = plans.QUERIES["statement_constraints"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan
