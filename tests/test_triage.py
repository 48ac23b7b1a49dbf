"""Each cause is told from its own evidence, and only from it."""

from pyspark.sql import functions as F

from marlstone.operators import triage as T


def test_causes(spark):
    page = [10.0, 20.0, 33.0, 20.0]
    rows = [
        ("clean", 63.0, [10.0, 20.0, 33.0], page), ("unit", 63000.0, [10.0, 20.0, 33.0], page), ("unit", 0.063, [10.0, 20.0, 33.0], page), ("sign", 103.0, [10.0, -20.0, 73.0], [73.0]),
        ("sign", -37.0, [20.0, 50.0, 33.0, -40.0, 50.0], []), ("double", 65.0, [12.0, 20.0, 33.0, 20.0], [12.0, 20.0, 33.0]), ("missing row", 63.0, [10.0, 20.0], [10.0, 20.0, 33.0]), ("source", 70.0, [10.0, 20.0], [10.0, 20.0, 33.0]),
        ("not captured", 63.0, [], page), ("not captured", 63.0, [None], page), ("total not read", None, [10.0, 20.0, 33.0], [10.0, 63.0]), ("source", None, [10.0, 20.0], page), ("source", 44.0, [10.0, 20.0, 33.0], page), ("source", 5.0, [0.0, 0.0], [0.0]),
    ]
    rows[4] = ("sign", 13.0, [20.0, 50.0, 33.0, -40.0, 50.0], [])  # 113 less twice the 50
    df = spark.createDataFrame(rows, "want string, told double, parts array<double>, page array<double>")
    got = df.select("want", T.cause(F.col("told"), F.col("parts"), F.col("page")).alias("cause")).collect()
    assert [r.cause for r in got] == [r.want for r in got]
