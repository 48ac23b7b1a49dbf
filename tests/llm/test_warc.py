import random

import duckdb
import pandas as pd

from marlstone.llm import warc
from marlstone.llm.common import new_path
from marlstone.llm.warc import file_system


def names(root):
    fs, at = file_system(root)
    from pyarrow.fs import FileSelector

    return {f.base_name: fs.open_input_stream(f.path, compression=None).read() for f in fs.get_file_info(FileSelector(at))}


def pages(spark):
    big = "é" * 600
    rows = [(1, "http://a/ b\n", "<p>"), (2, None, None), (3, "u", big), (4, "v", big), (None, "w", big), (5, "x", "<p>"), (6, "y", "z" * 200000), (7, "q", "\r\n\r\nWARC/1.1"), (3, "u", big)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)


def test_round_trip_revisits_and_same_bytes(spark):
    df, roots = pages(spark), []
    for _ in range(2):
        roots.append(new_path(spark, "warc-test"))
        warc.write_warc(df, roots[-1], roll=1)
    assert names(roots[0]) == names(roots[1]) and len(names(roots[0])) == 10
    got = warc.read_warc(spark, roots[0]).collect()
    want = {(r.page_id, (r.html or "").encode()) for r in df.collect()}
    assert {(r.page_id, bytes(r.payload)) for r in got if r.record_type == "response"} <= want
    assert sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got) == sorted(
        [("1", "response", None, 3), ("2", "response", None, 0), ("3", "revisit", 4, 1200), ("3", "revisit", 4, 1200), ("4", "response", None, 1200), ("None", "revisit", 4, 1200), ("5", "response", None, 3), ("6", "response", None, 200000), ("7", "response", None, 12)]
    )


def test_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    key = lambda r: str(r)
    assert sorted((tuple(r) for r in warc.op8_warc(spark, d).collect()), key=key) == sorted(con.sql(warc.SQL).fetchall(), key=key)


def test_leftovers_do_not_count_and_empty(spark):
    root = new_path(spark, "warc-test")
    warc.write_warc(pages(spark).limit(0), root)
    fs, at = file_system(root)
    with fs.open_output_stream(f"{at}/part-00009-00000.warc.gz") as f:
        f.write(b"left by a lost task")
    assert warc.read_warc(spark, root).count() == 0


def test_same_bytes_at_any_partitioning(spark):
    """Thousands of pages, so that bounds come from a sample; null ids, a third of all payloads equal, repeated rows."""
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.2 else rng.randint(0, 9000), f"http://h/{k % 50}", "hot " * 400 if rng.random() < 0.3 else "x" * rng.randint(0, 1500)) for k in range(4000)]
    rows += rows[:50]
    got = []
    for n in (2, 9):
        rng.shuffle(rows)
        got.append(new_path(spark, "warc-test"))
        warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n), got[-1], roll=20_000, part_bytes=200_000)
    assert names(got[0]) == names(got[1]) and len(names(got[0])) > 15
    con, pages = duckdb.connect(), pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    con.register("pages", pages)
    known = [r for r in warc.read_warc(spark, got[0]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect() if r.page_id is not None]
    want = con.sql(f"SELECT * FROM ({warc.SQL}) WHERE page_id IS NOT NULL").fetchall()
    assert sorted(map(str, (tuple(r) for r in known))) == sorted(map(str, want))
