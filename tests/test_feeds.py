import pytest
from pyspark.sql import functions as F

from marlstone.sources import feeds


def test_rss_items(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><guid>1</guid><link>http://www.a.com/X/?u=1#t</link><title>bank rate</title><description>d</description></item><item><link>http://b.com/y</link><title>football bank</title></item></channel></rss>")
    got = feeds.news_items(spark, f"file://{tmp_path}/a.xml", "bank", "rate", "football").orderBy("link")
    assert [(r.external_id, r.link, r.relevant) for r in got.collect()] == [("http://b.com/y", "http://b.com/y", False), ("1", "http://www.a.com/x", True)]
    assert [r.link for r in feeds.without_followed_hosts(got, spark.createDataFrame([("a.com",)], "host string")).collect()] == ["http://b.com/y"]


def test_listing_and_cells(spark, tmp_path):
    (tmp_path / "e1" / "2020Q1").mkdir(parents=True)
    (tmp_path / "e1" / "2020Q1" / "full.pdf").write_bytes(b"abc")
    assert [tuple(r) for r in feeds.listing(spark, f"file://{tmp_path}").collect()] == [("e1", "2020Q1", "full", 3)]
    pages = spark.createDataFrame([(1, "<table><tr><th>a</th><td>b &amp; c</td></tr></table>"), (2, None)], "id int, html string")
    assert [tuple(r) for r in feeds.html_cells(pages, ["id"], "html").collect()] == [(1, 0, 0, 0, "a"), (1, 0, 0, 1, "b & c")]


def test_bound_scans(spark):
    spark.createDataFrame([(1, "x")], "k int, v string").createOrReplaceTempView("bound_t")
    assert feeds.scan(spark, "SELECT {c} AS c FROM bound_t WHERE v = :v", {"v": "x"}, {"c": "k"}, frozenset({"k"})).first().c == 1
    assert feeds.scan(spark, "SELECT k FROM bound_t WHERE v = :v", {"v": "x' OR 1=1"}).count() == 0
    with pytest.raises(ValueError):
        feeds.scan(spark, "SELECT {c} FROM bound_t", {}, {"c": "v"}, frozenset({"k"}))
    assert feeds.canonical(F.lit("x")) is not None
