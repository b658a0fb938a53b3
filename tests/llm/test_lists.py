"""List entries of any depth."""

from pyspark.sql import functions as F

from geoaudit.llm import url_filters


def test_entries_of_many_segments(spark):
    deep = "deep.example/" + "/".join(f"s{i}" for i in range(40))
    e = spark.createDataFrame([("l", "x.example/a/b/c/d", "add", "2024-01-01"), ("l", deep, "add", "2024-01-01"), ("l", None, "add", "2024-01-01")], "list_name string, pattern string, action string, day string").withColumn("at", F.to_timestamp("day"))
    urls = ["http://x.example/a/b/c/d", "http://x.example/A/b/c/d/e/f?q", "http://x.example/a/b/c/dd", "http://x.example/a/b/c", f"https://{deep}/more", f"https://{deep}more"]
    c = spark.createDataFrame(list(enumerate(urls)), "k long, url string").withColumn("fetched", F.to_timestamp(F.lit("2024-02-01")))
    got = {r.k: r.rule for r in url_filters.filter_urls(c, e, "k").collect()}
    assert got == {0: "x.example/a/b/c/d", 1: "x.example/a/b/c/d", 2: None, 3: None, 4: deep, 5: None}
    assert url_filters.filter_urls(c, e.where("pattern NOT LIKE '%/%'"), "k").where("allowed").count() == 6
