"""Connectors: API shapes, CSV lists, crawl runs, statements of several properties, vectors as text, repaired stories."""

import pytest
from pyspark.sql import functions as F

from presswork.functions import vectors
from presswork.functions.basics import instant
from presswork.operators import cluster
from presswork.sources import feeds


def test_headline_api_and_news_index(spark):
    rows = [(" A title ", "https://a.example/1 ", " text ", "https://a.example/i.png", "2024-01-02T03:04:05Z"), ("[Removed]", "https://a.example/2", "x", None, None), ("B", "https://a.example/3", "[Removed]", None, None), ("C", " ", None, None, None), (None, "https://a.example/4", None, None, None), ("D", "https://a.example/5", None, None, "never")]
    got = feeds.news_api(spark.createDataFrame(rows, "title string, url string, description string, urlToImage string, publishedAt string")).withColumn("at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).collect()
    assert [(r.title, r.url, r.description, r.image, r.at) for r in got] == [("A title", "https://a.example/1", "text", "https://a.example/i.png", "2024-01-02 03:04:05"), ("D", "https://a.example/5", None, None, None)]
    index = spark.createDataFrame([("T", "https://b.example", "20240102T030405Z", None), ("", "https://b.example/2", "20240102T030405Z", None), ("U", "https://b.example/3", "2024", "i")], "title string, url string, seendate string, socialimage string")
    got = feeds.news_index(index).withColumn("at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).collect()
    assert [(r.title, r.at, r.image) for r in got] == [("T", "2024-01-02 03:04:05", None), ("U", None, "i")]


def test_csv_round_trip(spark, tmp_path):
    rows = [('He said "no", twice', "https://a.example", "left"), ("line\nbreak, comma", "https://b.example", None), ("Third", "ftp://c", "up"), (None, "https://d.example", None)]
    df = spark.createDataFrame(rows, "name string, url string, bias string")
    feeds.write_csv(df.coalesce(1), str(tmp_path / "list"))
    good, bad = feeds.read_sources_csv(spark, str(tmp_path / "list"))
    assert sorted((r.name, r.url, r.bias) for r in good.collect()) == sorted(rows[:2])
    assert {r.name: r.errors for r in bad.collect()} == {"Third": ["url is not http", "unknown bias"], None: ["name is required"]}
    feeds.write_csv(df.drop("url").coalesce(1), str(tmp_path / "short"))
    with pytest.raises(ValueError):
        feeds.read_sources_csv(spark, str(tmp_path / "short"))


def test_a_source_fails_if_all_its_pages_do(spark):
    rows = [(1, "a", None), (1, "b", "HTTP 500"), (2, "c", "x"), (2, "d", "y"), (3, "e", None)]
    got = {r.source_id: (r.n, r.failed, r.source_failed) for r in feeds.crawl_outcome(spark.createDataFrame(rows, "source_id long, url string, error string")).collect()}
    assert got == {1: (2, 1, False), 2: (2, 2, True), 3: (1, 0, False)}


def test_statements_of_several_properties(spark):
    part = lambda rows: spark.createDataFrame(rows, "subject string, owner string, label string, kind string")
    got = {r.subject: (r.owners, r.labels, r.kind) for r in feeds.statements_by_owner({"P127": part([("s", "o2", "Two", "k"), ("s", "o1", "One", "j")]), "P749": part([("s", "o1", "One", "k"), ("t", None, None, None)])}).collect()}
    assert got == {"s": ("o1|o2", "One|Two", "j"), "t": ("", "", None)}


def test_vectors_as_text(spark):
    df = spark.createDataFrame([("[1, -2.5,3e-1]",), ("[]",), ("none",), (None,)], "t string")
    assert [r.v for r in df.select(vectors.parsed(F.col("t")).alias("v")).collect()] == [[1.0, -2.5, 0.3], [], None, None]


def test_drifted_articles_leave_and_centroids_follow(spark):
    now = "2024-01-31 00:00:00"
    stories = spark.createDataFrame([(1, [1.0, 0.0])], "story_id long, centroid array<double>").withColumn("last_published", instant(now))
    members = spark.createDataFrame([(1, 1, [1.0, 0.1]), (2, 1, [1.0, -0.3]), (3, 1, [-1.0, 1.0])], "id long, story_id long, embedding array<double>").withColumns({"weight": F.lit(1.0), "published_at": instant(now)})
    kept, fixed = cluster.repaired(members, stories)
    assert {r.id for r in kept.collect()} == {1, 2}
    assert [round(x, 9) for x in fixed.first().centroid] == [1.0, -0.1]
