"""Pages with totals, lists of ids, logs that take each row once, labels."""

import random

import pytest
from pyspark.sql import functions as F

from presswork.functions.basics import instant
from presswork.operators import documents, pages, runlog, state
from presswork.plans.feeds import FeedParams, feed, feed_rows

from .conftest import SMALL


@pytest.mark.parametrize("page,limit", [(1, 5), (3, 7), (4, 25), (99, 10)])
def test_pages_are_cut_from_the_order_with_the_number_of_all_rows(spark, page, limit):
    rnd = random.Random(page)
    rows = [(i, rnd.choice([None, 1, 2, 3]), rnd.choice([None, "a", "b"]), [i, None]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, n int, s string, more array<long>").repartition(7)
    got = [(r.id, r.n, r.s, r.more, r.total) for r in pages.paged(df, [("n", pages.DESC), ("s", pages.ASC), ("id", pages.ASC)], page, limit).collect()]
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or "", r[0]))
    assert got == [(*r, 90) for r in order[(page - 1) * limit : page * limit]]


def test_pages_of_nothing(spark):
    df = spark.createDataFrame([], "id long, n int")
    assert pages.paged(df, [("id", pages.ASC)], 1, 10).count() == 0


def test_lists_of_ids(spark):
    a, b = pages.id_list(spark, [5, 3, 9, 3, 7]), pages.id_list(spark, [7, 3, 8])
    ids = lambda d: [r.story_id for r in d.orderBy("position").collect()]
    assert ids(a) == [5, 3, 9, 7] and ids(pages.intersected(a, b)) == [3, 7] and ids(pages.excluded(a, b)) == [5, 9] and ids(pages.united(a, b)) == [5, 3, 9, 7, 8]
    assert pages.id_list(spark, []).count() == 0


def test_a_hundred_thousand_ids_in_a_feed(spark):
    ids = list(range(100_000, 0, -1))
    got = [r.story_id for r in feed(spark, SMALL, FeedParams(story_ids=ids, sort="list", limit=100)).collect()]
    every = sorted((r.story_id for r in feed_rows(spark, SMALL, FeedParams()).select("story_id").collect()), reverse=True)
    assert got == every[:100]
    plan = feed(spark, SMALL, FeedParams(story_ids=ids, sort="list"))._jdf.queryExecution().optimizedPlan().toString().replace("#", " ")
    assert "story_id IN (" not in plan and "99998" not in plan  # the list is no part of a condition


def test_perspectives_and_their_names():
    assert FeedParams(perspective="center").biases == ["center"] and len(FeedParams(perspective="all").biases) == 7
    with pytest.raises(ValueError):
        FeedParams(perspective="up")


def test_search_and_tag_of_a_feed(spark):
    one = feed_rows(spark, SMALL, FeedParams()).orderBy("story_id").first()
    found = feed_rows(spark, SMALL, FeedParams(search=f'"{one.headline}"', story_ids=[one.story_id])).collect()
    assert [r.story_id for r in found] == [one.story_id]
    from presswork import views

    tag = views.articles(spark, SMALL).where(F.col("story_id") == one.story_id).first().tag_id
    tagged = {r.story_id for r in feed_rows(spark, SMALL, FeedParams(tag_id=tag)).select("story_id").collect()}
    assert one.story_id in tagged and tagged < {r.story_id for r in feed_rows(spark, SMALL, FeedParams()).select("story_id").collect()}


STEPS = "run_id long, step string, stage string, level string, payload string"


def test_a_log_takes_a_step_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert runlog.logged(spark, folder) is None
    rows = [(1, "a", "embed", "info", '{"n": {"x": 1.5}}'), (1, "b", "embed", "warn", None), (1, "c", "cook", "info", "{}"), (1, "d", "ingest", "shout", "{}"), (1, "a", "embed", "info", '{"n": {"x": 1.5}}')]
    df = runlog.steps(spark.createDataFrame(rows, STEPS))
    runlog.append_new(df, folder, runlog.STEP_KEYS)
    runlog.append_new(df, folder, runlog.STEP_KEYS)  # a run that is repeated
    more = runlog.steps(spark.createDataFrame([(1, "b", "embed", "info", '{"late": 1}'), (2, "a", "cluster", "error", "no json")], STEPS))
    runlog.append_new(more, folder, runlog.STEP_KEYS)
    got = {(r.run_id, r.step): (r.level, r.x) for r in runlog.logged(spark, folder).select("run_id", "step", "level", runlog.number_at(F.col("payload"), "$.n.x").alias("x")).collect()}
    assert got == {(1, "a"): ("info", 1.5), (1, "b"): ("warn", None), (2, "a"): ("error", None)}


def test_rates_are_numbers(spark):
    rows = ['{"ingest": {"ingestedPerMinute": 3}}', '{"ingest": {"ingestedPerMinute": "3"}, "ingestedPerMinute": 2.5}', '{"ingest": 7, "ingestedPerMinute": 4}', '{"ingest": null}', "[]", "5", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").select("i", F.try_parse_json("s").alias("v"))
    assert [r.x for r in df.select("i", runlog.ingest_rate(F.col("v")).alias("x")).orderBy("i").collect()] == [3.0, 2.5, 4.0, None, None, None, None]
    runs = spark.createDataFrame([(1, i, i, s) for i, s in enumerate(['{"embed": {"processedPerMinute": 9}}', '{"embed": {"processedPerMinute": 8}}', '{"embed": {}}'])], "k int, started_at int, run_id int, s string").withColumn("summary", F.try_parse_json("s"))
    r = runlog.latest_rates(runs, "k").first()
    assert (r.ingest, r.embed) == (None, 8.0)


def test_snapshots_of_the_backlog(spark, tmp_path):
    folder = str(tmp_path / "snapshots")
    rows = spark.createDataFrame([(True, False, False, False, "2024-01-30 23:00:00")], "embedded boolean, clustered boolean, assembled boolean, reviewed boolean, t string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    for at in ("2024-01-31 00:00:00", "2024-01-31 00:00:00", "2024-01-31 00:15:00"):
        runlog.snapshot(state.backlog(rows, instant(at)), instant(at), folder)
    got = [(str(r.captured_at), r.unclustered, r.oldest_minutes) for r in runlog.logged(spark, folder).orderBy("captured_at").collect()]
    assert got == [("2024-01-31 00:00:00", 1, 60.0), ("2024-01-31 00:15:00", 1, 75.0)]


def test_widths_and_labels(spark):
    rows = spark.createDataFrame([(1, 50), (1, 200), (1, 1), (2, 0), (2, None)], "run int, ms int")
    assert sorted((r.run, r.ms or 0, r.width) for r in runlog.step_widths(rows, "run", "ms").collect()) == [(1, 1, 2.0), (1, 50, 25.0), (1, 200, 100.0), (2, 0, 2.0), (2, 0, 2.0)]
    label = lambda a, b: spark.range(1).select(documents.age_label(instant(a), instant(b)).alias("x")).first().x
    assert [label("2024-01-01 00:00:00", b) for b in ("2024-01-01 00:59:59", "2024-01-01 23:59:59", "2024-01-02 00:00:00", "2024-01-03 23:00:00", "2023-12-31 00:00:00")] == ["+0h", "+23h", "+1d", "+2d", "+0h"]
