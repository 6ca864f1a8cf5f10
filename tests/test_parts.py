"""What a task of the larger queries holds: rows of stories are dealt over all parts and no distinct count or wide distinct stands on them."""

import pytest
from pyspark.sql import functions as F

from presswork import plans, registry  # noqa: F401
from presswork.functions.basics import instant
from presswork.operators import coverage as cov
from presswork.operators import entities

from .conftest import SMALL


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_story_detail_groups_no_names(spark):
    plan = optimized(registry.QUERIES["story_detail"](spark, SMALL))
    assert "RepartitionByExpression [story_id" in plan and "Aggregate [story_id" not in plan


def test_related_tags_deals_stories_and_pairs(spark):
    plan = optimized(registry.QUERIES["related_tags"](spark, SMALL))
    assert "RepartitionByExpression [story_id" in plan and "RepartitionByExpression [tag_id" in plan and "Aggregate [story_id" not in plan


@pytest.mark.parametrize("name", ["perspective_feed", "story_intelligence", "blindspots"])
def test_metrics_hold_no_source_of_a_story(spark, name):
    plan = optimized(registry.QUERIES[name](spark, SMALL))
    assert "RepartitionByExpression [story_id" in plan and "distinct" not in plan and "collect_set" not in plan


def test_metrics_of_repeated_and_missing_values(spark):
    rows = [(1, 7, "left", "other"), (1, 7, "right", "other"), (1, None, None, None), (1, 8, "center", "telecom"), (None, 9, "left", "other"), (2, None, None, None)]
    a = spark.createDataFrame(rows, "story_id long, source_id long, bias string, ownership string").withColumn("published_at", instant("2024-06-15 00:00:00"))
    found = {r.story_id: (r.n_articles, r.n_sources, r.source_diversity, [(s.bias, s.n) for s in r.spectrum]) for r in cov.facts(a, instant("2024-06-15 12:00:00")).select("story_id", "n_articles", "n_sources", "source_diversity", F.col("spectrum")).collect()}
    assert found == {1: (4, 2, 2, [("left", 1), ("center", 1), ("right", 1)]), None: (1, 1, 1, [("left", 1)]), 2: (1, 0, 0, [])}


def test_journeys_join_each_table_once(spark):
    plan = optimized(registry.QUERIES["journeys"](spark, SMALL))
    assert plan.count("Join") <= 5


def test_words_without_a_type_are_left_early(spark):
    words = ["Thand", "Nor", "Europe", "Bank", "Summit", "UK", "NASA", "G20", "Bank of", "The"]
    x = spark.createDataFrame([(w,) for w in words], "w string")
    kind = entities.entity_type(entities.titled(entities.canonical(F.col("w"))))
    rows = x.select("w", entities.untyped(F.col("w")).alias("u"), kind.alias("t")).collect()
    assert [r.w for r in rows if r.u] == ["Thand", "Nor", "The"] and all(r.t is None for r in rows if r.u)


def test_topics_are_searched_in_texts_lowered_once(spark):
    plan = optimized(registry.QUERIES["entity_tags"](spark, SMALL)).lower()
    assert "contains(_low" in plan
