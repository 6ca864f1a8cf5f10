"""Rows by a key that may be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..enums import BIASES, FACTUALITY
from ..functions import text as tx
from ..functions.basics import ordinal


def sources_by_slug(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """(slug, source_id, exact) for wanted (slug): the source with the slug, or else the first active one whose slug, or name as one, reads so."""
    asked = wanted.select(F.col("slug").alias("_asked")).distinct()
    exact = asked.join(sources, F.col("slug") == F.col("_asked")).groupBy("_asked").agg(F.min("source_id").alias("source_id"))
    derived = sources.where("is_active").select("source_id", tx.source_slug(F.coalesce(F.when(F.trim("slug") != "", F.col("slug")), F.col("name"))).alias("_derived"))
    rest = asked.join(exact.select("_asked"), "_asked", "left_anti")
    other = rest.join(derived, F.col("_derived") == F.col("_asked")).groupBy("_asked").agg(F.min("source_id").alias("source_id"))
    both = exact.withColumn("exact", F.lit(True)).unionByName(other.withColumn("exact", F.lit(False)))
    return both.select(F.col("_asked").alias("slug"), "source_id", "exact")


def matching(rows: DataFrame, search: str | None, *columns: str) -> DataFrame:
    """Rows in one of whose columns the text occurs as it is, in either case; all rows without a text."""
    if not search:
        return rows
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{tx.like_escaped(search)}%"), F.lit(False))
    return rows.where(found)


def faceted(sources: DataFrame, chosen: dict[str, list[str]], sort: str = "name") -> DataFrame:
    """Sources whose columns hold one of the chosen values each (an empty choice takes all), by name, or by the order of bias or factuality."""
    for column, values in chosen.items():
        if values:
            sources = sources.where(F.col(column).isin(values))
    scale = {"bias": BIASES, "factuality": FACTUALITY}.get(sort)
    return sources.orderBy(*([ordinal(F.col(sort), scale)] if scale else []), "name", "source_id")


def journeys(wanted: DataFrame, articles: DataFrame, stories: DataFrame, events: DataFrame, dead_letters: DataFrame) -> DataFrame:
    """(query, resolved, story_id, n_articles, n_events, n_dead) of wanted (query): what an article's id or URL, or a story's id, leads to.

    An article leads to itself and its story, a story to all its articles;
    events and dead letters (item_id) are those of these items. Ids are
    strings; articles have (article_id, url, story_id), stories (story_id).
    An article comes before a story, an id before a URL, the smallest id first.
    """
    asked = wanted.where("query is not null").select(F.trim("query").alias("query")).distinct()
    text = F.lit(None).cast("string")
    keys = articles.select(F.col("article_id").alias("query"), F.lit(0).alias("way"), "article_id", "story_id")
    keys = keys.unionByName(articles.select(F.col("url").alias("query"), F.lit(1).alias("way"), "article_id", "story_id"))
    keys = keys.unionByName(stories.select(F.col("story_id").alias("query"), F.lit(2).alias("way"), text.alias("article_id"), "story_id"))
    hit = asked.join(keys, "query", "left").groupBy("query").agg(F.min(F.struct("way", "article_id", "story_id")).alias("a")).select("query", "a.*")
    resolved = F.when(F.col("way") < 2, "article").when(F.col("way") == 2, "story").otherwise("none").alias("resolved")
    own = F.array(F.struct(F.col("story_id").alias("item_id"), F.lit(False).alias("is_article")), F.struct(F.col("article_id").alias("item_id"), F.lit(True).alias("is_article")))
    items = hit.select("query", resolved, "story_id", F.explode(own).alias("x")).select("query", "resolved", "story_id", "x.*").where(F.col("item_id").isNotNull() | ~F.col("is_article"))
    of_story = hit.where("way = 2").select("query", "story_id").join(articles.where("article_id is not null").select("story_id", F.col("article_id").alias("item_id")), "story_id")
    items = items.unionByName(of_story.select("query", F.lit("story").alias("resolved"), "story_id", "item_id", F.lit(True).alias("is_article")))
    items = items.groupBy("query", "item_id").agg(F.min("resolved").alias("resolved"), F.min("story_id").alias("story_id"), F.max("is_article").alias("is_article"))
    log = events.select("item_id", F.lit(1).alias("e"), F.lit(0).alias("d")).unionByName(dead_letters.select("item_id", F.lit(0).alias("e"), F.lit(1).alias("d")))
    log = log.where("item_id is not null").groupBy("item_id").agg(F.sum("e").alias("e"), F.sum("d").alias("d"))
    found = items.join(log, "item_id", "left").groupBy("query").agg(F.min("resolved").alias("resolved"), F.min("story_id").alias("story_id"), F.count_if("is_article").alias("n_articles"), F.sum("e").alias("e"), F.sum("d").alias("d"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return found.select("query", "resolved", "story_id", F.col("n_articles").cast("long").alias("n_articles"), zero(F.col("e")).alias("n_events"), zero(F.col("d")).alias("n_dead"))
