"""Stories, sources, tags and owners as the nested documents an API returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..enums import BIASES
from ..functions.basics import hours_between, ordinal
from . import latest


def ordered(key: str, rows: DataFrame, name: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, name): the distinct rows of a key as an array of structs, by `order`. A document holds its lists whole."""
    item = F.struct(*order, *[f for f in fields if f not in order])
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("_l"))
    return lists.select(key, F.transform("_l", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def story_documents(stories: DataFrame, facts: DataFrame, articles: DataFrame, owners: DataFrame, tags: DataFrame, ties: list[str], key: str = "story_id") -> DataFrame:
    """One row a story: its columns and metrics, `sources` by bias and name with their owners and newest headline's time, `tags` by label.

    stories and facts (see coverage.facts) have the key; articles name source,
    bias, ownership, owner_id and tag_id; owners (owner_id, name); tags
    (tag_id, label, tag_type). A source whose owner is not known is flagged.
    """
    newest = latest.latest(articles, [key, "source_id"], ties)
    o = owners.select("owner_id", F.col("name").alias("owner"), F.lit(True).alias("_known"))
    s = newest.join(o, "owner_id", "left").select(key, "source_id", F.col("source").alias("name"), "bias", "ownership", "owner", (F.col("owner_id").isNotNull() & F.col("_known").isNull()).alias("owner_missing"), F.col("published_at").alias("newest"), ordinal(F.col("bias"), BIASES).alias("place"))
    of_sources = ordered(key, s, "sources", ["place", "name", "source_id"], ["source_id", "name", "bias", "ownership", "owner", "owner_missing", "newest"])
    t = articles.select(key, "tag_id").distinct().join(tags.select("tag_id", "label", "tag_type"), "tag_id")
    of_tags = ordered(key, t, "tags", ["label", "tag_id"], ["tag_id", "label", "tag_type"])
    return stories.join(facts, key).join(of_sources, key, "left").join(of_tags, key, "left")


def age_label(since: Column, until: Column) -> Column:
    """+5h or +3d: whole hours between under a day, else whole days; never below nothing."""
    hours = F.floor(F.greatest(hours_between(since, until), F.lit(0.0)))
    return F.when(hours < 24, F.concat(F.lit("+"), hours.cast("string"), F.lit("h"))).otherwise(F.concat(F.lit("+"), F.floor(hours / 24).cast("string"), F.lit("d")))
