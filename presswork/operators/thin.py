"""Topics and regions of stories with little text: the feeds' categories, then the sources' usual topics, then keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.basics import dealt
from ..sources.feeds import category_region, category_topic
from . import coverage

CONFIDENCE, SAMPLE = 0.4, 10


#: what a vote is for; titles are no votes, but travel with them
TITLE, TOPIC, USUAL, REGION = range(4)


def _sure(priors: DataFrame, confidence: float, sample: int) -> DataFrame:
    return priors.where(F.col("topic").isNotNull() & (F.col("confidence") >= confidence) & (F.col("total") >= sample)).select("source_id", F.col("topic").alias("_usual"), F.col("confidence").alias("_sure"))


def by_priors(members: DataFrame, priors: DataFrame, key: str, confidence: float = CONFIDENCE, sample: int = SAMPLE) -> DataFrame:
    """(key, topic) of members (key, source_id): the topic with the largest sum of its sources' confidences; a tie gives null.

    Sources of a lower confidence, or with a smaller total, have no say.
    """
    voters = members.where(F.col(key).isNotNull()).select(key, "source_id").join(_sure(priors, confidence, sample), "source_id")
    votes = dealt(voters.select(key, "source_id", "_usual", "_sure"), key).distinct()
    votes = votes.groupBy(key, F.col("_usual").alias("topic")).agg(F.round(F.sum("_sure"), 9).alias("w"))
    return coverage.first_or_null(votes, key, "topic", "w").select(key, "topic")


def _vote(kind: int, value: Column, weight: Column, voter: str | None = None) -> Column:
    """A vote, and who has no more than one of them for a value."""
    voters = [(F.col(c) if c == voter else F.lit(None)).alias(c) for c in ("article", "source_id")]
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), *voters, weight.alias("w"))


def classified(articles: DataFrame, priors: DataFrame, key: str, confidence: float = CONFIDENCE, sample: int = SAMPLE) -> DataFrame:
    """(key, topic, region) of articles (key, article, source_id, title, categories).

    An article votes once for each value that its categories name, a source
    once for its usual topic; a shared first place gives none. Articles are
    dealt by their key once, and all votes of a key are counted where they are.
    """
    rows = articles.select(key, "article", "source_id", "title", "categories").join(_sure(priors, confidence, sample), "source_id", "left")
    rows = dealt(rows.select(key, "article", "source_id", "title", "categories", "_usual", "_sure"), key)
    rows = rows.select(key, "article", "source_id", "title", "_usual", "_sure", F.posexplode_outer("categories").alias("pos", "raw"))
    one, begins = F.lit(1.0), F.coalesce(F.col("pos") == 0, F.lit(True))
    votes = F.array(
        _vote(TITLE, F.when(begins, F.col("title")), one),
        _vote(USUAL, F.when(begins, F.col("_usual")), F.col("_sure"), "source_id"),
        _vote(TOPIC, category_topic(F.col("raw")), one, "article"),
        _vote(REGION, category_region(F.col("raw")), one, "article"),
    )
    # a key without any vote stays, a row without a key has no say but by its title
    stays = F.col("v.value").isNotNull() & F.col(key).isNotNull() | F.col("begins") & (F.col("v.kind") == TITLE)
    votes = rows.select(key, begins.alias("begins"), F.explode(votes).alias("v")).where(stays).select(key, "v.*")
    # a title weighs as often as it stands, a voter once
    votes = votes.groupBy(key, "kind", "value", "article", "source_id").agg(F.sum("w").alias("s"), F.max("w").alias("w"))
    votes = votes.groupBy(key, "kind", "value").agg(F.sum("s").alias("s"), F.round(F.sum("w"), 9).alias("w"))
    mine = lambda kind, *c: F.when(F.col("kind") == kind, F.struct(*c))
    first = [c for k in (TOPIC, USUAL, REGION) for c in (F.max(mine(k, "w", "value")).alias(f"hi{k}"), F.min(mine(k, (-F.col("w")).alias("w"), "value")).alias(f"lo{k}"))]
    titles = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), mine(TITLE, "value", F.col("s").cast("int").alias("n")))))
    out = votes.groupBy(key).agg(*first, titles.alias("titles"))
    # the last and the first value of the largest weight are the same one, or there are several
    named, usual, region = (F.when(F.col(f"hi{k}.value") == F.col(f"lo{k}.value"), F.col(f"hi{k}.value")) for k in (TOPIC, USUAL, REGION))
    text = F.array_join(F.flatten(F.transform("titles", lambda t: F.array_repeat(t["value"], t["n"]))), " ")
    return out.select(key, F.coalesce(named, usual, tx.topic_of(text)).alias("topic"), F.coalesce(region, tx.region_of(text)).alias("region"))
