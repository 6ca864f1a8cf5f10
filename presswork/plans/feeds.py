"""Feeds of stories and tags with their filters, orders and pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..enums import BIASES, FACTUALITY, PERSPECTIVES, REGIONS, TOPICS
from ..functions.basics import dealt, hours_between, instant, ordinal, stamp
from ..operators import coverage as cov
from ..operators import pages
from ..registry import query
from ..views import BIAS_SQL, FACT_SQL, SQL
from ._sql import METRICS, age
from .stories import now, story_metrics, trending_stories


def at_least(column: Column, level: str) -> Column:
    """Factuality of a level or above."""
    return column.isin(FACTUALITY[FACTUALITY.index(level) :])


def since(column: Column, as_of: Column, preset: str) -> Column:
    """24h, 7d, 30d or all, from an explicit time."""
    hours = {"24h": 24, "7d": 168, "30d": 720}.get(preset)
    return F.lit(True) if hours is None else hours_between(column, as_of) <= hours


def in_bias_range(spectrum: Column, biases: list[str]) -> Column:
    """Any of the biases in the spectrum; none or all of them is no filter, and a missing spectrum passes."""
    if len(biases) in (0, len(BIASES)):
        return F.lit(True)
    return spectrum.isNull() | F.exists(spectrum, lambda s: s["bias"].isin(biases))


@dataclass
class FeedParams:
    """What a feed asks for, validated before any plan is built."""

    topic: str | None = None
    region: str | None = None
    min_factuality: str | None = None
    date_preset: str = "all"
    biases: list[str] = field(default_factory=list)
    owner_id: int | None = None
    tag_id: int | None = None
    search: str | None = None
    story_ids: list[int] | DataFrame | None = None
    perspective: str | None = None
    owner_days: int = 180
    sort: str = "newest"
    page: int = 1
    limit: int = 20

    def __post_init__(self):
        for value, allowed in ((self.topic, TOPICS), (self.region, REGIONS), (self.min_factuality, FACTUALITY)):
            if value is not None and value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")
        if self.perspective is not None:
            if self.perspective not in PERSPECTIVES:
                raise ValueError(f"{self.perspective!r} is none of {list(PERSPECTIVES)}")
            self.biases = PERSPECTIVES[self.perspective]
        if not set(self.biases) <= set(BIASES):
            raise ValueError("unknown bias")
        if self.sort not in ("newest", "most_sources", "trending", "list") or self.date_preset not in ("24h", "7d", "30d", "all"):
            raise ValueError("unknown sort or date preset")
        if self.page < 1 or not 1 <= self.limit <= 100:
            raise ValueError("page from 1, limit from 1 to 100")


def feed_rows(spark: SparkSession, sf: str, params: FeedParams) -> DataFrame:
    """The published stories that a feed has, with their metrics, in no order: filters come ahead of what is grouped. A list of ids gives `position`, an owner `_seen`, the time of its latest article."""
    s = views.stories(spark, sf).where("status = 'published'")
    for column in ("topic", "region"):
        if getattr(params, column):
            s = s.where(F.col(column) == getattr(params, column))
    if params.min_factuality:
        s = s.where(at_least(F.col("factuality"), params.min_factuality))
    if params.story_ids is not None:
        s = pages.among(s, pages.id_list(spark, params.story_ids))
    s = s.where(since(F.col("first_published"), now(), params.date_preset))
    arts = views.articles(spark, sf)
    if params.tag_id is not None:
        s = s.join(arts.where(F.col("tag_id") == params.tag_id).select("story_id"), "story_id", "left_semi")
    if params.search:
        from ..functions.text import matches

        s = s.where(matches(F.col("headline"), params.search))
    if params.owner_id is not None:
        recent = arts.where((F.col("owner_id") == params.owner_id) & (hours_between(F.col("published_at"), now()) <= 24 * params.owner_days))
        seen = recent.groupBy("story_id").agg(F.max("published_at").alias("_seen"))
        s = s.join(seen.orderBy(F.desc("_seen"), F.desc("story_id")).limit(1000), "story_id")
    scored = params.sort == "trending" and params.owner_id is None
    s = trending_stories(spark, sf, wanted=s) if scored else s.join(story_metrics(spark, sf, s), "story_id")
    return s.where(in_bias_range(F.col("spectrum"), params.biases))


def feed(spark: SparkSession, sf: str, params: FeedParams) -> DataFrame:
    """A page of a feed as one lazy plan, ties by id. An owner's order is by its latest article and overrides the sort."""
    s = feed_rows(spark, sf, params)
    order = {"newest": [F.desc_nulls_last("first_published")], "most_sources": [F.desc("n_sources"), F.desc_nulls_last("first_published")], "trending": [F.desc_nulls_last("score"), F.desc_nulls_last("first_published")], "list": [F.asc("position")]}[params.sort]
    if params.owner_id is not None:
        order = [F.desc("_seen")]
    return s.orderBy(*order, F.desc("story_id")).offset((params.page - 1) * params.limit).limit(params.limit)


@query(
    f"""{METRICS} SELECT s.story_id, headline, topic, s.factuality, n_sources, strftime(first_published, '%Y-%m-%d %H:%M:%S') AS first_published FROM sto s JOIN met USING (story_id)
WHERE status = 'published' AND topic = 'science' AND s.factuality IN ('mixed', 'high', 'very-high') AND {age('first_published')} <= 720 AND EXISTS (SELECT 1 FROM spec p WHERE p.story_id = s.story_id AND p.bias IN ('left', 'right'))
ORDER BY s.first_published DESC, s.story_id DESC LIMIT 20 OFFSET 20"""
)
def story_feed(spark: SparkSession, sf: str) -> DataFrame:
    f = feed(spark, sf, FeedParams(topic="science", min_factuality="mixed", date_preset="30d", biases=["left", "right"], page=2))
    return f.select("story_id", "headline", "topic", "factuality", "n_sources", stamp(F.col("first_published")).alias("first_published"))


@query(f"{METRICS} SELECT s.story_id, n_sources, impact_score FROM sto s JOIN met USING (story_id) WHERE status = 'published' AND region = 'uk' ORDER BY n_sources DESC, first_published DESC, s.story_id DESC LIMIT 50")
def feed_by_sources(spark: SparkSession, sf: str) -> DataFrame:
    return feed(spark, sf, FeedParams(region="uk", sort="most_sources", limit=50)).select("story_id", "n_sources", "impact_score")


@query(
    f"""{SQL}, x AS (SELECT story_id, max(published_at) AS seen FROM art WHERE owner_id = 3 AND {age('published_at')} <= 4320 GROUP BY story_id ORDER BY seen DESC, story_id DESC LIMIT 1000)
SELECT story_id, strftime(seen, '%Y-%m-%d %H:%M:%S') AS seen FROM (SELECT story_id, seen FROM x JOIN sto USING (story_id) WHERE status = 'published' ORDER BY seen DESC, story_id DESC LIMIT 20)"""
)
def owner_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feed(spark, sf, FeedParams(owner_id=3)).select("story_id", stamp(F.col("_seen")).alias("seen"))


@query(f"{METRICS} SELECT story_id, round(score, 6) AS score FROM tre WHERE topic = 'world' AND EXISTS (SELECT 1 FROM spec p WHERE p.story_id = tre.story_id AND p.bias = 'center') ORDER BY tre.score DESC, first_published DESC, story_id DESC LIMIT 20")
def trending_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    return feed(spark, sf, FeedParams(topic="world", biases=["center"], sort="trending")).select("story_id", F.round("score", 6).alias("score"))


@query(f"{SQL} SELECT topic, region, count(*) AS total FROM sto WHERE status = 'published' GROUP BY topic, region")
def feed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return views.stories(spark, sf).where("status = 'published'").groupBy("topic", "region").agg(F.count(F.lit(1)).alias("total"))


@query(
    f"""{METRICS}, d AS (SELECT DISTINCT story_id, source_id, source, bias, factuality, ownership, owner_id FROM art WHERE story_id IN (SELECT story_id FROM sto WHERE status = 'published'))
SELECT d.story_id, d.source_id, d.source, bias, o.name AS owner, d.owner_id IS NOT NULL AND o.owner_id IS NULL AS owner_missing, n_sources FROM d LEFT JOIN own o USING (owner_id) JOIN met USING (story_id)"""
)
def story_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Stories with their sources and owners; a source's owner that is not known is flagged."""
    ids = views.stories(spark, sf).where("status = 'published'").select("story_id")
    members = dealt(views.articles(spark, sf).select("story_id", "source_id"), "story_id").join(dealt(ids, "story_id"), "story_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("story_id", "source_id").orderBy("source_id"))
    pairs = members.withColumn("_first", first).where("_first = 1").withColumn("n_sources", F.count(F.lit(1)).over(Window.partitionBy("story_id")))
    s = views.sources(spark, sf).select("source_id", F.col("name").alias("source"), "bias", "factuality", "ownership", "owner_id").distinct()
    o = views.owners(spark, sf).select("owner_id", F.col("name").alias("owner"), F.lit(True).alias("_known"))
    known = s.join(o, "owner_id", "left").select("source_id", "source", "bias", "owner", (F.col("owner_id").isNotNull() & F.col("_known").isNull()).alias("owner_missing"))
    return pairs.join(known, "source_id").select("story_id", "source_id", "source", "bias", "owner", "owner_missing", "n_sources")


_TAGS = f"{SQL}, st AS (SELECT DISTINCT story_id, tag_id FROM art), vis AS (SELECT tag_id, count(*) AS n FROM st JOIN sto USING (story_id) WHERE status = 'published' GROUP BY tag_id)"


def story_tags(spark: SparkSession, sf: str) -> DataFrame:
    return views.articles(spark, sf).select("story_id", "tag_id").distinct()


def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tags with at least one published story, and how many."""
    s = views.stories(spark, sf).where("status = 'published'").select("story_id")
    return story_tags(spark, sf).join(s, "story_id", "left_semi").groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_TAGS} SELECT tag_id, label, tag_type, n AS story_count FROM vis JOIN tag USING (tag_id)")
def tag_list(spark: SparkSession, sf: str) -> DataFrame:
    return tag_counts(spark, sf).join(views.tags(spark, sf), "tag_id").select("tag_id", "label", "tag_type", F.col("n").alias("story_count"))


@query(f"{_TAGS} SELECT tag_id, n AS story_count FROM vis WHERE n >= 3 ORDER BY n DESC, tag_id LIMIT 15")
def promoted_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tag_counts(spark, sf).where("n >= 3").orderBy(F.desc("n"), "tag_id").limit(15).select("tag_id", F.col("n").alias("story_count"))


@query(
    f"""{_TAGS}, p AS (SELECT story_id, tag_id FROM st JOIN sto USING (story_id) WHERE status = 'published'), c AS (SELECT a.tag_id, b.tag_id AS related, count(*) AS n FROM p a JOIN p b ON a.story_id = b.story_id AND a.tag_id <> b.tag_id GROUP BY ALL)
SELECT tag_id, related, n FROM (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY n DESC, related) AS k FROM c) WHERE k <= 10"""
)
def related_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags that occur with a tag in published stories, by count and id. A story has few tags, so pairs stay linear in stories."""
    s = views.stories(spark, sf).where("status = 'published'").select("story_id")
    first = F.row_number().over(Window.partitionBy("story_id", "tag_id").orderBy("tag_id"))
    once = dealt(views.articles(spark, sf).select("story_id", "tag_id"), "story_id").withColumn("_first", first).where("_first = 1")
    p = once.select("story_id", "tag_id").join(dealt(s, "story_id"), "story_id", "left_semi")
    pairs = p.join(p.select("story_id", F.col("tag_id").alias("related")), "story_id").where("tag_id <> related").select("tag_id", "related")
    c = dealt(pairs, "tag_id", "related").groupBy("tag_id", "related").agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("tag_id").orderBy(F.desc("n"), "related"))
    return c.withColumn("k", k).where("k <= 10").drop("k")


@query(f"{_TAGS} SELECT story_id FROM sto WHERE status = 'published' AND story_id NOT IN (SELECT story_id FROM st)")
def untagged_stories(spark: SparkSession, sf: str) -> DataFrame:
    return views.stories(spark, sf).where("status = 'published'").select("story_id").join(story_tags(spark, sf), "story_id", "left_anti")


@query(
    f"""{SQL}, n AS (SELECT topic, count(*) FILTER ({age('first_published')} <= 24) AS d1, count(*) FILTER ({age('first_published')} <= 168) AS d7, count(*) FILTER ({age('first_published')} <= 720) AS d30 FROM sto WHERE status = 'published' GROUP BY topic)
SELECT topic, d1, d7, d30, CASE WHEN d1 > 1.5 * d7 / 7 THEN 'rising' WHEN d1 < 0.5 * d7 / 7 THEN 'declining' ELSE 'stable' END AS momentum FROM n"""
)
def topic_momentum(spark: SparkSession, sf: str) -> DataFrame:
    old = hours_between(F.col("first_published"), now())
    n = views.stories(spark, sf).where("status = 'published'").groupBy("topic").agg(*[F.count_if(old <= h).alias(d) for d, h in (("d1", 24), ("d7", 168), ("d30", 720))])
    all_topics = spark.createDataFrame([(t,) for t in TOPICS], "topic string")
    n = all_topics.join(n, "topic", "left").fillna(0)
    return n.withColumn("momentum", F.when(F.col("d1") > 1.5 * F.col("d7") / 7, "rising").when(F.col("d1") < 0.5 * F.col("d7") / 7, "declining").otherwise("stable"))


@query(f"{METRICS} SELECT coalesce(topic, 'all') AS topic, coalesce(region, 'all') AS region, count(*) AS n, sum(n_sources)::BIGINT AS sources FROM sto JOIN met USING (story_id) GROUP BY CUBE (topic, region)")
def coverage_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Beyond the feeds: counts by topic, region, both and neither."""
    s = views.stories(spark, sf).join(cov.metrics(views.articles(spark, sf), now()), "story_id")
    return s.cube("topic", "region").agg(F.count(F.lit(1)).alias("n"), F.sum("n_sources").alias("sources")).select(F.coalesce("topic", F.lit("all")).alias("topic"), F.coalesce("region", F.lit("all")).alias("region"), "n", "sources")


@query(f"{METRICS} SELECT s.story_id FROM sto s JOIN met USING (story_id) WHERE status = 'published' AND n_sources > 1 AND reader_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND story_id NOT IN (SELECT audience FROM eng WHERE action = 'view')")
def saved_unread(spark: SparkSession, sf: str) -> DataFrame:
    """A segment's stories with several sources that nobody has viewed: semi and anti joins."""
    segment = views.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("reader_id"))
    s = views.stories(spark, sf).where("status = 'published'").join(segment, "reader_id", "left_semi").select("story_id")
    several = cov.metrics(views.articles(spark, sf), now()).where("n_sources > 1")
    seen = views.engagement(spark, sf).where("action = 'view'").select(F.col("audience").alias("story_id"))
    return s.join(several, "story_id", "left_semi").join(seen, "story_id", "left_anti")
