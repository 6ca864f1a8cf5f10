"""Queries of ingestion: deduplication, caps, upserts, topic priors, ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..enums import BIASES, TOPICS
from ..functions.basics import half_up, instant, ordinal, pick, stamp
from ..functions.text import fingerprint
from ..operators import coverage as cov
from ..operators import ingest, latest, thin
from ..registry import query
from ..views import BIAS_SQL, SQL, TOPIC_SQL

_FP = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_ITEMS = f"i AS (SELECT doc_id, 'https://' || source || '.example/' || (doc_id % 400) AS canonical_url, 'raw/' || doc_id AS url, source AS source_id, {_FP} AS fingerprint FROM documents WHERE text IS NOT NULL), old AS (SELECT * FROM i WHERE doc_id % 7 = 0), new AS (SELECT * FROM i WHERE doc_id % 7 <> 0)"


def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "documents").where("text is not null")
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), (F.col("doc_id") % 400).cast("string"))
    return d.select("doc_id", url.alias("canonical_url"), F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("source_id"), fingerprint(F.col("text")).alias("fingerprint"))


def _split(spark, sf):
    i = feed_items(spark, sf)
    return i.where("doc_id % 7 <> 0"), i.where("doc_id % 7 = 0")


_FRESH = f"WITH {_ITEMS}, a AS (SELECT n.* FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.canonical_url = n.canonical_url) AND NOT EXISTS (SELECT 1 FROM old o WHERE o.url = n.url) AND NOT EXISTS (SELECT 1 FROM old o WHERE o.source_id = n.source_id AND o.fingerprint = n.fingerprint))"


@query(f"{_FRESH} SELECT doc_id FROM a")
def new_items(spark: SparkSession, sf: str) -> DataFrame:
    """Three anti joins: canonical URL, raw URL, fingerprint within the source."""
    return ingest.without_existing(*_split(spark, sf)).select("doc_id")


@query(
    f"""{_FRESH}, f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY doc_id) = 1)
SELECT doc_id, source_id, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY doc_id DESC) AS k FROM f) WHERE k <= 5"""
)
def ingested_items(spark: SparkSession, sf: str) -> DataFrame:
    """New items, first of each URL, newest five of each source: deduplicated against the table before within the batch."""
    fresh = latest.first_seen(ingest.without_existing(*_split(spark, sf)), ["canonical_url"], ["doc_id"])
    return latest.first_n(fresh, ["source_id"], [F.desc("doc_id")], 5).select("doc_id", "source_id", "k")


@query(f"WITH {_ITEMS} SELECT source_id, count(*) AS n, count(DISTINCT canonical_url) AS urls, count(*) - count(DISTINCT canonical_url) AS repeats FROM new GROUP BY source_id")
def inserted_per_source(spark: SparkSession, sf: str) -> DataFrame:
    n = _split(spark, sf)[0].groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("canonical_url").alias("urls"))
    return n.withColumn("repeats", F.col("n") - F.col("urls"))


@query(
    f"""WITH {_ITEMS}, r AS (SELECT doc_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS round, min(doc_id) OVER (PARTITION BY source_id) AS turn FROM new)
SELECT doc_id, source_id, round::INT AS round, turn FROM r"""
)
def interleaved_items(spark: SparkSession, sf: str) -> DataFrame:
    """Round robin over sources: the order of the queue is by (round, turn)."""
    r = latest.interleaved(_split(spark, sf)[0], "source_id", ["doc_id"])
    return r.select("doc_id", "source_id", "round", F.col("turn.doc_id").alias("turn"))


@query(f"WITH {_ITEMS}, u AS (SELECT canonical_url, max(doc_id) AS doc_id FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY canonical_url) SELECT canonical_url, doc_id FROM u")
def upserted_items(spark: SparkSession, sf: str) -> DataFrame:
    new, old = _split(spark, sf)
    return ingest.upserted(new, old, ["canonical_url"], "doc_id").select("canonical_url", "doc_id")


@query(f"WITH {_ITEMS}, c AS (SELECT fingerprint, min(doc_id) AS hit FROM old GROUP BY fingerprint) SELECT doc_id, hit IS NOT NULL AS cached FROM new LEFT JOIN c USING (fingerprint)")
def embedding_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Which new items find their vector in the cache; the model is asked for the others only."""
    new, old = _split(spark, sf)
    cache = old.select("fingerprint", F.col("fingerprint").alias("embedding_text"), F.lit(True).alias("embedding"), F.col("doc_id").alias("cached_at"))
    out = ingest.embedded(new.withColumn("embedding_text", F.col("fingerprint")), cache, lambda misses: misses.withColumn("embedding", F.lit(False)))
    return out.select("doc_id", F.col("embedding").alias("cached"))


# ratings and priors


_SRC_TOPIC = f"{SQL}, t AS (SELECT source_id, topic, count(*) AS n FROM (SELECT DISTINCT source_id, story_id FROM art) JOIN sto USING (story_id) WHERE status = 'published' AND first_published >= TIMESTAMP '{views.AS_OF}' - INTERVAL 30 DAY GROUP BY ALL), m AS (SELECT source_id, max(n) AS n, sum(n)::BIGINT AS total FROM t GROUP BY source_id)"


@query(f"{_SRC_TOPIC} SELECT m.source_id, CASE WHEN count(*) = 1 THEN min(topic) END AS topic, m.n, total, round(m.n / total, 6) AS confidence FROM m JOIN t ON t.source_id = m.source_id AND t.n = m.n GROUP BY m.source_id, m.n, total")
def source_topic_priors(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's most frequent topic among published stories; none where the first place is shared."""
    return priors(spark, sf).withColumn("confidence", F.round("confidence", 6))


def priors(spark: SparkSession, sf: str, days: int = 30) -> DataFrame:
    """(source_id, topic, n, total, confidence) of the stories that were published in the last days."""
    pairs = views.articles(spark, sf).select("source_id", "story_id").distinct()
    recent = F.col("first_published") >= instant(views.AS_OF) - F.make_dt_interval(F.lit(days))
    s = views.stories(spark, sf).where("status = 'published'").where(recent).select("story_id", "topic")
    return cov.dominant_or_null(pairs.join(s, "story_id"), "source_id", "topic").withColumn("confidence", F.col("n") / F.col("total")).select("source_id", "topic", "n", "total", "confidence")


@query(
    f"""{_SRC_TOPIC}, p AS (SELECT m.source_id, CASE WHEN count(*) = 1 THEN min(topic) END AS topic, total, m.n / total AS c FROM m JOIN t ON t.source_id = m.source_id AND t.n = m.n GROUP BY m.source_id, m.n, total),
v AS (SELECT story_id, topic, round(sum(c), 9) AS w FROM (SELECT DISTINCT story_id, source_id FROM art) JOIN p USING (source_id) WHERE topic IS NOT NULL AND c >= 0.12 AND total >= 10 GROUP BY ALL),
x AS (SELECT story_id, max(w) AS w FROM v GROUP BY story_id) SELECT story_id, CASE WHEN count(*) = 1 THEN min(topic) END AS topic FROM v JOIN x USING (story_id, w) GROUP BY story_id"""
)
def topics_by_priors(spark: SparkSession, sf: str) -> DataFrame:
    """Stories' topics by the confidence of their sources' priors; a tie gives none."""
    members = views.articles(spark, sf).select("story_id", "source_id")
    return thin.by_priors(members, priors(spark, sf), "story_id", confidence=0.12)  # the tables' sources spread their topics evenly


@query(
    """WITH r AS (SELECT s_suppkey, unnest([s_suppkey % 7, (s_suppkey * 3) % 7]) AS b FROM supplier WHERE s_suppkey % 4 <> 3 UNION ALL SELECT s_suppkey, s_suppkey % 7 FROM supplier WHERE s_suppkey % 4 = 3)
SELECT s_suppkey AS source_id, count(*) AS n_ratings, ['far-left', 'left', 'lean-left', 'center', 'lean-right', 'right', 'far-right'][(floor(median(b) + 0.5) + 1)::INT] AS bias FROM r GROUP BY s_suppkey"""
)
def median_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Median of the providers' ratings on the ordered scale, half up."""
    k = F.col("s_suppkey")
    r = views.table(spark, sf, "supplier").select(k.alias("source_id"), F.explode(F.when(k % 4 != 3, F.array(k % 7, (k * 3) % 7)).otherwise(F.array(k % 7))).alias("b"))
    return r.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_ratings"), F.median("b").alias("m")).select("source_id", "n_ratings", pick(BIASES, half_up(F.col("m"))).alias("bias"))


@query(
    """WITH p AS (SELECT split_part(regexp_replace(lower(url), '^https?://', ''), '/', 1) AS domain, page_id FROM pages), rated AS (SELECT DISTINCT domain FROM p WHERE page_id % 3 = 0), s AS (SELECT DISTINCT domain FROM p)
SELECT domain, domain IN (SELECT domain FROM rated) AS matched FROM s"""
)
def rating_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Outlets found in a provider's list by domain."""
    host = F.regexp_extract(F.regexp_replace(F.lower("url"), "^https?://", ""), "^([^/]*)", 1)
    p = views.table(spark, sf, "pages").select("page_id", host.alias("domain"))
    rated = p.where("page_id % 3 = 0").select("domain").distinct().withColumn("matched", F.lit(True))
    return p.select("domain").distinct().join(rated, "domain", "left").select("domain", F.coalesce("matched", F.lit(False)).alias("matched"))


@query(
    f"""{SQL}, n AS (SELECT tag_id, count(DISTINCT story_id) AS n FROM art JOIN sto USING (story_id) WHERE status = 'published' GROUP BY tag_id) SELECT tag.tag_id, coalesce(n, 0) AS story_count FROM tag LEFT JOIN n USING (tag_id)"""
)
def recomputed_tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """UPDATE .. FROM an aggregate, tags without published stories to 0."""
    from .feeds import tag_counts

    t = views.tags(spark, sf).withColumn("n", F.lit(0))
    return ingest.updated_from(t, tag_counts(spark, sf), "tag_id", "n").select("tag_id", F.col("n").alias("story_count"))


@query(f"{SQL} SELECT story_id FROM sto WHERE NOT EXISTS (SELECT 1 FROM art WHERE art.story_id = sto.story_id) ORDER BY story_id LIMIT 50")
def orphan_stories(spark: SparkSession, sf: str) -> DataFrame:
    """What a purge of stories without articles would take, 50 at most."""
    s = views.stories(spark, sf).select("story_id")
    return s.join(views.articles(spark, sf).select("story_id"), "story_id", "left_anti").orderBy("story_id").limit(50)


@query(
    f"""{SQL}, l AS (SELECT DISTINCT story_id, tag_id % 50 AS slug, (line / 10.0) AS relevance FROM art), b AS (SELECT story_id, slug, max(relevance) AS relevance FROM l GROUP BY ALL)
SELECT story_id, slug, relevance::DOUBLE AS relevance FROM b"""
)
def best_tag_links(spark: SparkSession, sf: str) -> DataFrame:
    found = views.articles(spark, sf).select("story_id", (F.col("tag_id") % 50).alias("slug"), F.lit("topic").alias("tag_type"), (F.col("line") / 10.0).alias("relevance"))
    best, _ = ingest.tags_upserted(found, found.limit(0))
    return best.select("story_id", "slug", "relevance")
