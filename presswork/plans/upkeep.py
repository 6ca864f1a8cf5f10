"""Queries of upkeep: ratings of providers, search and facets of sources, old states, tag counts by changes, checks of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions.basics import pick
from ..operators import ingest, lookups, ratings, state
from ..registry import query
from ..streaming import events as stream
from ..views import BIAS_SQL, FACT_SQL, SQL
from .feeds import story_tags, tag_counts

MBFC = [*ratings.PROVIDER_BIASES["mbfc"], *ratings.SKIPPED["mbfc"], "other"]
ALLSIDES = [*ratings.PROVIDER_BIASES["allsides"], "mixed"]
LEVELS = [*ratings.PROVIDER_FACTUALITY["mbfc"], "unknown"]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


@query(
    f"""{SQL}, s AS (SELECT source_id, CASE WHEN source_id % 17 <> 0 THEN 'src-' || (source_id % 60) || '.example' END AS domain, bias, factuality, source_id % 5 = 0 AS fixed FROM src),
me AS (SELECT source_id AS pos, 'src-' || (source_id % 40) || '.example' AS domain, {_sql_list(MBFC)}[((source_id * 5) % {len(MBFC)} + 1)::INT] AS b, {_sql_list(LEVELS)}[((source_id * 3) % {len(LEVELS)} + 1)::INT] AS f FROM src WHERE source_id % 3 <> 0),
ae AS (SELECT source_id AS pos, 'src-' || (source_id % 45) || '.example' AS domain, {_sql_list(ALLSIDES)}[((source_id * 7) % {len(ALLSIDES)} + 1)::INT] AS b FROM src WHERE source_id % 4 <> 0),
mr AS (SELECT domain, {_sql_case('arg_max(b, pos)', ratings.PROVIDER_BIASES['mbfc'])} AS b, {_sql_case('arg_max(f, pos)', ratings.PROVIDER_FACTUALITY['mbfc'])} AS f FROM me GROUP BY domain HAVING arg_max(b, pos) NOT IN ({_sql_list(ratings.SKIPPED['mbfc'])[1:-1]})),
ar AS (SELECT domain, arg_max(b, pos) AS b, NULL AS f FROM ae GROUP BY domain HAVING arg_max(b, pos) <> 'mixed'),
r AS (SELECT source_id, count(*) AS n, {BIAS_SQL}[(floor(median(list_position({BIAS_SQL}, b) - 1) + 0.5) + 1)::INT] AS b, {FACT_SQL}[(floor(median(list_position({FACT_SQL}, f) - 1) + 0.5) + 1)::INT] AS f
  FROM s JOIN (SELECT * FROM mr UNION ALL SELECT * FROM ar) USING (domain) GROUP BY source_id)
SELECT source_id, CASE WHEN domain IS NULL THEN 'skipped' WHEN fixed THEN 'overridden' WHEN n IS NULL THEN 'unmatched' ELSE 'updated' END AS outcome, coalesce(n, 0) AS n_ratings,
  CASE WHEN fixed THEN bias ELSE coalesce(b, bias) END AS bias, CASE WHEN fixed THEN factuality ELSE coalesce(f, factuality) END AS factuality FROM s LEFT JOIN r USING (source_id)"""
)
def rating_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of every source after a sync with two providers' lists; sources with an override keep theirs."""
    s = views.sources(spark, sf)
    k = F.col("source_id")
    url = lambda start, n, end: F.concat(F.lit(start), (k % n).cast("string"), F.lit(end))
    given = s.select("source_id", F.when(k % 17 != 0, url("https://www.src-", 60, ".example/news?x=1")).alias("url"), "bias", "factuality", (k % 5 == 0).alias("bias_override"))
    mbfc = s.where("source_id % 3 <> 0").select(F.lit("mbfc").alias("provider"), k.alias("position"), url("http://SRC-", 40, ".Example:8080/").alias("url"), pick(MBFC, (k * 5) % len(MBFC)).alias("bias"), pick(LEVELS, (k * 3) % len(LEVELS)).alias("factuality"))
    allsides = s.where("source_id % 4 <> 0").select(F.lit("allsides").alias("provider"), k.alias("position"), url("src-", 45, ".example").alias("url"), pick(ALLSIDES, (k * 7) % len(ALLSIDES)).alias("bias"), F.lit(None).cast("string").alias("factuality"))
    return ratings.synced(given, mbfc.unionByName(allsides))


@query(f"{SQL} SELECT source_id, name, bias FROM src WHERE (contains(lower(name), '00_1') OR contains(slug, '00001') OR contains(slug, 'r-0')) AND bias IN ('left', 'center', 'right') AND region IN ('us', 'uk') ORDER BY list_position({BIAS_SQL}, bias), name")
def source_search(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of two facets whose name or slug holds a text, by the order of bias."""
    s = views.sources(spark, sf)
    found = lookups.matching(s, "00_1", "name", "slug").unionByName(lookups.matching(s, "00001", "name", "slug")).unionByName(lookups.matching(s, "R-0", "name", "slug")).distinct()
    chosen = {"bias": ["left", "center", "right"], "factuality": [], "ownership": [], "region": ["us", "uk"]}
    return lookups.faceted(found, chosen, "bias").select("source_id", "name", "bias")


@query(
    f"""{SQL}, x AS (SELECT story_id, CASE status WHEN 'published' THEN 'approved' WHEN 'draft' THEN 'rejected' ELSE 'pending' END AS r, story_id % 4 = 0 AS waits, CASE WHEN story_id % 3 > 0 THEN story_id % 3 = 1 END AS told FROM sto)
SELECT story_id, CASE WHEN r = 'pending' AND waits THEN 'pending' ELSE 'completed' END AS assembly_status, CASE r WHEN 'approved' THEN 'published' WHEN 'rejected' THEN 'rejected' ELSE CASE WHEN waits THEN 'draft' ELSE 'needs_review' END END AS publication_status,
  r AS review_status, CASE WHEN r <> 'pending' OR waits THEN '' WHEN told THEN 'legacy_pending_review' ELSE 'legacy_data_repair' END AS reasons FROM x"""
)
def legacy_states(spark: SparkSession, sf: str) -> DataFrame:
    """States of stories that have a review status, a headline and perhaps a summary only."""
    k = F.col("story_id")
    review = F.when(F.col("status") == "published", "approved").when(F.col("status") == "draft", "rejected").otherwise("pending")
    headline = F.when(k % 4 == 0, "Pending headline generation").otherwise(F.col("headline"))
    s = views.stories(spark, sf).select("story_id", state.legacy_state(review, headline, F.when(k % 3 > 0, k % 3 == 1)).alias("s"))
    return s.select("story_id", "s.assembly_status", "s.publication_status", "s.review_status", F.array_join("s.review_reasons", ",").alias("reasons"))


@query(
    f"""{SQL}, l AS (SELECT DISTINCT story_id, tag_id FROM art), st AS (SELECT story_id, CASE story_id % 5 WHEN 0 THEN 'published' WHEN 1 THEN 'draft' ELSE status END AS status FROM sto),
n AS (SELECT tag_id, count(*) AS n FROM l JOIN st USING (story_id) WHERE status = 'published' AND (story_id + tag_id) % 3 <> 0 GROUP BY tag_id)
SELECT tag_id, coalesce(n, 0) AS story_count FROM tag LEFT JOIN n USING (tag_id)"""
)
def changed_tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tag counts kept up by changes: a third of the links goes, then stories are published and withdrawn. The SQL counts anew."""
    stories, links = views.stories(spark, sf), story_tags(spark, sf)
    counts = views.tags(spark, sf).select("tag_id").join(tag_counts(spark, sf), "tag_id", "left").select("tag_id", F.coalesce("n", F.lit(0)).alias("n"))
    gone = (F.col("story_id") + F.col("tag_id")) % 3 == 0
    left = ingest.link_deltas(links.where(gone).withColumn("op", F.lit("delete")), stories.where("status = 'published'"))
    new = F.when(F.col("story_id") % 5 == 0, "published").when(F.col("story_id") % 5 == 1, "draft")
    moved = ingest.publication_deltas(stories.select("story_id", F.col("status").alias("old_status"), new.alias("new_status")).where("new_status is not null"), links.where(~gone))
    return ingest.counts_applied(counts, left.unionByName(moved)).select("tag_id", F.col("n").alias("story_count"))


@query(
    """WITH x AS (SELECT event_id, event_id % 9 = 0 AS bad_id, event_type, event_id % 6 AS bucket, event_id % 7 AS ref, event_id % 11 AS client FROM events)
SELECT event_id, CASE WHEN bad_id THEN 'story_id' WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') OR event_type IS NULL THEN 'action' WHEN (bucket = 5 AND event_type = 'signup') OR bucket = 4 THEN 'dwell_bucket'
  WHEN ref = 6 THEN 'referrer_kind' WHEN client > 1 AND client < 4 THEN 'client' END AS problem FROM x"""
)
def event_problems(spark: SparkSession, sf: str) -> DataFrame:
    """The field for which each event would go to quarantine, null for those that are taken."""
    k = F.col("event_id")
    story = F.when(k % 9 == 0, "not an id").otherwise(F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.hex(k), 12, "0")))
    bucket = F.when(k % 6 != 5, (k % 6).cast("int"))
    e = views.engagement(spark, sf).select("event_id", story.alias("story_id"), "action", bucket.alias("dwell_bucket"), pick([*stream.REFERRERS, None, "mail"], k % 7).alias("referrer_kind"), F.when(k % 11 == 2, "tv").when(k % 11 != 3, pick(stream.CLIENTS, k % 2)).alias("client"))
    return stream.checked(e).select("event_id", "problem")


@query(
    """WITH a AS (SELECT DISTINCT 'a' || l_orderkey || '-' || l_linenumber AS article_id, 'https://n.example/' || l_orderkey || '/' || l_linenumber AS url, 's' || l_orderkey AS story_id, l_orderkey AS k, l_linenumber AS line FROM lineitem),
i AS (SELECT article_id AS item_id, story_id, k + line AS e FROM a UNION ALL SELECT 's' || o_orderkey, 's' || o_orderkey, o_orderkey FROM orders),
c AS (SELECT item_id, story_id, CASE WHEN e % 4 > 0 THEN e % 4 ELSE 0 END AS ev, CASE WHEN e % 5 = 0 THEN 1 ELSE 0 END AS dead FROM i),
q AS (SELECT article_id AS query, 'article' AS resolved, story_id, article_id FROM a WHERE line = 1 AND k % 10 = 1 UNION ALL SELECT url, 'article', story_id, article_id FROM a WHERE line = 2 AND k % 10 = 2),
r1 AS (SELECT query, resolved, q.story_id, 1 AS n_articles, (SELECT sum(ev) FROM c WHERE item_id = q.article_id) + (SELECT sum(ev) FROM c WHERE item_id = q.story_id) AS n_events, (SELECT sum(dead) FROM c WHERE item_id = q.article_id) + (SELECT sum(dead) FROM c WHERE item_id = q.story_id) AS n_dead FROM q),
r2 AS (SELECT story_id AS query, 'story' AS resolved, story_id, count(*) - 1 AS n_articles, sum(ev) AS n_events, sum(dead) AS n_dead FROM c WHERE story_id IN (SELECT 's' || o_orderkey FROM orders WHERE o_orderkey % 10 = 3) GROUP BY story_id),
r3 AS (SELECT 'x' || o_orderkey AS query, 'none' AS resolved, NULL AS story_id, 0 AS n_articles, 0 AS n_events, 0 AS n_dead FROM orders WHERE o_orderkey % 10 = 4)
SELECT query, resolved, story_id, n_articles::BIGINT AS n_articles, n_events::BIGINT AS n_events, n_dead::BIGINT AS n_dead FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)"""
)
def journeys(spark: SparkSession, sf: str) -> DataFrame:
    """What ids and URLs of articles, ids of stories and unknown texts lead to, with the events and dead letters on the way."""
    text = lambda start, c: F.concat(F.lit(start), F.col(c).cast("string"))
    a = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line")).distinct()
    a = a.select("k", "line", F.concat(text("a", "k"), F.lit("-"), F.col("line").cast("string")).alias("article_id"), F.concat(text("https://n.example/", "k"), F.lit("/"), F.col("line").cast("string")).alias("url"), text("s", "k").alias("story_id"))
    s = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text("s", "o_orderkey").alias("story_id"), text("x", "o_orderkey").alias("unknown"))
    items = a.select(F.col("article_id").alias("item_id"), (F.col("k") + F.col("line")).alias("e")).unionByName(s.select(F.col("story_id").alias("item_id"), F.col("k").alias("e")))
    events = items.where("e % 4 > 0").select("item_id", F.explode(F.sequence(F.lit(1), (F.col("e") % 4).cast("int"))).alias("n"))
    asked = [a.where("line = 1 and k % 10 = 1").select(F.col("article_id").alias("query")), a.where("line = 2 and k % 10 = 2").select("url"), s.where("k % 10 = 3").select("story_id"), s.where("k % 10 = 4").select("unknown")]
    wanted = asked[0].union(asked[1]).union(asked[2]).union(asked[3])
    return lookups.journeys(wanted, a, s, events, items.where("e % 5 = 0"))
