"""Queries of the news desk: thin stories, ownership backfill, lookups with a fallback, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..enums import FEED_CATEGORY_REGIONS, FEED_CATEGORY_TOPICS
from ..functions.basics import effective_time, instant, pick, within
from ..operators import lookups, narrative, ownership, state, thin
from ..registry import query
from ..views import SQL
from ._sql import NOW
from .ingest import _SRC_TOPIC, priors

CATEGORIES = ["Tech", "markets", "World", "sport", "Europe", "weather", "unknown"]


def _case(column: str, groups: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {column} IN ({', '.join(repr(v) for v in vs)}) THEN '{k}'" for k, vs in groups.items()) + " END"


_CAT = "[" + ", ".join(f"'{c.lower()}'" for c in CATEGORIES) + "]"


@query(
    f"""{_SRC_TOPIC}, g AS (SELECT story_id, line, unnest([{_CAT}[(line * 3 + tag_id) % 7 + 1], {_CAT}[(tag_id % 7 + 1)::INT]]) AS raw FROM (SELECT DISTINCT story_id, line, tag_id FROM art WHERE story_id % 3 > 0)),
tv AS (SELECT story_id, v, count(*) AS n FROM (SELECT DISTINCT story_id, line, tag_id, v FROM (SELECT story_id, line, raw, {_case('raw', FEED_CATEGORY_TOPICS)} AS v, 0 AS tag_id FROM g)) WHERE v IS NOT NULL GROUP BY ALL),
tt AS (SELECT story_id, CASE WHEN count(*) FILTER (n = m) = 1 THEN min(v) FILTER (n = m) END AS topic FROM (SELECT *, max(n) OVER (PARTITION BY story_id) AS m FROM tv) GROUP BY story_id),
rv AS (SELECT story_id, v, count(*) AS n FROM (SELECT DISTINCT story_id, line, {_case('raw', FEED_CATEGORY_REGIONS)} AS v FROM g) WHERE v IS NOT NULL GROUP BY ALL),
rr AS (SELECT story_id, CASE WHEN count(*) FILTER (n = m) = 1 THEN min(v) FILTER (n = m) END AS region FROM (SELECT *, max(n) OVER (PARTITION BY story_id) AS m FROM rv) GROUP BY story_id),
p AS (SELECT m.source_id, CASE WHEN count(*) = 1 THEN min(topic) END AS topic, total, m.n / total AS c FROM m JOIN t ON t.source_id = m.source_id AND t.n = m.n GROUP BY m.source_id, m.n, total),
pv AS (SELECT story_id, topic, round(sum(c), 9) AS w FROM (SELECT DISTINCT story_id, source_id FROM art) JOIN p USING (source_id) WHERE topic IS NOT NULL AND c >= 0.12 AND total >= 10 GROUP BY ALL),
pp AS (SELECT story_id, CASE WHEN count(*) FILTER (w = m) = 1 THEN min(topic) FILTER (w = m) END AS topic FROM (SELECT *, max(w) OVER (PARTITION BY story_id) AS m FROM pv) GROUP BY story_id)
SELECT story_id, coalesce(tt.topic, pp.topic, 'politics') AS topic, coalesce(rr.region, 'us') AS region FROM (SELECT DISTINCT story_id FROM art) LEFT JOIN tt USING (story_id) LEFT JOIN pp USING (story_id) LEFT JOIN rr USING (story_id)"""
)
def thin_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topic and region of every story by its articles' categories, its sources' priors, or its titles; a third of the stories has no categories."""
    a = views.articles(spark, sf)
    category = lambda i: pick(CATEGORIES, i % 7)
    given = F.when(F.col("story_id") % 3 > 0, F.array(category(F.col("line") * 3 + F.col("tag_id")), category(F.col("tag_id"))))
    arts = a.select("story_id", F.col("line").alias("article"), "source_id", F.concat(F.lit("Story "), F.col("story_id").cast("string")).alias("title"), given.alias("categories"))
    return thin.classified(arts, priors(spark, sf), "story_id", confidence=0.12)


@query(
    f"""{SQL}, x AS (SELECT source_id, owner_id, CASE WHEN owner_id % 4 > 0 THEN 'Q' || owner_id END AS current, 'Q' || (source_id % 25) AS proposed, CASE source_id % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS given,
  [['Q1', 'Q163740'], ['Q5'], ['Q2'], ['Q483551', 'Q5'], ['Q18199255']][(source_id % 5 + 1)::INT] AS classes FROM src)
SELECT source_id, CASE WHEN owner_id IS NULL THEN 'insert' WHEN current = proposed THEN 'confirmed' ELSE 'mismatch' END AS action, CASE WHEN owner_id IS NULL OR current = proposed THEN given ELSE 'low' END AS confidence,
  ['nonprofit', 'individual', 'private_company', 'public_broadcaster', 'state_adjacent'][(source_id % 5 + 1)::INT] AS owner_type FROM x"""
)
def owner_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """What to do with the proposed owner of every source, and the owner's type by its classes."""
    k = F.col("source_id")
    classes = F.array(*[F.array(*map(F.lit, c)) for c in (["Q1", "Q163740"], ["Q5"], ["Q2"], ["Q483551", "Q5"], ["Q18199255"])])
    current = F.when(F.col("owner_id") % 4 > 0, F.concat(F.lit("Q"), F.col("owner_id").cast("string")))
    decided = ownership.backfill(F.col("owner_id"), current, F.concat(F.lit("Q"), (k % 25).cast("string")), False, F.when(k % 3 == 0, "high").otherwise("medium"))
    out = views.sources(spark, sf).select("source_id", decided.alias("d"), ownership.owner_kind(F.element_at(classes, (k % 5 + 1).cast("int"))).alias("owner_type"))
    return out.select("source_id", "d.action", "d.confidence", "owner_type")


@query(
    f"""{SQL}, s AS (SELECT source_id, name, CASE WHEN source_id % 3 > 0 THEN 'src-' || source_id END AS slug, is_active FROM src), w AS (SELECT 'src-' || source_id AS slug FROM src WHERE source_id % 2 = 0 UNION SELECT slug FROM src WHERE source_id % 2 = 1),
e AS (SELECT w.slug, min(source_id) AS source_id FROM w JOIN s ON s.slug = w.slug GROUP BY w.slug),
d AS (SELECT source_id, regexp_replace(regexp_replace(lower(trim(coalesce(slug, replace(name, '&', ' and ')))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM s WHERE is_active)
SELECT slug, source_id, true AS exact FROM e UNION ALL SELECT w.slug, min(d.source_id), false FROM w JOIN d ON d.slug = w.slug WHERE w.slug NOT IN (SELECT slug FROM e) GROUP BY w.slug"""
)
def sources_by_slug(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by slug; those without one are found by their name."""
    s = views.sources(spark, sf).select("source_id", "name", "slug", "is_active")
    code = F.concat(F.lit("src-"), F.col("source_id").cast("string"))
    wanted = s.where("source_id % 2 = 0").select(code.alias("slug")).unionByName(s.where("source_id % 2 = 1").select("slug"))
    return lookups.sources_by_slug(s.withColumn("slug", F.when(F.col("source_id") % 3 > 0, code)), wanted)


@query(
    f"""{SQL}, x AS (SELECT owner_id, story_id, CASE WHEN source_id % 6 > 0 THEN published_at END AS p, published_at + INTERVAL 5 HOUR AS f FROM art WHERE owner_id IS NOT NULL)
SELECT owner_id, count(DISTINCT story_id) AS n_stories, count(*) FILTER (p IS NULL) AS n_untimed, max(coalesce(p, f)) AS newest FROM x WHERE p >= {NOW} - INTERVAL 7 DAY OR (p IS NULL AND f >= {NOW} - INTERVAL 7 DAY) GROUP BY owner_id"""
)
def owner_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Stories of each owner in the last seven days; articles without a time of publication count from when they were fetched."""
    a = views.articles(spark, sf).where("owner_id is not null")
    a = a.select("owner_id", "story_id", F.when(F.col("source_id") % 6 > 0, F.col("published_at")).alias("published"), (F.col("published_at") + F.expr("interval '5' hour")).alias("fetched"))
    p, f = F.col("published"), F.col("fetched")
    a = a.where(within(p, f, instant(views.AS_OF) - F.make_dt_interval(F.lit(7))))
    return a.groupBy("owner_id").agg(F.count_distinct("story_id").alias("n_stories"), F.count_if(p.isNull()).alias("n_untimed"), F.max(effective_time(p, f)).alias("newest"))


@query(
    f"""{SQL}, x AS (SELECT source_id, failures, CASE WHEN failures > 3 THEN {NOW} + INTERVAL 2 HOUR END AS cooldown_until, CASE WHEN failures >= 10 AND successes < 20 THEN {NOW} END AS disabled_at FROM src),
y AS (SELECT *, source_id % 2 = 0 AND (failures > 0 OR cooldown_until IS NOT NULL OR disabled_at IS NOT NULL) AS cleared FROM x)
SELECT source_id, CASE WHEN cleared THEN 0 ELSE failures END AS failures, CASE WHEN NOT cleared THEN cooldown_until END AS cooldown_until, CASE WHEN NOT cleared THEN disabled_at END AS disabled_at, cleared FROM y"""
)
def reactivated_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources after half of them were put back to work."""
    s = views.sources(spark, sf)
    now = instant(views.AS_OF)
    s = s.select("source_id", "failures", F.when(F.col("failures") > 3, now + F.expr("interval '2' hour")).alias("cooldown_until"), F.when(state.auto_disabled(F.col("failures"), F.col("successes")), now).alias("disabled_at"))
    return state.reactivated(s, s.where("source_id % 2 = 0"))


@query("SELECT event_id AS run_id, ts AS started_at, 'failed' AS status FROM events WHERE event_id % 3 = 2 ORDER BY ts DESC, event_id DESC LIMIT 20")
def failed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The newest runs of one status."""
    e = views.table(spark, sf, "events")
    runs = e.select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), pick(["running", "completed", "failed"], F.col("event_id") % 3).alias("status"))
    return state.runs(runs, "failed", 20)


@query(
    f"""{SQL}, n AS (SELECT story_id, ownership, count(DISTINCT source_id) AS n FROM art GROUP BY ALL), g AS (SELECT story_id, count(*) AS k, list(CASE ownership WHEN 'private-equity' THEN 'private equity' ELSE ownership END || ' (' || n || ')' ORDER BY ownership) AS p FROM n GROUP BY story_id)
SELECT story_id, 'Ownership mix spans ' || k || ' model' || CASE WHEN k = 1 THEN '' ELSE 's' END || ': ' || CASE WHEN k = 1 THEN p[1] ELSE array_to_string(p[1 : k - 1], ', ') || ', and ' || p[k] END || '.' AS ownership_summary FROM g"""
)
def ownership_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence on ownership models of every story, in the order of their names."""
    n = views.articles(spark, sf).groupBy("story_id", "ownership").agg(F.count_distinct("source_id").alias("n"))
    models = n.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("ownership", "n"))).alias("models"))  # eight at most
    return models.select("story_id", narrative.ownership_mix(F.col("models")).alias("ownership_summary"))
