"""Queries over one story's coverage: metrics, trending, timelines, framing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..enums import BIASES, LEFT, OWNERSHIP, RIGHT
from ..functions.basics import age_hours, dealt, hours_between, instant, ordinal, percent, stamp
from ..operators import coverage as cov
from ..operators import latest, narrative, readers, timeline
from ..registry import query
from ._sql import IN_LEFT, IN_RIGHT, METRICS, NOW, age
from ..views import BIAS_SQL, FACT_SQL, OWNERSHIP_SQL, SQL


def now():
    return instant(views.AS_OF)


def story_metrics(spark: SparkSession, sf: str, wanted: DataFrame | None = None) -> DataFrame:
    """All stories, or those that are wanted, with metrics, spectrum, blindspot and phase; other stories' articles are left before they are grouped."""
    arts = views.articles(spark, sf)
    if wanted is not None:
        arts = arts.join(dealt(wanted.select("story_id"), "story_id"), "story_id", "left_semi")
    return cov.facts(arts, now()).withColumn("is_blindspot", cov.blindspot(F.col("spectrum"), F.col("n_sources")))


def trending_stories(spark: SparkSession, sf: str, viewers_hours: int = 6, wanted: DataFrame | None = None) -> DataFrame:
    """Published stories, or those of them that are wanted, of the last seven days with their metrics and score."""
    s = (views.stories(spark, sf) if wanted is None else wanted).where(F.col("status") == "published")
    s = s.where(hours_between(F.col("first_published"), now()) <= 168)
    seen = readers.unique_viewers(views.engagement(spark, sf), now(), viewers_hours, "audience")
    out = s.join(story_metrics(spark, sf, s), "story_id").join(seen, "audience", "left").withColumn("viewers", F.coalesce("viewers", F.lit(0)))
    factor = cov.diversity_factor(F.col("spectrum"))
    return out.withColumn("factor", factor).withColumn("score", cov.trending(F.col("impact_score"), F.col("articles_24h"), factor, age_hours(F.col("first_published"), now()), F.col("viewers")))


@query(f"{METRICS} SELECT story_id, headline, topic, region, n_sources, impact_score, articles_24h, viewers, blind AS is_blindspot, round(score, 6) AS score FROM tre ORDER BY tre.score DESC NULLS LAST, first_published DESC, story_id DESC LIMIT 20")
def trending_feed(spark: SparkSession, sf: str) -> DataFrame:
    t = trending_stories(spark, sf).orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("first_published"), F.desc("story_id")).limit(20)
    return t.select("story_id", "headline", "topic", "region", "n_sources", "impact_score", "articles_24h", "viewers", "is_blindspot", F.round("score", 6).alias("score"))


@query(f"{METRICS} SELECT story_id, viewers, round(factor, 6) AS factor, round(score, 6) AS score FROM tre")
def trending_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The persisted refresh: every story in the window; the others' scores are null and not listed."""
    return trending_stories(spark, sf).select("story_id", "viewers", F.round("factor", 6).alias("factor"), F.round("score", 6).alias("score"))


@query(f"{METRICS} SELECT story_id, bias, n, pct AS percentage FROM spec")
def bias_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return cov.spectrum(views.articles(spark, sf))


@query(f"{METRICS} SELECT story_id, string_agg(bias || ':' || pct, ',' ORDER BY ord) AS spectrum FROM spec GROUP BY story_id")
def spectrum_by_order(spark: SparkSession, sf: str) -> DataFrame:
    s = cov.spectrum_arrays(views.articles(spark, sf))
    return s.select("story_id", F.array_join(F.transform("spectrum", lambda x: F.concat_ws(":", x["bias"], x["percentage"].cast("string"))), ",").alias("spectrum"))


@query(f"{METRICS} SELECT story_id, n_sources > 1 AND (l >= 80 OR r >= 80) AS is_blindspot FROM met JOIN side USING (story_id)")
def blindspots(spark: SparkSession, sf: str) -> DataFrame:
    return story_metrics(spark, sf).select("story_id", "is_blindspot")


@query(
    f"""{METRICS} SELECT story_id, articles_24h, articles_48h, articles_7d, n_articles, n_sources, source_diversity, round(coverage_hours, 6) AS coverage_hours, impact_score,
  CASE WHEN articles_24h >= 3 AND {age('first_published')} < 24 THEN 'breaking' WHEN articles_24h >= 1 AND {age('first_published')} < 168 THEN 'developing' WHEN articles_24h = 0 AND articles_7d >= 2 THEN 'analysis' ELSE 'aftermath' END AS phase
  FROM met JOIN sto USING (story_id)"""
)
def story_velocity(spark: SparkSession, sf: str) -> DataFrame:
    m = cov.metrics(views.articles(spark, sf), now()).join(views.stories(spark, sf).select("story_id", "first_published"), "story_id")
    p = cov.phase(F.col("articles_24h"), F.col("articles_7d"), hours_between(F.col("first_published"), now()))
    return m.select("story_id", "articles_24h", "articles_48h", "articles_7d", "n_articles", "n_sources", "source_diversity", F.round("coverage_hours", 6).alias("coverage_hours"), "impact_score", p.alias("phase"))


@query(
    f"""{SQL}, c AS (SELECT story_id, ownership, count(*) AS n, list_position({OWNERSHIP_SQL}, ownership) AS o FROM art GROUP BY ALL),
f AS (SELECT story_id, factuality, count(*) AS n, list_position({FACT_SQL}, factuality) AS o FROM art GROUP BY ALL)
SELECT story_id, a.ownership, b.factuality FROM (SELECT story_id, arg_min(ownership, -n * 100 + o) AS ownership FROM c GROUP BY story_id) a JOIN (SELECT story_id, arg_min(factuality, -n * 100 + o) AS factuality FROM f GROUP BY story_id) b USING (story_id)"""
)
def dominant_values(spark: SparkSession, sf: str) -> DataFrame:
    from ..enums import FACTUALITY

    arts = views.articles(spark, sf)
    return cov.dominant(arts, "story_id", "ownership", OWNERSHIP).drop("n").join(cov.dominant(arts, "story_id", "factuality", FACTUALITY).drop("n"), "story_id")


@query(
    f"""{METRICS}, b AS (SELECT story_id, (max((bias IN ({IN_LEFT}))::INT) + max((bias = 'center')::INT) + max((bias IN ({IN_RIGHT}))::INT)) AS buckets FROM art GROUP BY story_id)
SELECT story_id, n_sources, buckets, CASE WHEN n_sources = 1 THEN 'single' WHEN n_sources >= 3 AND buckets >= 2 THEN 'rich' ELSE 'thin' END AS path FROM met JOIN b USING (story_id)"""
)
def assembly_routing(spark: SparkSession, sf: str) -> DataFrame:
    g = views.articles(spark, sf).groupBy("story_id").agg(F.count_distinct("source_id").alias("n_sources"), cov.buckets(F.collect_set("bias")).alias("buckets"))
    return g.withColumn("path", cov.assembly_path(F.col("n_sources"), F.col("buckets")))


@query(
    f"""{METRICS}, d AS (SELECT story_id, n_sources, l::INT AS l, c::INT AS c, r::INT AS r, CASE WHEN c = greatest(l, c, r) THEN 'center' WHEN r = greatest(l, c, r) THEN 'right' ELSE 'left' END AS dominant,
  least(l, c, r)::INT AS thin, CASE WHEN l = least(l, c, r) THEN 'left' WHEN c = least(l, c, r) THEN 'center' ELSE 'right' END AS thinnest, (l > 0)::INT + (c > 0)::INT + (r > 0)::INT AS k FROM side JOIN met USING (story_id))
SELECT story_id, l AS "left", c AS center, r AS "right", dominant, 'Coverage leans ' || dominant || ' overall: ' || l || '% left, ' || c || '% center, ' || r || '% right.' AS overview,
  CASE WHEN greatest(l, c, r) >= 70 THEN 'Coverage gap: the story is heavily ' || dominant || '-weighted, with only ' || CASE dominant WHEN 'left' THEN c || '% center' ELSE l || '% left' END || ' coverage and '
    || CASE dominant WHEN 'right' THEN c || '% center' ELSE r || '% right' END || ' coverage.'
  WHEN thin = 0 THEN 'Coverage gap: ' || thinnest || ' coverage is missing from the current source mix.'
  WHEN thin < 15 THEN 'Coverage gap: ' || thinnest || ' is the thinnest lane at ' || thin || '%, so it is worth checking additional sources from that perspective.'
  ELSE 'No major coverage gap is visible: left, center, and right lanes are all represented in the current source mix.' END AS coverage_gap,
  'This view combines ' || n_sources || ' sources across ' || k || ' active lane' || CASE WHEN k = 1 THEN '' ELSE 's' END || '. Blindspot flags trigger when one lane dominates coverage, and the timeline updates as new sources join the cluster.' AS methodology
FROM d"""
)
def story_intelligence(spark: SparkSession, sf: str) -> DataFrame:
    m = story_metrics(spark, sf).withColumn("lane", cov.lanes(F.col("spectrum")))
    lane = F.col("lane")
    return m.select("story_id", "lane.left", "lane.center", "lane.right", "lane.dominant", narrative.overview(lane).alias("overview"), narrative.coverage_gap(lane).alias("coverage_gap"), narrative.methodology(F.col("n_sources"), lane).alias("methodology"))


@query(
    f"""{METRICS}, x AS (SELECT story_id, bias, n, ord, floor(100.0 * n / sum(n) OVER w)::INT AS f, 100.0 * n / sum(n) OVER w - floor(100.0 * n / sum(n) OVER w) AS rest FROM spec WINDOW w AS (PARTITION BY story_id)),
y AS (SELECT *, 100 - sum(f) OVER (PARTITION BY story_id) AS missing, row_number() OVER (PARTITION BY story_id ORDER BY rest DESC, ord) AS k FROM x)
SELECT story_id, bias, (f + (k <= missing)::INT)::INT AS share FROM y"""
)
def display_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    s = cov.spectrum(views.articles(spark, sf)).withColumn("ord", ordinal(F.col("bias"), BIASES))
    return cov.largest_remainder(s, "story_id", "n", "ord").select("story_id", "bias", "share")


@query(
    f"""{SQL}, t AS (SELECT story_id, string_agg(text, ' ') FILTER (bias IN ({IN_LEFT})) AS l, string_agg(text, ' ') FILTER (bias IN ({IN_RIGHT})) AS r
  FROM (SELECT doc_id % 50 AS story_id, text, {BIAS_SQL}[(doc_id % 7 + 1)::INT] AS bias FROM documents) GROUP BY story_id),
w AS (SELECT story_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(l), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: length(x) > 2)) AS l,
  list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(r), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: length(x) > 2)) AS r FROM t WHERE l IS NOT NULL AND r IS NOT NULL),
u AS (SELECT story_id, len(l) + len(r) - len(list_intersect(l, r)) AS un, len(list_intersect(l, r)) AS shared FROM w)
SELECT story_id, CASE WHEN un > 0 THEN floor(least((un - shared) / un, 1) * 100 + 0.5) / 100 ELSE 0 END AS controversy FROM u"""
)
def framing_controversy(spark: SparkSession, sf: str) -> DataFrame:
    """Divergence of the words of left and right texts; the words of a side are a distinct set before they are gathered."""
    from ..functions.basics import pick

    docs = views.table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("story_id"), "text", pick(BIASES, F.col("doc_id") % 7).alias("bias"))
    sided = docs.withColumn("side", F.when(F.col("bias").isin(LEFT), "l").when(F.col("bias").isin(RIGHT), "r")).where("side is not null and text is not null")
    words = sided.select("story_id", "side", F.explode(cov.words_of_framing(F.col("text"))).alias("w")).distinct()
    by_word = words.groupBy("story_id", "w").agg(F.count(F.lit(1)).alias("sides"))
    sums = by_word.groupBy("story_id").agg(F.count(F.lit(1)).alias("un"), F.count_if(F.col("sides") == 2).alias("both"))
    both = sided.groupBy("story_id").agg(F.count_distinct("side").alias("k")).where("k = 2").select("story_id")
    apart = F.least((F.col("un") - F.col("both")) / F.col("un"), F.lit(1.0))
    return both.join(sums, "story_id", "left").select("story_id", F.coalesce(F.floor(apart * 100 + 0.5) / 100.0, F.lit(0.0)).alias("controversy"))


_ORDER = "published_at, tag_id, source_id, line, shipped, price, quantity"
_DESC = ", ".join(f"{c} DESC" for c in _ORDER.split(", "))


@query(f"{SQL} SELECT story_id, source_id, source, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, tag_id FROM (SELECT *, row_number() OVER (PARTITION BY story_id, source_id ORDER BY {_DESC}) AS k FROM art) WHERE k = 1")
def latest_article_per_source(spark: SparkSession, sf: str) -> DataFrame:
    a = latest.latest(views.articles(spark, sf), ["story_id", "source_id"], views.TIES)
    return a.select("story_id", "source_id", "source", stamp(F.col("published_at")).alias("published_at"), "tag_id")


@query(
    f"""{SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY story_id, source ORDER BY {_DESC}) AS k FROM art)
SELECT story_id, source, bias, tag_id, row_number() OVER (PARTITION BY story_id ORDER BY list_position({BIAS_SQL}, bias), source)::INT AS place FROM h WHERE k = 1"""
)
def headlines_by_bias(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's newest headline of a story, ordered from left to right."""
    a = latest.latest(views.articles(spark, sf), ["story_id", "source"], views.TIES)
    place = F.row_number().over(Window.partitionBy("story_id").orderBy(ordinal(F.col("bias"), BIASES), "source"))
    return a.select("story_id", "source", "bias", "tag_id", place.alias("place"))


_TIMELINE = f"""{SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY {_ORDER}) AS k FROM art),
f AS (SELECT *, (row_number() OVER (PARTITION BY story_id, source_id ORDER BY k) = 1)::INT AS new_source FROM o),
c AS (SELECT *, sum(new_source) OVER w AS n_sources, {', '.join(f"sum(CASE WHEN bias = '{b}' THEN new_source ELSE 0 END) OVER w AS b{i}" for i, b in enumerate(BIASES))} FROM f WINDOW w AS (PARTITION BY story_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, {', '.join(f"floor(100.0 * b{i} / n_sources + 0.5)::INT AS p{i}" for i in range(7))} FROM c),
g AS (SELECT *, {', '.join(f"lag(p{i}) OVER w AS q{i}" for i in range(7))} FROM p WINDOW w AS (PARTITION BY story_id ORDER BY k)),
e AS (SELECT *, q0 IS NOT NULL AND ({' OR '.join(f"abs(p{i} - q{i}) >= 15" for i in range(7))}) AS shift, CASE WHEN new_source = 1 AND n_sources IN (5, 10, 25, 50, 100) THEN n_sources END AS milestone FROM g)
"""


@query(f"{_TIMELINE} SELECT story_id, k::INT AS place, source_id, new_source = 1 AS new_source, n_sources::BIGINT AS n_sources, shift, milestone::BIGINT AS milestone, concat_ws(',', {', '.join(f'p{i}' for i in range(7))}) AS running FROM e")
def story_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Running sources and spectrum of every story, with shifts and milestones."""
    t = timeline.states(views.articles(spark, sf), "story_id", views.TIES)
    running = F.concat_ws(",", *[F.col(f"p{i}").cast("string") for i in range(7)])
    return t.select("story_id", "place", "source_id", "new_source", "n_sources", "shift", "milestone", running.alias("running"))


@query(
    f"""{_TIMELINE}, v AS (SELECT story_id, k, 0 AS ord, 'source' AS kind FROM e WHERE new_source = 1 UNION ALL SELECT story_id, k, 1, 'shift' FROM e WHERE shift UNION ALL SELECT story_id, k, 2, 'milestone' FROM e WHERE milestone IS NOT NULL)
SELECT story_id, kind, k::INT AS place, n::INT AS sequence FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY k, ord) AS n FROM v) WHERE n <= 20"""
)
def timeline_events(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.events(timeline.states(views.articles(spark, sf), "story_id", views.TIES), "story_id").select("story_id", "kind", "place", "sequence")


@query(
    f"""{_TIMELINE}, d AS (SELECT story_id, published_at, n_sources, p3 AS center, row_number() OVER (PARTITION BY story_id, published_at, n_sources ORDER BY k) AS r FROM e)
SELECT story_id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS at, n_sources::BIGINT AS n_sources, center FROM d WHERE r = 1 AND story_id IN (SELECT story_id FROM d WHERE r = 1 GROUP BY story_id HAVING count(*) >= 3)"""
)
def bias_drift(spark: SparkSession, sf: str) -> DataFrame:
    t = timeline.states(views.articles(spark, sf), "story_id", views.TIES)
    d = timeline.drift(t, "story_id")
    return d.select("story_id", stamp(F.col("published_at")).alias("at"), "n_sources", F.col("p3").alias("center"))


@query(
    f"""{SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY story_id, bias ORDER BY {_ORDER}) AS k FROM art) SELECT story_id, bias, source_id, tag_id, k::INT AS k FROM s WHERE k <= 2"""
)
def sample_by_bias(spark: SparkSession, sf: str) -> DataFrame:
    """At most two articles of each bias as a model would be shown."""
    return latest.first_n(views.articles(spark, sf), ["story_id", "bias"], views.TIES, 2).select("story_id", "bias", "source_id", "tag_id", "k")


@query(
    f"""{SQL}, x AS (SELECT story_id, source, tag_id, CASE WHEN bias IN ({IN_LEFT}) THEN 'left' WHEN bias = 'center' THEN 'center' ELSE 'right' END AS lane,
  CASE bias WHEN 'left' THEN 0 WHEN 'lean-left' THEN 1 WHEN 'far-left' THEN 2 WHEN 'center' THEN 0 WHEN 'right' THEN 0 WHEN 'lean-right' THEN 1 ELSE 2 END AS pref FROM art)
SELECT story_id, lane, min(struct_pack(pref := pref, source := source)).source AS source FROM x GROUP BY story_id, lane"""
)
def headline_roundup(spark: SparkSession, sf: str) -> DataFrame:
    """One source for each lane: the plain bias first, then leaning, then far."""
    lane = F.when(F.col("bias").isin(LEFT), "left").when(F.col("bias") == "center", "center").otherwise("right")
    pref = F.when(F.col("bias").isin("left", "center", "right"), 0).when(F.col("bias").isin("lean-left", "lean-right"), 1).otherwise(2)
    a = views.articles(spark, sf).withColumn("lane", lane)
    return a.groupBy("story_id", "lane").agg(F.min(F.struct(pref.alias("pref"), "source")).alias("best")).select("story_id", "lane", "best.source")


@query(
    f"""{SQL}, w AS (SELECT story_id, label, e.embedding, CASE factuality WHEN 'very-low' THEN 0.5 WHEN 'low' THEN 0.75 WHEN 'mixed' THEN 1.0 WHEN 'high' THEN 1.25 ELSE 1.5 END * exp(-ln(2.0) * greatest({age('published_at')}, 0) / 24) AS w
  FROM (SELECT DISTINCT story_id, tag_id, factuality, published_at FROM art) a JOIN embeddings e ON e.vec_id = a.tag_id % 400),
x AS (SELECT story_id, w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM w) 
SELECT story_id, round(sum(v * v), 6) AS norm2, round(sum(v), 6) AS total FROM (SELECT story_id, i, sum(w * x) / sum(w) AS v FROM x GROUP BY story_id, i) GROUP BY story_id"""
)
def weighted_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids of stories' vectors, weighted by factuality and age; shown by norm and sum."""
    a = views.articles(spark, sf).select("story_id", "tag_id", "factuality", "published_at").distinct()
    a = a.select("story_id", (F.col("tag_id") % 400).alias("vec_id"), cov.article_weight(F.col("factuality"), F.col("published_at"), now()).alias("w"))
    named = views.table(spark, sf, "embeddings").where(F.abs("vec_id") < 400).select("vec_id", "embedding")  # all that a rest of 400 can name
    c = cov.weighted_centroid(a, "story_id", "embedding", "w", named, "vec_id")
    norm = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x)
    return c.select("story_id", F.round(norm, 6).alias("norm2"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
