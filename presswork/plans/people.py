"""Queries about sources, owners, readers and their engagement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..enums import BIASES
from ..functions.basics import hours_between, ordinal, pick, stamp
from ..operators import coverage as cov
from ..operators import latest, ownership, readers
from ..registry import query
from ..views import BIAS_SQL, SQL
from ._sql import METRICS, age
from .stories import now, story_metrics


@query(f"{SQL} SELECT s.owner_id, bias, count(*) AS n, floor(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY s.owner_id) + 0.5)::INT AS percentage FROM src s WHERE s.owner_id IS NOT NULL GROUP BY s.owner_id, bias")
def owner_bias_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return cov.spectrum(views.sources(spark, sf).where("owner_id is not null"), "owner_id")


@query(
    f"""{SQL}, p AS (SELECT DISTINCT story_id, source_id, owner_id FROM art), c AS (SELECT story_id, p.owner_id, name, count(*) AS n FROM p LEFT JOIN own USING (owner_id) GROUP BY ALL),
g AS (SELECT story_id, sum(n) AS total, coalesce(sum(n) FILTER (owner_id IS NULL), 0) AS unknown, sum(n * n) AS sq FROM c GROUP BY story_id),
f AS (SELECT story_id, name, n FROM c WHERE owner_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY n DESC, name) = 1)
SELECT story_id, total::BIGINT AS total, unknown::BIGINT AS unknown, round(least(sq / (total * total), 1), 6) AS hhi, CASE WHEN 2 * f.n >= total THEN name END AS dominant FROM g LEFT JOIN f USING (story_id)"""
)
def ownership_concentration(spark: SparkSession, sf: str) -> DataFrame:
    p = views.articles(spark, sf).select("story_id", "source_id", "owner_id").distinct()
    named = p.join(views.owners(spark, sf).select("owner_id", "name"), "owner_id", "left")
    c = ownership.concentration(named, "story_id", "owner_id", "name")
    return c.withColumn("hhi", F.round("hhi", 6))


@query(f"{SQL} SELECT owner_id, own.name, owner_type, count(s.source_id) AS n_sources FROM own LEFT JOIN src s USING (owner_id) GROUP BY ALL")
def owner_list(spark: SparkSession, sf: str) -> DataFrame:
    s = views.sources(spark, sf).groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"))
    return views.owners(spark, sf).join(s, "owner_id", "left").select("owner_id", "name", "owner_type", F.coalesce("n", F.lit(0)).alias("n_sources"))


@query(
    """WITH RECURSIVE o AS (SELECT n_nationkey::BIGINT AS owner_id, (100 + n_regionkey)::BIGINT AS parent_id FROM nation UNION ALL SELECT (100 + r_regionkey)::BIGINT, CASE WHEN r_regionkey > 0 THEN (99 + r_regionkey)::BIGINT END FROM region),
h AS (SELECT owner_id, parent_id AS ancestor_id, 1 AS depth FROM o WHERE parent_id IS NOT NULL UNION ALL SELECT h.owner_id, o.parent_id, depth + 1 FROM h JOIN o ON o.owner_id = h.ancestor_id WHERE o.parent_id IS NOT NULL)
SELECT owner_id, ancestor_id, depth FROM h"""
)
def owner_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """All ancestors of every owner; regions form a chain above the nations."""
    n = views.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("owner_id"), (100 + F.col("n_regionkey")).cast("long").alias("parent_id"))
    r = F.col("r_regionkey")
    chain = views.table(spark, sf, "region").select((100 + r).cast("long").alias("owner_id"), F.when(r > 0, (99 + r).cast("long")).alias("parent_id"))
    return ownership.hierarchy(n.unionByName(chain))


@query(
    f"""{SQL}, a AS (SELECT owner_id, story_id, max(published_at) AS seen FROM art WHERE owner_id IS NOT NULL GROUP BY ALL), p AS (SELECT a.owner_id, topic, count(*) AS n FROM a JOIN sto s USING (story_id) WHERE status = 'published' GROUP BY ALL)
SELECT owner_id, topic, n, row_number() OVER (PARTITION BY owner_id ORDER BY n DESC, topic)::INT AS place FROM p"""
)
def owner_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Owner profile: topics of the published stories its sources cover, by count."""
    pairs = views.articles(spark, sf).where("owner_id is not null").select("owner_id", "story_id").distinct()
    s = views.stories(spark, sf).where("status = 'published'").select("story_id", "topic")
    n = pairs.join(s, "story_id").groupBy("owner_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("n"), "topic")))


@query(
    f"""{SQL}, x AS (SELECT owner_id, story_id, source_id, tag_id, published_at, row_number() OVER (PARTITION BY owner_id, story_id ORDER BY published_at DESC, tag_id DESC, source_id DESC, line DESC, shipped DESC, price DESC, quantity DESC) AS k FROM art WHERE owner_id IS NOT NULL)
SELECT owner_id, story_id, source_id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS seen FROM x WHERE k = 1"""
)
def owner_recent_stories(spark: SparkSession, sf: str) -> DataFrame:
    a = latest.latest(views.articles(spark, sf).where("owner_id is not null"), ["owner_id", "story_id"], views.TIES)
    return a.select("owner_id", "story_id", "source_id", stamp(F.col("published_at")).alias("seen"))


@query(
    f"""{SQL} SELECT s.source_id, s.name, s.slug, bias, factuality, ownership, region, o.name AS owner, s.owner_id IS NOT NULL AND o.owner_id IS NULL AS degraded FROM src s LEFT JOIN own o USING (owner_id)
WHERE is_active AND lower(s.name) LIKE '%supplier%' AND list_position(['very-low', 'low', 'mixed', 'high', 'very-high'], factuality) >= 3"""
)
def source_directory(spark: SparkSession, sf: str) -> DataFrame:
    from .feeds import at_least

    s = views.sources(spark, sf).where(F.col("is_active") & F.col("name").ilike("%supplier%")).where(at_least(F.col("factuality"), "mixed"))
    o = views.owners(spark, sf).select("owner_id", F.col("name").alias("owner"), F.lit(True).alias("_known"))
    return s.join(o, "owner_id", "left").select("source_id", "name", "slug", "bias", "factuality", "ownership", "region", "owner", (F.col("owner_id").isNotNull() & F.col("_known").isNull()).alias("degraded"))


@query(
    f"""{SQL}, n AS (SELECT ownership, count(*) AS n FROM src GROUP BY ownership) SELECT (SELECT count(*) FROM src) AS n_sources, (SELECT ownership FROM n ORDER BY n DESC, ownership LIMIT 1) AS leading_ownership, (SELECT count(DISTINCT region) FROM src) AS n_regions"""
)
def directory_insights(spark: SparkSession, sf: str) -> DataFrame:
    s = views.sources(spark, sf)
    by = s.groupBy("ownership").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct(-F.col("n"), "ownership")).alias("first"))
    return s.agg(F.count(F.lit(1)).alias("n_sources"), F.count_distinct("region").alias("n_regions")).join(by).select("n_sources", F.col("first.ownership").alias("leading_ownership"), "n_regions")


@query(f"{SQL} SELECT owner_id, count(*) AS n, string_agg(source_id::VARCHAR, ',' ORDER BY source_id) AS members FROM src WHERE owner_id IS NOT NULL GROUP BY owner_id HAVING count(*) >= 2")
def owner_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = views.sources(spark, sf).where("owner_id is not null").groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("source_id")).alias("m")).where("n >= 2")
    return g.select("owner_id", "n", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


_L, _R = 7, 8


@query(
    f"""{SQL}, x AS (SELECT DISTINCT source_id, story_id FROM art WHERE source_id IN ({_L}, {_R})), j AS (SELECT coalesce(a.story_id, b.story_id) AS story_id, CASE WHEN b.story_id IS NULL THEN 'left' WHEN a.story_id IS NULL THEN 'right' ELSE 'shared' END AS side
  FROM (SELECT * FROM x WHERE source_id = {_L}) a FULL JOIN (SELECT * FROM x WHERE source_id = {_R}) b ON a.story_id = b.story_id) SELECT story_id, side, topic FROM j JOIN sto USING (story_id)"""
)
def source_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Stories that two sources share and those that one of them has alone."""
    return compared(views.articles(spark, sf), _L, _R).join(views.stories(spark, sf).select("story_id", "topic"), "story_id")


def compared(articles: DataFrame, left: int, right: int) -> DataFrame:
    a = articles.where(F.col("source_id") == left).select("story_id", F.lit(True).alias("l")).distinct()
    b = articles.where(F.col("source_id") == right).select("story_id", F.lit(True).alias("r")).distinct()
    return a.join(b, "story_id", "full_outer").select("story_id", F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("shared").alias("side"))


@query(
    f"""{SQL}, x AS (SELECT DISTINCT source_id, story_id FROM art WHERE source_id IN ({_L}, {_R})), t AS (SELECT topic, count(*) FILTER (source_id = {_L}) AS l, count(*) FILTER (source_id = {_R}) AS r FROM x JOIN sto USING (story_id) GROUP BY topic)
SELECT topic, l AS left_count, r AS right_count, row_number() OVER (ORDER BY abs(l - r) + l + r DESC, l DESC, r DESC, topic)::INT AS place FROM t"""
)
def topic_comparison(spark: SparkSession, sf: str) -> DataFrame:
    a = views.articles(spark, sf).where(F.col("source_id").isin(_L, _R)).select("source_id", "story_id").distinct()
    t = a.join(views.stories(spark, sf).select("story_id", "topic"), "story_id").groupBy("topic").agg(F.count_if(F.col("source_id") == _L).alias("l"), F.count_if(F.col("source_id") == _R).alias("r"))
    order = Window.orderBy(F.desc(F.abs(F.col("l") - F.col("r")) + F.col("l") + F.col("r")), F.desc("l"), F.desc("r"), "topic")  # a row per topic
    return t.select("topic", F.col("l").alias("left_count"), F.col("r").alias("right_count"), F.row_number().over(order).alias("place"))


@query(
    f"""{SQL}, x AS (SELECT source_id, story_id, published_at, row_number() OVER (PARTITION BY source_id, story_id ORDER BY published_at DESC, tag_id DESC, line DESC, shipped DESC, price DESC, quantity DESC) AS k FROM art WHERE source_id = 7 AND {age('published_at')} <= 720),
n AS (SELECT topic, count(*) AS n, max(published_at) AS last FROM x JOIN sto USING (story_id) WHERE k = 1 AND status = 'published' GROUP BY topic) SELECT topic, n, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_seen FROM n"""
)
def source_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of one source's published stories of the last thirty days."""
    a = views.articles(spark, sf).where((F.col("source_id") == 7) & (hours_between(F.col("published_at"), now()) <= 720))
    per_story = a.groupBy("story_id").agg(F.max("published_at").alias("last"))
    s = views.stories(spark, sf).where("status = 'published'").select("story_id", "topic")
    return per_story.join(s, "story_id").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), stamp(F.max("last")).alias("last_seen"))


# readers


@query(f"{SQL} SELECT audience, count(DISTINCT session_id) AS viewers FROM eng WHERE action IN ('view', 'read_through') AND {age('created_at')} BETWEEN 0 AND 168 GROUP BY audience")
def unique_viewers(spark: SparkSession, sf: str) -> DataFrame:
    return readers.unique_viewers(views.engagement(spark, sf), now(), 168, "audience")


@query(
    f"""{SQL}, t AS (SELECT audience, count(DISTINCT session_id) AS viewers FROM eng WHERE action IN ('view', 'read_through') AND {age('created_at')} BETWEEN 0 AND 168 GROUP BY audience ORDER BY viewers DESC, audience LIMIT 5)
SELECT t.audience, viewers, s.story_id FROM t JOIN sto s ON s.story_id = t.audience WHERE status = 'published'"""
)
def hot_stories(spark: SparkSession, sf: str) -> DataFrame:
    """The five most seen, of which only the published are shown: the filter comes after the choice."""
    top = readers.unique_viewers(views.engagement(spark, sf), now(), 168, "audience").orderBy(F.desc("viewers"), "audience").limit(5)
    s = views.stories(spark, sf).where("status = 'published'").select("story_id")
    return top.join(s, F.col("audience") == F.col("story_id")).select("audience", "viewers", "story_id")


_PROFILE = f"""{METRICS}, o AS (SELECT bias, sum(pct) AS s FROM spec JOIN sto USING (story_id) WHERE status = 'published' GROUP BY bias), ov AS (SELECT bias, floor(100.0 * s / (SELECT sum(s) FROM o) + 0.5)::INT AS p FROM o),
rd AS (SELECT reader_id, story_id FROM sto WHERE status = 'published' AND factuality IN ('high', 'very-high')), u AS (SELECT reader_id, bias, sum(pct) AS s FROM rd JOIN spec USING (story_id) GROUP BY ALL), ut AS (SELECT reader_id, sum(s) AS t FROM u GROUP BY reader_id),
own_ AS (SELECT ut.reader_id, b.bias, CASE WHEN t > 0 THEN floor(100.0 * coalesce(s, 0) / t + 0.5) ELSE 0 END::INT AS p FROM ut CROSS JOIN (SELECT unnest({BIAS_SQL}) AS bias) b LEFT JOIN u ON u.reader_id = ut.reader_id AND u.bias = b.bias)
"""


READ = "factuality in ('high', 'very-high')"


def _segments(spark, sf):
    s = views.stories(spark, sf).where("status = 'published'").select("story_id", "reader_id", "factuality")
    return cov.spectrum(views.articles(spark, sf)).join(s, "story_id")


def profiles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(own by reader, overall): what readers have read are the stories of theirs with a high factuality."""
    seg = _segments(spark, sf)
    overall = readers.distribution(seg.withColumn("all", F.lit(1)), ["all"]).drop("all")
    return readers.distribution(seg.where(READ), ["reader_id"]), overall


@query(f"{_PROFILE} SELECT reader_id, bias, p AS percentage FROM own_")
def reader_bias_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profiles(spark, sf)[0]


@query(f"{_PROFILE} SELECT reader_id, own_.bias, own_.p AS percentage, ov.p AS overall FROM own_ JOIN ov USING (bias) WHERE ov.p >= 5 AND own_.p < ov.p / 2")
def reader_blindspots(spark: SparkSession, sf: str) -> DataFrame:
    return readers.reader_blindspots(*profiles(spark, sf)).select("reader_id", "bias", "percentage", "overall")


@query(f"{_PROFILE} SELECT reader_id, CASE WHEN max(p) > 0 THEN arg_max(bias, p * 10 - list_position({BIAS_SQL}, bias)) END AS dominant FROM own_ GROUP BY reader_id")
def reader_dominant_bias(spark: SparkSession, sf: str) -> DataFrame:
    return readers.dominant_bias(profiles(spark, sf)[0])


def newest_covered(stories: DataFrame, articles: DataFrame, n: int) -> DataFrame:
    """The n newest stories that have an article: picked before anything of their articles is grouped."""
    return stories.join(articles.select("story_id"), "story_id", "left_semi").orderBy(F.desc("first_published"), F.desc("story_id")).limit(n)


_FORYOU = f"""{_PROFILE}, gap AS (SELECT reader_id, list(own_.bias) AS gaps FROM own_ JOIN ov USING (bias) WHERE ov.p >= 5 AND own_.p < ov.p / 2 GROUP BY reader_id),
cand AS (SELECT story_id, topic, region, first_published FROM sto WHERE status = 'published' AND story_id IN (SELECT story_id FROM met) ORDER BY first_published DESC, story_id DESC LIMIT 200),
rdr AS (SELECT DISTINCT reader_id FROM rd), sim AS (SELECT DISTINCT rd.reader_id, topic, region FROM rd JOIN sto USING (story_id)),
sc AS (SELECT r.reader_id, c.story_id, CASE WHEN topic = (['politics', 'world', 'technology', 'business', 'science', 'health', 'culture', 'sports', 'environment'])[(r.reader_id % 9 + 1)::INT] THEN 40 ELSE 0 END
  + coalesce((SELECT CASE WHEN sum(pct) >= 30 THEN 30 WHEN sum(pct) >= 15 THEN 15 ELSE 0 END FROM spec WHERE spec.story_id = c.story_id AND list_contains(coalesce(g.gaps, []), spec.bias)), 0)
  + CASE WHEN {age('c.first_published')} <= 0 THEN 20 WHEN {age('c.first_published')} >= 48 THEN 0 ELSE floor(20 * (1 - {age('c.first_published')} / 48) + 0.5)::INT END
  + CASE WHEN x.story_id IS NULL THEN 10 ELSE 0 END + CASE WHEN x.story_id IS NULL AND s.topic IS NOT NULL THEN 15 ELSE 0 END AS score, c.first_published
  FROM rdr r CROSS JOIN cand c LEFT JOIN gap g ON g.reader_id = r.reader_id LEFT JOIN rd x ON x.reader_id = r.reader_id AND x.story_id = c.story_id LEFT JOIN sim s ON s.reader_id = r.reader_id AND s.topic = c.topic AND s.region = c.region)
SELECT reader_id, story_id, score::INT AS score, k::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY score DESC, first_published DESC, story_id DESC) AS k FROM sc) WHERE k <= 10"""


@query(_FORYOU.replace(", region, first_published FROM sto", ", region, first_published FROM sto").replace("CASE WHEN topic = (", "CASE WHEN c.topic = ("))
def for_you_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Ten best of the 200 newest published stories for readers (one topic followed each).

    The candidates are bounded by the feed's own limit of 200 rows, so they are one row of their own that
    each reader's row takes its ten best from: no pair is a row that is shuffled or sorted.
    """
    from ..enums import TOPICS
    from ..operators.readers import for_you_score

    own, overall = profiles(spark, sf)
    gaps = readers.reader_blindspots(own, overall).groupBy("reader_id").agg(F.collect_set("bias").alias("gaps"))
    st = views.stories(spark, sf).where("status = 'published'")
    cand = newest_covered(st, views.articles(spark, sf), 200)
    cand = cand.join(cov.spectrum_arrays(views.articles(spark, sf).join(F.broadcast(cand.select("story_id")), "story_id", "left_semi")), "story_id").select("story_id", "topic", "region", "first_published", "spectrum")
    read = st.where(READ).select("reader_id", "story_id", "topic", "region")
    of = read.groupBy("reader_id").agg(F.collect_set(F.struct("topic", "region")).alias("likes")).join(gaps, "reader_id", "left")
    seen = read.join(F.broadcast(cand.select("story_id")), "story_id", "left_semi").groupBy("reader_id").agg(F.collect_set("story_id").alias("seen"))  # of the candidates
    at_once = cand.agg(F.collect_list(F.struct("story_id", "topic", "region", "first_published", "spectrum")).alias("candidates"))  # 200 at most
    rows = of.join(seen, "reader_id", "left").join(F.broadcast(at_once))

    def scored(c):
        share = F.aggregate(F.filter(c["spectrum"], lambda s: F.array_contains(F.coalesce("gaps", F.array().cast("array<string>")), s["bias"])), F.lit(0), lambda a, s: a + s["percentage"])
        unread = ~F.coalesce(F.array_contains("seen", c["story_id"]), F.lit(False))
        similar = F.exists("likes", lambda x: (x["topic"] == c["topic"]) & (x["region"] == c["region"]))
        score = for_you_score(c["topic"] == pick(TOPICS, F.col("reader_id") % 9), share, hours_between(c["first_published"], now()), unread, similar)
        return F.struct(score.alias("score"), c["first_published"].alias("first_published"), c["story_id"].alias("story_id"))

    best = F.slice(F.sort_array(F.transform("candidates", scored), asc=False), 1, 10)
    return rows.select("reader_id", F.posexplode(best).alias("at", "b")).select("reader_id", "b.story_id", "b.score", (F.col("at") + 1).alias("place"))


@query(
    f"""{_PROFILE}, gap AS (SELECT reader_id, own_.bias FROM own_ JOIN ov USING (bias) WHERE ov.p >= 5 AND own_.p < ov.p / 2),
cand AS (SELECT story_id, first_published FROM sto WHERE status = 'published' AND story_id IN (SELECT story_id FROM met) ORDER BY first_published DESC, story_id DESC LIMIT 100),
g AS (SELECT reader_id, c.story_id, first_published, sum(pct) AS share FROM gap CROSS JOIN cand c JOIN spec ON spec.story_id = c.story_id AND spec.bias = gap.bias GROUP BY ALL),
f AS (SELECT * FROM g WHERE share >= 30 AND NOT EXISTS (SELECT 1 FROM rd WHERE rd.reader_id = g.reader_id AND rd.story_id = g.story_id))
SELECT reader_id, story_id, share::BIGINT AS share, k::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY share DESC, first_published DESC, story_id DESC) AS k FROM f) WHERE k <= 10"""
)
def blindspot_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Unread stories of the 100 newest with 30 % or more from a reader's blindspots."""
    gaps = readers.reader_blindspots(*profiles(spark, sf)).select("reader_id", "bias")
    st = views.stories(spark, sf).where("status = 'published'")
    arts = views.articles(spark, sf)
    cand = newest_covered(st, arts, 100).select("story_id", "first_published")
    spec = cov.spectrum(arts.join(F.broadcast(cand.select("story_id")), "story_id", "left_semi"))
    share = spec.join(F.broadcast(cand), "story_id").join(gaps, "bias").groupBy("reader_id", "story_id", "first_published").agg(F.sum("percentage").alias("share")).where("share >= 30")
    read = st.where(READ).select("reader_id", "story_id")
    best = Window.partitionBy("reader_id").orderBy(F.desc("share"), F.desc("first_published"), F.desc("story_id"))
    return share.join(read, ["reader_id", "story_id"], "left_anti").withColumn("place", F.row_number().over(best)).where("place <= 10").select("reader_id", "story_id", "share", "place")


@query(
    f"""{SQL}, d AS (SELECT * FROM eng UNION ALL SELECT * FROM eng), x AS (SELECT *, row_number() OVER (PARTITION BY session_id, audience, action, date_trunc('minute', created_at) ORDER BY created_at, event_id) AS k FROM d)
SELECT action, count(*) AS n FROM x WHERE action IS NOT NULL AND (k = 1 OR action NOT IN ('view', 'read_through')) GROUP BY action"""
)
def deduplicated_engagement(spark: SparkSession, sf: str) -> DataFrame:
    """Every event given twice: views and read-throughs count once a minute, others each time."""
    e = views.engagement(spark, sf).where("action is not null")
    return readers.deduplicated(e.unionByName(e), ["session_id", "audience"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{SQL} SELECT DISTINCT session_id, topic, region FROM eng e JOIN sto s ON s.story_id = e.audience WHERE action = 'read_through' AND {age('created_at')} <= 336 AND status = 'published'"""
)
def read_similar_signals(spark: SparkSession, sf: str) -> DataFrame:
    e = views.engagement(spark, sf).where((F.col("action") == "read_through") & (hours_between(F.col("created_at"), now()) <= 336))
    s = views.stories(spark, sf).where("status = 'published'")
    return e.join(s, e.audience == s.story_id).select("session_id", "topic", "region").distinct()


@query(
    f"""{METRICS}, b AS (SELECT story_id, headline, first_published FROM tre WHERE blind ORDER BY first_published DESC, story_id DESC LIMIT 20) SELECT c_custkey AS reader_id, story_id FROM b CROSS JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c"""
)
def weekly_digest(spark: SparkSession, sf: str) -> DataFrame:
    """The week's 20 newest blindspots for every subscriber; 20 rows are given to each."""
    from .stories import trending_stories

    b = trending_stories(spark, sf).where("is_blindspot").orderBy(F.desc("first_published"), F.desc("story_id")).limit(20).select("story_id")
    c = views.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("reader_id"))
    return c.join(F.broadcast(b))


@query(
    """WITH x AS (SELECT user_id AS reader_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS story_id, max(ts) AS seen, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY ALL)
SELECT reader_id, story_id, strftime(seen, '%Y-%m-%d %H:%M:%S') AS seen, latest FROM x"""
)
def reading_history(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert: the last event of each reader and story wins."""
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("reader_id"), F.get_json_object("props", "$.k").cast("long").alias("story_id"), "ts", "event_id", "event_type")
    g = e.groupBy("reader_id", "story_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return g.select("reader_id", "story_id", stamp(F.col("m.ts")).alias("seen"), F.col("m.event_type").alias("latest"))
