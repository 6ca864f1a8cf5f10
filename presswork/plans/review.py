"""Queries of review, maintenance and knowledge-base ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..functions.basics import half_up, hours_between, stamp
from ..operators import cluster, ownership, state, verify
from ..registry import query
from ..views import SQL
from ._sql import NOW, age
from .stories import now


@query(
    f"""WITH q AS (SELECT event_id, ts, ['embed', 'cluster', 'assemble'][(event_id % 3 + 1)::INT] AS stage, CASE WHEN event_id % 4 <> 0 THEN ts END AS claimed_at FROM events WHERE event_type = 'error')
SELECT stage, count(*) AS pending, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest, count(*) FILTER ({age('claimed_at')} * 60 > 30) AS stale_claims FROM q GROUP BY stage"""
)
def stage_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Oldest pending item and stale leases of each stage."""
    k = F.col("event_id")
    e = views.table(spark, sf, "events").where("event_type = 'error'")
    q = e.select("ts", F.element_at(F.array(*map(F.lit, ["embed", "cluster", "assemble"])), (k % 3 + 1).cast("int")).alias("stage"), F.when(k % 4 != 0, F.col("ts")).alias("claimed_at"))
    return q.groupBy("stage").agg(F.count(F.lit(1)).alias("pending"), stamp(F.min("ts")).alias("oldest"), F.count_if(hours_between(F.col("claimed_at"), now()) * 60 > 30).alias("stale_claims"))


@query(
    """WITH r AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN value END AS rate, value FROM events)
SELECT user_id, round(arg_max(rate, (ts, event_id)) FILTER (rate IS NOT NULL), 6) AS latest_rate, floor(sum(value) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7) * 100 + 0.5) / 100 AS per_minute FROM r GROUP BY user_id HAVING max(ts) > min(ts)"""
)
def run_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Latest known rate of each run series, and throughput a minute."""
    e = views.table(spark, sf, "events")
    rate = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id", "value"))
    minutes = hours_between(F.col("a"), F.col("b")) * 60
    g = e.groupBy("user_id").agg(F.max(rate).alias("m"), F.sum("value").alias("total"), F.min("ts").alias("a"), F.max("ts").alias("b")).where("b > a")
    return g.select("user_id", F.round("m.value", 6).alias("latest_rate"), half_up(F.col("total") / minutes, 2).alias("per_minute"))


@query(
    """SELECT strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y-%m-%d %H:%M:%S') AS slot, count(*) FILTER (event_type = 'signup') AS queued, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL"""
)
def backlog_series(spark: SparkSession, sf: str) -> DataFrame:
    """Gauges of every quarter of an hour."""
    kind = lambda t, name: F.count_if(F.col("event_type") == t).alias(name)
    g = views.table(spark, sf, "events").groupBy(F.window("ts", "15 minutes").alias("w")).agg(kind("signup", "queued"), kind("purchase", "done"), kind("error", "failed"))
    return g.select(stamp(F.col("w.start")).alias("slot"), "queued", "done", "failed")


@query(
    f"""{SQL}, st AS (SELECT source_id AS subject, (source_id * k) % 25 AS owner, ['P127', 'P749', 'P123'][CASE WHEN source_id % 3 = 0 THEN 1 ELSE k END] AS property, CASE (source_id + k) % 4 WHEN 0 THEN 'preferred' WHEN 1 THEN 'deprecated' ELSE 'normal' END AS rank FROM src CROSS JOIN (SELECT unnest([1, 2, 3]) AS k)),
p AS (SELECT subject, owner, min(CASE rank WHEN 'preferred' THEN 0 ELSE 1 END * 10 + CASE property WHEN 'P127' THEN 0 WHEN 'P749' THEN 1 ELSE 2 END) AS place FROM st WHERE rank <> 'deprecated' GROUP BY ALL),
b AS (SELECT subject, min(place) AS best, count(*) AS n, count(DISTINCT place % 10) AS kinds FROM p GROUP BY subject),
w AS (SELECT subject, n, kinds, min(owner) AS owner, count(*) AS winners FROM p JOIN b USING (subject) WHERE place = best GROUP BY ALL)
SELECT subject, CASE WHEN n = 1 OR (kinds = 1 AND winners = 1) THEN owner END AS owner, NOT (n = 1 OR (kinds = 1 AND winners = 1)) AS ambiguous FROM w"""
)
def resolved_owners(spark: SparkSession, sf: str) -> DataFrame:
    """One owner by its best statement of ownership; owners known by different properties, or of one rank, are ambiguous."""
    s = views.sources(spark, sf).select(F.col("source_id").alias("subject"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    code = (F.col("subject") + F.col("k")) % 4
    st = s.select("subject", ((F.col("subject") * F.col("k")) % 25).alias("owner"), F.element_at(F.array(*map(F.lit, ["P127", "P749", "P123"])), F.when(F.col("subject") % 3 == 0, 1).otherwise(F.col("k"))).alias("property"), F.when(code == 0, "preferred").when(code == 1, "deprecated").otherwise("normal").alias("rank"))
    return ownership.resolved(st)


@query(f"{SQL}, e AS (SELECT source_id FROM src WHERE source_id % 3 = 0), n AS (SELECT source_id % 40 AS source_id, source_id AS line FROM src), k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line) AS r FROM n) SELECT line, CASE WHEN source_id IN (SELECT source_id FROM e) THEN 'exists' WHEN r > 1 THEN 'repeated' ELSE 'created' END AS outcome FROM k")
def bulk_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a bulk import: those that exist, those repeated in the file, those created."""
    s = views.sources(spark, sf).select("source_id")
    known = s.where("source_id % 3 = 0").withColumn("known", F.lit(True))
    new = s.select((F.col("source_id") % 40).alias("source_id"), F.col("source_id").alias("line"))
    r = F.row_number().over(Window.partitionBy("source_id").orderBy("line"))
    return new.withColumn("r", r).join(known, "source_id", "left").select("line", F.when(F.col("known"), "exists").when(F.col("r") > 1, "repeated").otherwise("created").alias("outcome"))


@query(
    """WITH c AS (SELECT conv_id, turn, text, role, CASE WHEN turn % 3 = 0 THEN 'against ' || turn END AS counter, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k FROM conversations WHERE text IS NOT NULL),
f AS (SELECT conv_id, k, min(turn) AS first, max(turn) AS last, arg_max(role, turn) AS side, max(turn) FILTER (counter IS NOT NULL) AS held, arg_max(counter, turn) FILTER (counter IS NOT NULL) AS counter_claim FROM c GROUP BY conv_id, k)
SELECT conv_id, n::INT AS n, last AS turn, side, coalesce(held, last) % 2 = 0 AS disputed, counter_claim FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first, k) AS n FROM f) WHERE n <= 3"""
)
def deduplicated_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Three claims of each conversation, its turns being rounds: the last of equal ones, with a counter-claim that an earlier one had."""
    c = views.table(spark, sf, "conversations").where("text is not null")
    counter = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("against "), F.col("turn").cast("string")))
    rows = c.select("conv_id", F.col("turn").alias("place"), F.col("text").alias("claim"), F.col("role").alias("side"), (F.col("turn") % 2 == 0).alias("disputed"), counter.alias("counter_claim"))
    return verify.merged_claims(rows, "conv_id").select("conv_id", "n", F.col("last").alias("turn"), "side", "disputed", "counter_claim")


@query(
    """WITH t AS (SELECT conv_id, turn, text AS t FROM conversations WHERE text IS NOT NULL), c AS (SELECT conv_id, t, len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS n FROM t)
SELECT conv_id, md5(arg_min(t, ((n < 4)::INT, n, length(t), t))) AS headline_md5 FROM c GROUP BY conv_id"""
)
def representative_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """The shortest of a conversation's openings with four words or more."""
    c = views.table(spark, sf, "conversations").where("text is not null").select("conv_id", F.col("text").alias("t"))
    g = c.groupBy("conv_id").agg(F.collect_set("t").alias("all"))  # turns of one conversation
    return g.select("conv_id", F.md5(verify.representative_headline(F.col("all"))).alias("headline_md5"))


@query(
    """WITH t AS (SELECT item_id, regexp_replace(lower(replace(text, '%', ' percent ')), '[^a-z0-9.]+', ' ', 'g') AS t FROM benchmark),
w AS (SELECT item_id, list_distinct(list_filter(list_transform(regexp_split_to_array(t, '\\s+'), lambda x: regexp_replace(x, '^\\.+|\\.+$', '', 'g')), lambda x: length(x) > 2 OR regexp_matches(x, '[0-9]') OR x IN ('no', 'us', 'uk', 'eu', 'un', 'ai', 'tv'))) AS w FROM t)
SELECT item_id, len(w) AS n_tokens, array_to_string(list_sort(w), ' ') AS tokens FROM w"""
)
def claim_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of passages as claims are compared by."""
    t = views.table(spark, sf, "benchmark").select("item_id", verify.tokens(F.col("text")).alias("t"))
    return t.select("item_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.sort_array("t"), " ").alias("tokens"))


@query(
    f"""{SQL} SELECT story_id, CASE WHEN story_id % 3 = 0 THEN story_id % 4 + 1 ELSE story_id % 4 END AS version, CASE WHEN story_id % 3 = 0 THEN 'pending' ELSE status END AS state FROM sto"""
)
def requeued_stories(spark: SparkSession, sf: str) -> DataFrame:
    """Compare and set: the next version only where the expected one still holds (one in three here)."""
    k = F.col("story_id")
    rows = views.stories(spark, sf).select(k.alias("id"), (k % 4).alias("version"), F.col("status").alias("state"))
    expected = rows.select("id", F.when(F.col("id") % 3 == 0, F.col("version")).otherwise(F.col("version") + 7).alias("version"))
    return state.requeued(rows, expected).select(F.col("id").alias("story_id"), "version", "state")


@query(
    f"""{SQL}, n AS (SELECT story_id, count(DISTINCT source_id) AS n FROM art GROUP BY story_id) SELECT story_id, (story_id % 4 + 1)::INT AS attempts, CASE WHEN story_id % 4 + 1 >= 3 THEN 'promoted' ELSE 'pending' END AS state FROM n WHERE n = 1"""
)
def singleton_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Stories of one source: another attempt, promoted at the third."""
    n = views.articles(spark, sf).groupBy("story_id").agg(F.count_distinct("source_id").alias("n")).where("n = 1")
    a = cluster.attempts(n.select(F.col("story_id").alias("id"), (F.col("story_id") % 4).cast("int").alias("attempts")))
    return a.select(F.col("id").alias("story_id"), "attempts", "state")


@query(
    f"""{SQL}, r AS (SELECT story_id, list_filter(['ai_fallback', 'sparse_coverage', 'processing_anomaly'], lambda x: NOT (x = 'ai_fallback' AND story_id % 2 = 0)) AS reasons FROM sto WHERE status = 'needs_review')
SELECT story_id, array_to_string(list_filter(reasons, lambda x: x <> 'sparse_coverage'), ',') AS reasons, len(list_filter(reasons, lambda x: x NOT IN ('sparse_coverage', 'processing_anomaly'))) = 0 AS publishable FROM r"""
)
def relaxed_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """A reason that no longer counts is taken out; what has none but lesser ones left can be published."""
    k = F.col("story_id")
    reasons = F.filter(F.array(F.when(k % 2 != 0, "ai_fallback"), F.lit("sparse_coverage"), F.lit("processing_anomaly")), lambda r: r.isNotNull())
    lesser = F.array(F.lit("sparse_coverage"), F.lit("processing_anomaly"))
    r = views.stories(spark, sf).where("status = 'needs_review'").select("story_id", reasons.alias("r"))
    return r.select("story_id", F.array_join(F.array_remove("r", "sparse_coverage"), ",").alias("reasons"), (F.size(F.array_except("r", lesser)) == 0).alias("publishable"))


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 0 AND 6 THEN ['far-left', 'left', 'lean-left', 'center', 'lean-right', 'right', 'far-right'][CAST(json_extract_string(props, '$.k') AS INT) + 1] END AS bias FROM events WHERE event_type = 'click'"""
)
def parsed_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads as structs; values outside the vocabulary are null."""
    from ..enums import BIASES

    p = views.table(spark, sf, "events").where("event_type = 'click'").select("event_id", F.from_json("props", "k int").alias("p"))
    bias = F.try_element_at(F.array(*map(F.lit, BIASES)), F.col("p.k") + 1)
    return p.select("event_id", "p.k", F.when(F.col("p.k") >= 0, bias).alias("bias"))
