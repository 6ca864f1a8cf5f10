"""Queries about the pipeline: health, backlog, errors, retries, tuning, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..enums import TOPICS
from ..functions.basics import half_up, hours_between, instant, stamp
from ..operators import coverage as cov
from ..operators import state
from ..registry import query
from ..streaming.events import dwell_bucket, read_through
from ..streaming.stateful import health_after
from ..streaming.trending import pane_of, panes, viewers
from ..views import AS_OF, SQL
from ._sql import METRICS, NOW, age
from .stories import now


@query(
    f"""{SQL} SELECT source_id, failures, CASE WHEN failures > 0 THEN least(pow(2, least(failures, 8)), 240)::INT ELSE 0 END AS cooldown_minutes, failures >= 10 AND successes < 20 AS auto_disabled,
  is_active AND NOT (failures >= 10 AND successes < 20) AND failures < 3 AS eligible, failures >= 3 OR (failures >= 10 AND successes < 20) AS needs_attention, source_type FROM src"""
)
def source_health(spark: SparkSession, sf: str) -> DataFrame:
    s = views.sources(spark, sf)
    f, off = F.col("failures"), state.auto_disabled(F.col("failures"), F.col("successes"))
    until = F.when(f >= 3, now() + F.expr("interval 1 minute"))
    return s.select("source_id", "failures", F.when(f > 0, state.cooldown_minutes(f)).otherwise(0).alias("cooldown_minutes"), off.alias("auto_disabled"), state.eligible(F.col("is_active"), off, until, now()).alias("eligible"), ((f >= 3) | off).alias("needs_attention"), "source_type")


@query(f"{SQL} SELECT source_type, count(*) AS total, count(*) FILTER (failures = 0) AS ok, count(*) FILTER (failures > 0) AS failed, sum(successes)::BIGINT AS articles FROM src WHERE is_active GROUP BY source_type")
def ingest_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    s = views.sources(spark, sf).where("is_active")
    return s.groupBy("source_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("failures") == 0).alias("ok"), F.count_if(F.col("failures") > 0).alias("failed"), F.sum("successes").alias("articles"))


@query(
    f"""WITH e AS (SELECT * FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 1000), s AS (SELECT *, user_id % 5 AS stage FROM e)
SELECT stage, event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, arg_max(event_id, (ts, event_id)) AS newest, arg_max(user_id, (ts, event_id)) AS run, arg_max(props, (ts, event_id)) AS payload FROM s GROUP BY stage, event_type"""
)
def top_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings and errors among the newest thousand by stage: the limit is the report's own."""
    e = views.table(spark, sf, "events").where("event_type in ('error', 'signup')").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)
    g = e.groupBy((F.col("user_id") % 5).alias("stage"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), stamp(F.min("ts")).alias("first_seen"), stamp(F.max("ts")).alias("last_seen"), F.max(F.struct("ts", "event_id", "user_id", "props")).alias("m")).select("stage", "event_type", "n", "first_seen", "last_seen", F.col("m.event_id").alias("newest"), F.col("m.user_id").alias("run"), F.col("m.props").alias("payload"))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.count_distinct("user_id").alias("users")).select(stamp(F.col("h")).alias("hour"), "event_type", "n", "total", "users")


@query(
    """WITH g AS (SELECT TIMESTAMP '2024-01-01' + to_minutes((i * 15)::INT) AS w FROM range(0, 2976) t(i)), d AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type IN ('view', 'click'))
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(DISTINCT user_id) AS viewers FROM g JOIN d ON ts >= w AND ts < w + INTERVAL '6 hours' GROUP BY w"""
)
def sliding_viewers(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct viewers in six hours, every quarter of an hour."""
    # windows begin and end at quarters, so a viewer counts once in each before the quarter is given to its 24 windows
    quarter = pane_of(F.col("ts")).cast("timestamp_ntz")
    e = views.table(spark, sf, "events").where("event_type in ('view', 'click')").select("user_id", quarter.alias("ts")).distinct()
    w = e.groupBy(F.window("ts", "6 hours", "15 minutes").alias("w")).agg(F.count_distinct("user_id").alias("viewers"))
    return w.select(stamp(F.col("w.start")).alias("window_start"), "viewers").where("window_start >= '2024-01-01 00:00:00' and window_start < '2024-02-01 00:00:00'")


@query(
    f"""{SQL} SELECT audience AS story_id, count(DISTINCT session_id) AS viewers FROM eng WHERE action IN ('view', 'read_through') AND created_at <= {NOW} AND created_at >= {NOW} - INTERVAL 6 HOUR GROUP BY audience"""
)
def pane_viewers(spark: SparkSession, sf: str) -> DataFrame:
    """Viewers of the last six hours from panes of a quarter, as the stream keeps them."""
    e = views.engagement(spark, sf).select(F.col("audience").alias("story_id"), "session_id", "action", F.col("created_at").alias("ts"))
    return viewers(panes(e), F.lit(views.AS_OF).cast("timestamp"))


@query(
    f"""WITH e AS (SELECT user_id % 50 AS source_id, epoch_us(ts) // 1000 - 1704067200000 AS ms, event_id, event_type IN ('error', 'click', 'signup') AS failed FROM events),
a AS (SELECT *, sum((NOT failed)::INT) OVER w AS successes, lead(ms) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY source_id ORDER BY ms, event_id)),
b AS (SELECT *, sum(failed::INT) OVER (PARTITION BY source_id, successes ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM a),
c AS (SELECT *, max((failures >= 10 AND successes < 20)::INT) OVER (PARTITION BY source_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) = 1 AS off, CASE WHEN failed THEN ms + 60000 * least(pow(2, least(failures, 8)), 240)::BIGINT END AS until FROM b)
SELECT source_id, ms, event_id, failures::INT AS failures, successes::BIGINT AS successes, off AS auto_disabled, until AS cooldown_until, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS told FROM c UNION ALL
SELECT source_id, until, NULL, failures, successes, off, NULL, 'eligible' FROM c WHERE until IS NOT NULL AND NOT off AND (nxt IS NULL OR nxt >= until)"""
)
def source_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Health of sources after each fetch, and the ends of their cooldowns: what the stream with timers tells."""
    e = views.table(spark, sf, "events")
    h = health_after(e.select((F.col("user_id") % 50).alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").isin("error", "click", "signup").alias("failed")))
    start = F.unix_millis(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return h.withColumns({"ms": F.col("ms") - start, "cooldown_until": F.col("cooldown_until") - start})


@query(
    f"""{METRICS}, x AS (SELECT status <> 'draft' AS e, m.story_id IS NOT NULL AND status <> 'draft' AS c, m.story_id IS NOT NULL AND status <> 'draft' AND s.story_id % 3 > 0 AS a, status = 'published' AS r, first_published FROM sto s LEFT JOIN m0 m USING (story_id))
SELECT count(*) FILTER (NOT e) AS unembedded, count(*) FILTER (e AND NOT c) AS unclustered, count(*) FILTER (c AND NOT a) AS unassembled, count(*) FILTER (a AND NOT r) AS review_queue, round(greatest(max(CASE WHEN NOT a THEN {age('first_published')} * 60 END), 0), 6) AS oldest_minutes FROM x"""
)
def backlog_gauges(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts wait for vectors, stories without articles for clusters, every third of the rest for assembly, what is not published for review."""
    has = views.articles(spark, sf).select("story_id").distinct().withColumn("has", F.lit(True))
    s = views.stories(spark, sf).join(has, "story_id", "left")
    embedded = F.col("status") != "draft"
    clustered = embedded & F.col("has").isNotNull()
    flags = {"embedded": embedded, "clustered": clustered, "assembled": clustered & (F.col("story_id") % 3 > 0), "reviewed": F.col("status") == "published"}
    out = state.backlog(s.withColumns(flags), now(), "first_published")
    return out.withColumn("oldest_minutes", F.round("oldest_minutes", 6))


@query(
    f"""{SQL}, r AS (SELECT story_id, status, list_filter(['ai_fallback', 'processing_anomaly', 'sparse_coverage'], lambda x: CASE x WHEN 'ai_fallback' THEN story_id % 3 = 0 WHEN 'processing_anomaly' THEN story_id % 4 = 0 ELSE story_id % 5 = 0 END) AS reasons FROM sto WHERE status = 'needs_review'),
x AS (SELECT story_id, unnest(reasons) AS reason FROM r) SELECT reason, count(*) AS n FROM x GROUP BY reason"""
)
def review_reasons(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("story_id")
    reasons = F.filter(F.array(F.when(k % 3 == 0, "ai_fallback"), F.when(k % 4 == 0, "processing_anomaly"), F.when(k % 5 == 0, "sparse_coverage")), lambda r: r.isNotNull())
    return views.stories(spark, sf).where("status = 'needs_review'").select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{SQL} SELECT story_id, CASE WHEN story_id % 3 = 0 OR story_id % 4 = 0 THEN 'needs_review' ELSE 'published' END AS decision, floor((0.9 - 0.25 * ((story_id % 3 = 0)::INT + (story_id % 4 = 0)::INT)) * 100 + 0.5) / 100 AS confidence,
  concat_ws(',', CASE WHEN story_id % 3 = 0 THEN 'ai_fallback' END, CASE WHEN story_id % 4 = 0 THEN 'processing_anomaly' END) AS reasons FROM sto"""
)
def publication_decisions(spark: SparkSession, sf: str) -> DataFrame:
    d = cov.publication(F.col("story_id") % 3 == 0, F.col("story_id") % 4 == 0)
    return views.stories(spark, sf).select("story_id", d.alias("d")).select("story_id", F.col("d.status").alias("decision"), "d.confidence", F.array_join("d.reasons", ",").alias("reasons"))


@query(f"{SQL} SELECT topic, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'draft') AS draft FROM sto GROUP BY topic")
def review_stats(spark: SparkSession, sf: str) -> DataFrame:
    return views.stories(spark, sf).groupBy("topic").pivot("status", ["published", "needs_review", "draft"]).count().fillna(0)


@query(
    """SELECT user_id AS id, event_id % 7 AS retries, CASE WHEN event_id % 7 + 1 >= 5 THEN 'dead_letter' ELSE 'retry' END AS state, CASE WHEN event_id % 7 + 1 < 5 THEN strftime(ts + to_seconds(least(60 * pow(2, event_id % 7 + 1), 3600)::INT), '%Y-%m-%d %H:%M:%S') END AS next_attempt_at, event_id FROM events WHERE event_type = 'error'"""
)
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Failures to their next attempt or the dead letters."""
    e = views.table(spark, sf, "events").where("event_type = 'error'")
    rows = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 7).alias("retries"), "ts", "user_id")
    out = state.after_failure(rows, "embed", F.col("ts"), "user_id")
    return out.select(F.col("user_id").alias("id"), (F.col("retries") - 1).alias("retries"), "state", stamp(F.col("next_attempt_at")).alias("next_attempt_at"), F.col("id").alias("event_id"))


@query(
    f"""SELECT event_id FROM events WHERE event_type = 'error' AND (event_id % 3 = 0 OR {age('ts')} * 60 > 30) AND (event_id % 5 <> 0 OR ts <= {NOW}) ORDER BY ts, event_id LIMIT 100"""
)
def claimable_items(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").where("event_type = 'error'")
    k = F.col("event_id")
    q = e.select(k.alias("id"), F.col("ts").alias("created_at"), F.when(k % 3 != 0, F.col("ts")).alias("claimed_at"), F.when(k % 5 == 0, F.col("ts")).alias("next_attempt_at"))
    return state.claimable(q, now(), 30, 100).select(F.col("id").alias("event_id"))


@query(
    """WITH RECURSIVE d AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'purchase'), l AS (SELECT user_id, list(value ORDER BY k DESC) AS v FROM d WHERE k <= 5 GROUP BY user_id),
r AS (SELECT user_id, v, 1 AS i, v[1] AS e FROM l UNION ALL SELECT user_id, v, i + 1, 0.4 * v[i + 1] + 0.6 * e FROM r WHERE i < len(v)), m AS (SELECT user_id, e FROM r WHERE i = len(v))
SELECT user_id, round(e, 6) AS ema, CASE WHEN e > 60 THEN greatest(10, floor(100 * 60.0 / e))::INT WHEN e <= 36 THEN least(120, ceil(100 * 1.25))::INT ELSE 100 END AS batch, CASE WHEN e > 60 THEN 'over_budget' WHEN e <= 36 THEN CASE WHEN ceil(100 * 1.25) >= 120 THEN 'at_ceiling' ELSE 'under_budget' END ELSE 'under_budget' END AS reason FROM m"""
)
def batch_tuning(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential mean of the last five durations and the batch it recommends."""
    e = views.table(spark, sf, "events").where("event_type = 'purchase'")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = e.withColumn("k", k).where("k <= 5").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "value"))).alias("l"))
    m = last.withColumn("ema", state.ema(F.transform("l", lambda x: x["value"])))
    return m.select("user_id", F.round("ema", 6).alias("ema"), state.recommended_batch(F.col("ema"), F.lit(100), 60.0, 10, 120).alias("r")).select("user_id", "ema", "r.batch", "r.reason")


@query(
    """WITH s AS (SELECT user_id, max((ts, event_id)) FILTER (event_type = 'click') AS started, max((ts, event_id)) FILTER (event_type = 'purchase') AS done FROM events GROUP BY user_id)
SELECT user_id FROM s WHERE started IS NOT NULL AND (done IS NULL OR started > done)"""
)
def in_flight(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose newest start has no later completion."""
    e = views.table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    g = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("at"))).alias("s"), F.max(F.when(F.col("event_type") == "purchase", F.col("at"))).alias("d"))
    return g.where("s is not null and (d is null or s > d)").select("user_id")


@query("SELECT event_id, CASE WHEN value < 5 THEN 0 WHEN value < 30 THEN 1 WHEN value < 120 THEN 2 ELSE 3 END AS bucket, value - floor(value) >= 0.8 AS read_through, date_diff('day', TIMESTAMP '2024-01-01', ts)::INT AS day FROM events WHERE event_type = 'signup'")
def dwell_buckets(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    e = views.table(spark, sf, "events").where("event_type = 'signup'")
    return e.select("event_id", dwell_bucket(v).alias("bucket"), read_through(v - F.floor(v)).alias("read_through"), F.date_diff("ts", F.lit("2024-01-01")).alias("day"))


@query(
    f"""WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, least(n, 3) AS used, n > 3 AS blocked FROM d"""
)
def daily_quota(spark: SparkSession, sf: str) -> DataFrame:
    """A daily counter of three that starts anew with the day."""
    d = views.table(spark, sf, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("user_id", F.date_format("d", "yyyy-MM-dd").alias("day"), F.least("n", F.lit(3)).alias("used"), (F.col("n") > 3).alias("blocked"))


@query(f"{SQL} SELECT story_id, status IS DISTINCT FROM stored AS status_changed, topic IS DISTINCT FROM stored_topic AS topic_changed FROM (SELECT *, CASE WHEN story_id % 6 = 0 THEN NULL ELSE status END AS stored, CASE WHEN story_id % 4 = 0 THEN 'politics' ELSE topic END AS stored_topic FROM sto)")
def assembly_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Stored against recomputed fields, null-safe."""
    s = views.stories(spark, sf).withColumn("stored", F.when(F.col("story_id") % 6 != 0, F.col("status"))).withColumn("stored_topic", F.when(F.col("story_id") % 4 == 0, "politics").otherwise(F.col("topic")))
    return s.select("story_id", (~F.col("status").eqNullSafe(F.col("stored"))).alias("status_changed"), (~F.col("topic").eqNullSafe(F.col("stored_topic"))).alias("topic_changed"))


_AUDIT = f"{SQL}, a AS (SELECT story_id, status IS DISTINCT FROM CASE WHEN story_id % 6 = 0 THEN NULL ELSE status END AS s, topic IS DISTINCT FROM CASE WHEN story_id % 4 = 0 THEN 'politics' ELSE topic END AS t, region IS DISTINCT FROM CASE WHEN story_id % 5 = 0 THEN 'uk' ELSE region END AS r FROM sto)"


@query(f"{_AUDIT} SELECT f AS field, sum(c::INT)::BIGINT AS changed, count(*) AS n, min(story_id) FILTER (c) AS example FROM (SELECT story_id, unnest(['status', 'topic', 'region']) AS f, unnest([s, t, r]) AS c FROM a) GROUP BY f")
def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many stories each field would change of, and the first of them."""
    k = F.col("story_id")
    s = views.stories(spark, sf)
    stored = {"status": F.when(k % 6 != 0, F.col("status")), "topic": F.when(k % 4 == 0, "politics").otherwise(F.col("topic")), "region": F.when(k % 5 == 0, "uk").otherwise(F.col("region"))}
    return state.audited(s.withColumns({f"stored_{c}": v for c, v in stored.items()}), "story_id", list(stored))


@query(
    """SELECT user_id, round(100.0 * avg(CAST(json_extract_string(props, '$.k') AS INT)) / 100, 6) AS mean_k, round(max(value) FILTER (event_type = 'purchase'), 6) AS top, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id"""
)
def json_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of JSON payloads, the newest event's type, a conditional maximum."""
    e = views.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    g = e.groupBy("user_id").agg(F.round(F.avg("k"), 6).alias("mean_k"), F.round(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))), 6).alias("top"), F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return g.select("user_id", "mean_k", "top", F.col("m.event_type").alias("last_type"))
