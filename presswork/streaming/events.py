"""Engagement, fetch and stage events as streams; every function also takes a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: How late an event may come; later ones are dropped by the stream.
LATE = "1 hour"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Events of parquet files as they come; times become instants, as watermarks take these only."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Views and clicks once per keys and minute while state is kept; other events pass.

    One pass: events that are not deduplicated get keys of their own, so that the stream is read once.
    """
    once = F.col("event_type").isin("view", "click")
    minute = F.date_trunc("MINUTE", "ts")
    own = F.when(once, F.lit(-1)).otherwise(F.col("event_id"))
    return events.withColumn("minute", minute).withColumn("_own", own).withWatermark("ts", late).dropDuplicatesWithinWatermark([*keys, "event_type", "minute", "_own"]).drop("_own", "minute")


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts, sums and approximate distinct users by event time window and type."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "users")


def sliding_viewers(events: DataFrame, length: str = "6 hours", slide: str = "15 minutes", late: str = LATE) -> DataFrame:
    """Exact distinct viewers of sliding windows in two stateful steps: a user once per window, then a count of them."""
    seen = events.where(F.col("event_type").isin("view", "click")).withWatermark("ts", late)
    once = seen.groupBy(F.window("ts", length, slide), "user_id").agg(F.count(F.lit(1)).alias("_n"))
    counted = once.groupBy(F.window(F.window_time("window"), slide).alias("w2"), "window").agg(F.count(F.lit(1)).alias("viewers"))
    return counted.select(F.col("window.start").alias("window_start"), "viewers")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Beyond what was asked of sessions: visits of a user that a gap ends."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


# What an event may name.
ACTIONS = ["view", "dwell", "read_through", "share"]
REFERRERS = ["feed", "for_you", "search", "direct", "external"]
CLIENTS = ["web", "mobile"]


def checked(events: DataFrame) -> DataFrame:
    """Events, batch or stream, with the string `problem`: the first of the fields (story_id, action, dwell_bucket, referrer_kind, client) that is not as it must be, null where all are.

    A dwell event needs its bucket of 0 to 3; other events need none, and no
    event needs a referrer. Rows with a problem are what a quarantine takes.
    """
    uuid = F.col("story_id").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    bucket = F.when(F.col("dwell_bucket").isNull(), F.col("action") != "dwell").otherwise(F.col("dwell_bucket").between(0, 3))
    rules = {
        "story_id": uuid,
        "action": F.col("action").isin(ACTIONS),
        "dwell_bucket": bucket,
        "referrer_kind": F.col("referrer_kind").isNull() | F.col("referrer_kind").isin(REFERRERS),
        "client": F.col("client").isin(CLIENTS),
    }
    return events.withColumn("problem", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def dwell_bucket(seconds: Column) -> Column:
    """Under 5, 30 and 120 seconds, and longer."""
    return F.when(seconds < 5, 0).when(seconds < 30, 1).when(seconds < 120, 2).otherwise(3)


def read_through(scrolled: Column) -> Column:
    """Four fifths of a page or more."""
    return scrolled >= 0.8
