"""Viewers of the last hours that feed the trending scores, refreshed batch after batch.

Distinct viewers are kept in panes of a quarter of an hour: a batch adds its
new (story, pane, session) rows, and a refresh merges the panes of the last six
hours instead of sliding windows that hold every event 24 times. A batch writes
only folders of its own number, so one that is run again replaces what it wrote;
one query per checkpoint makes refreshes one at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basics import hours_between, instant
from ..operators import coverage

PANE_MINUTES, HOURS, FRESH_HOURS = 15, 6, 168


def pane_of(ts: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / (60 * PANE_MINUTES)) * 60 * PANE_MINUTES)


def panes(events: DataFrame) -> DataFrame:
    """(story_id, pane, session_id, last) of views (story_id, session_id, action, ts): a viewer once in a pane, with the last time."""
    return events.where(F.col("action").isin("view", "read_through")).groupBy("story_id", pane_of(F.col("ts")).alias("pane"), "session_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))


def viewers(panes_: DataFrame, as_of: Column, hours: int = HOURS) -> DataFrame:
    """(story_id, viewers): distinct sessions of the last hours; of the oldest pane only those that were still there after its begin."""
    since = as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    recent = panes_.where((F.col("pane") > since - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(PANE_MINUTES))) & (F.col("last") >= since) & (F.col("pane") <= as_of))
    return recent.groupBy("story_id").agg(F.count_distinct("session_id").alias("viewers"))


def scores(stories: DataFrame, seen: DataFrame, as_of: Column) -> DataFrame:
    """(story_id, score) of stories (story_id, impact_score, articles_24h, factor, first_published): null for those past a week, so that a score that was written before is cleared."""
    age = F.greatest(hours_between(F.col("first_published"), as_of), F.lit(0.0))
    found = stories.join(seen, "story_id", "left")
    score = coverage.trending(F.col("impact_score"), F.col("articles_24h"), F.col("factor"), age, F.coalesce("viewers", F.lit(0)))
    return found.select("story_id", F.coalesce("viewers", F.lit(0)).cast("long").alias("viewers"), F.when(age <= FRESH_HOURS, score).alias("score"))


def _clock(spark: SparkSession, folder: str, batch_id: int):
    """The latest time that batches before this one have seen, as text."""
    if batch_id == 0:
        return None
    return spark.read.parquet(f"{folder}/clock/batch={batch_id - 1}").first().as_of


def refresh(stories: Callable[[SparkSession], DataFrame], folder: str, hours: int = HOURS) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: adds a batch's panes, moves the clock on to its latest event and writes all scores as of then to scores/batch=N.

    stories is read anew for every batch. Panes that no refresh can need any more are removed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.select("story_id", "session_id", "action", "ts").persist()  # read for its panes and for its clock
        new = panes(batch)
        day = F.date_format("pane", "yyyyMMddHHmm").alias("slot")
        new.select("*", day).write.mode("overwrite").partitionBy("slot").parquet(f"{folder}/panes/batch={batch_id}")
        last = batch.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("as_of")).first().as_of
        batch.unpersist()
        as_of = max(filter(None, (last, _clock(spark, folder, batch_id))), default=None)
        spark.createDataFrame([(as_of,)], "as_of string").write.mode("overwrite").parquet(f"{folder}/clock/batch={batch_id}")
        if as_of is None:
            return
        now = F.lit(as_of).cast("timestamp")
        horizon = F.date_format(now - F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(PANE_MINUTES)), "yyyyMMddHHmm")
        kind = "story_id long, pane timestamp, session_id long, last timestamp, batch int, slot string"
        kept = spark.read.schema(kind).option("recursiveFileLookup", "false").parquet(f"{folder}/panes").where((F.col("slot") >= horizon) & (F.col("batch") <= batch_id))
        seen = viewers(kept, now, hours)
        scores(stories(spark), seen, instant(as_of).cast("timestamp")).write.mode("overwrite").parquet(f"{folder}/scores/batch={batch_id}")

    return write


def refreshed(events: DataFrame, stories: Callable[[SparkSession], DataFrame], folder: str, checkpoint: str, hours: int = HOURS):
    """Starts the query that refreshes scores with every batch of a stream of views."""
    return events.writeStream.foreachBatch(refresh(stories, folder, hours)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_scores(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/scores/batch={batch_id}")
