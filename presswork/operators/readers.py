"""Readers: engagement, bias profiles, blindspots, personal scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..enums import BIASES
from ..functions.basics import half_up, hours_between, ordinal


def unique_viewers(events: DataFrame, as_of: Column, hours: int = 6, key: str = "story_id") -> DataFrame:
    """(key, viewers): distinct sessions that viewed or read in the window."""
    age = hours_between(F.col("created_at"), as_of)
    seen = events.where(F.col("action").isin("view", "read_through") & (age <= hours) & (age >= 0))
    return seen.groupBy(key).agg(F.count_distinct("session_id").alias("viewers"))


def deduplicated(events: DataFrame, keys: list[str], time: str = "created_at", grain: str = "MINUTE") -> DataFrame:
    """One view or read-through per session, story, action and minute; the first by id. Other actions all stay."""
    once = F.col("action").isin("view", "read_through")
    first = F.row_number().over(_window([*keys, "action", F.date_trunc(grain, time)]).orderBy(time, "event_id"))
    kept = events.where(once).withColumn("_k", first).where("_k = 1").drop("_k")
    return kept.unionByName(events.where(~once | F.col("action").isNull()))


def _window(keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def distribution(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bias, percentage): sums of segments' percentages by bias, normalised and rounded, biases without any as 0."""
    sums = [F.sum(F.when(F.col("bias") == b, F.col("percentage")).otherwise(0)).alias(f"s{i}") for i, b in enumerate(BIASES)]
    wide = segments.groupBy(*keys).agg(*sums)
    total = sum((F.col(f"s{i}") for i in range(1, len(BIASES))), F.col("s0"))
    each = F.array(*[F.struct(F.lit(b).alias("bias"), half_up(F.when(total > 0, 100.0 * F.col(f"s{i}") / total).otherwise(0.0)).alias("percentage")) for i, b in enumerate(BIASES)])
    return wide.select(*keys, F.explode(each).alias("e")).select(*keys, "e.bias", "e.percentage")


def reader_blindspots(own: DataFrame, overall: DataFrame) -> DataFrame:
    """Rows of own (reader_id, bias, percentage) whose share is under half of an overall one of 5 or more."""
    o = overall.select("bias", F.col("percentage").alias("overall"))
    return own.join(o, "bias").where((F.col("overall") >= 5) & (F.col("percentage") < F.col("overall") / 2))


def dominant_bias(own: DataFrame) -> DataFrame:
    """(reader_id, dominant): the largest share, ties to the left; null when all are 0."""
    best = own.groupBy("reader_id").agg(F.max(F.struct("percentage", (-ordinal(F.col("bias"), BIASES)).alias("o"), "bias")).alias("b"))
    return best.select("reader_id", F.when(F.col("b.percentage") > 0, F.col("b.bias")).alias("dominant"))


def for_you_score(followed: Column, blindspot_share: Column, age: Column, unread: Column, similar: Column) -> Column:
    """Topic 40, blindspot 30 or 15, recency up to 20 in 48 hours, unread 10, like what was read 15 if unread."""
    recency = F.when(age <= 0, 20).when(age >= 48, 0).otherwise(half_up(20 * (1 - age / 48)))
    gap = F.when(blindspot_share >= 30, 30).when(blindspot_share >= 15, 15).otherwise(0)
    return F.when(followed, 40).otherwise(0) + gap + recency + F.when(unread, 10).otherwise(0) + F.when(unread & similar, 15).otherwise(0)
