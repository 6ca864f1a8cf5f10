"""Running state of a story's coverage and the events in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..enums import BIASES, LEFT, MILESTONES, RIGHT
from ..functions.basics import half_up, hours_between, percent

SHIFT, MOST = 15, 20


def states(articles: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per article: place, whether its source is new, sources so far, running percentages p0 .. p6, shift, milestone.

    Articles without a time take no part. All windows share one sort by key.
    """
    by = Window.partitionBy(key).orderBy(*order)
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    a = articles.where("published_at is not null").withColumn("place", F.row_number().over(by))
    a = a.withColumn("new_source", F.row_number().over(Window.partitionBy(key, "source_id").orderBy("place")) == 1)
    state = Window.partitionBy(key).orderBy("place")
    running = state.rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumn("n_sources", F.sum(F.col("new_source").cast("long")).over(running))
    for i, b in enumerate(BIASES):
        n = F.sum((F.col("new_source") & (F.col("bias") == b)).cast("long")).over(running)
        a = a.withColumn(f"p{i}", percent(n, F.col("n_sources")))
    moved = [F.abs(F.col(f"p{i}") - F.lag(f"p{i}").over(state)) >= SHIFT for i in range(len(BIASES))]
    a = a.withColumn("shift", F.coalesce(reduce(lambda x, y: x | y, moved), F.lit(False)))
    return a.withColumn("milestone", F.when(F.col("new_source") & F.col("n_sources").isin(MILESTONES), F.col("n_sources")))


def events(timeline: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """(key, kind, place, sequence): the first `most` events; at one place a new source, then a shift, then a milestone."""
    kinds = F.array(
        F.when(F.col("new_source"), F.struct(F.lit(0).alias("ord"), F.lit("source").alias("kind"))),
        F.when(F.col("shift"), F.struct(F.lit(1).alias("ord"), F.lit("shift").alias("kind"))),
        F.when(F.col("milestone").isNotNull(), F.struct(F.lit(2).alias("ord"), F.lit("milestone").alias("kind"))),
    )
    out = timeline.select(key, "place", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("e")).select(key, "place", "e.ord", "e.kind")
    n = F.row_number().over(Window.partitionBy(key).orderBy("place", "ord"))
    return out.withColumn("sequence", n).where(F.col("sequence") <= most)


def drift(timeline: DataFrame, key: str, least: int = 3) -> DataFrame:
    """States collapsed by time and number of sources, the first of each; stories with fewer than `least` points go."""
    first = F.row_number().over(Window.partitionBy(key, "published_at", "n_sources").orderBy("place"))
    points = timeline.withColumn("_k", first).where("_k = 1").drop("_k")
    return points.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where(F.col("_n") >= least).drop("_n")


def spans(articles: DataFrame, key: str) -> DataFrame:
    """(key, total_articles, span_hours): hours between the first and the last article, rounded."""
    g = articles.groupBy(key).agg(F.count(F.lit(1)).alias("total_articles"), half_up(hours_between(F.min("published_at"), F.max("published_at"))).alias("span_hours"))
    return g.select(key, "total_articles", "span_hours")


def _lane() -> Column:
    """Running shares of the three lanes at a state."""
    total = lambda biases: sum((F.col(f"p{BIASES.index(b)}") for b in biases), F.lit(0))
    return F.struct(total(LEFT).alias("left"), F.col(f"p{BIASES.index('center')}").alias("center"), total(RIGHT).alias("right"))


def momentum(timeline: DataFrame, key: str, source: str, most: int = MOST) -> DataFrame:
    """(key, momentum): how coverage went on from a story's first event to the last of its first `most`."""
    from . import narrative

    ends = events(timeline, key, most).groupBy(key).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    at = timeline.select(key, "place", "n_sources", F.col(source).alias("source"), _lane().alias("lane")).join(ends, key).where("place = first or place = last")
    of = lambda value, place: F.max(F.when(F.col("place") == F.col(place), F.col(value)))
    g = at.groupBy(key).agg(of("source", "first").alias("source"), of("n_sources", "last").alias("n"), of("lane", "first").alias("opening"), of("lane", "last").alias("latest"))
    g = g.join(spans(timeline, key), key)
    return g.select(key, narrative.momentum(F.col("source"), F.col("n"), F.col("span_hours"), F.col("opening"), F.col("latest")).alias("momentum"))
