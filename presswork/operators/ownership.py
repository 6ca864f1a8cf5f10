"""Ownership: distribution and concentration, owner profiles, hierarchy, statements of a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..enums import BIASES
from ..functions.basics import hours_between, lookup, ordinal, percent
from .lineage import shared_checkpoint


def distribution(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owner, n, percentage): over all sources of a key, also those without an owner."""
    n = rows.groupBy(key, owner).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percentage", percent(F.col("n"), F.sum("n").over(Window.partitionBy(key))))


def concentration(rows: DataFrame, key: str, owner: str, name: str) -> DataFrame:
    """(key, total, unknown, hhi, dominant): sum of squared shares with the unknown as one bucket, at most 1;
    dominant is the first owner (count, then name) if it has half of all."""
    n = rows.groupBy(key, owner, name).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    known = F.when(F.col(owner).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(name).alias("name")))
    g = n.groupBy(key).agg(total.alias("total"), F.coalesce(F.sum(F.when(F.col(owner).isNull(), F.col("n"))), F.lit(0)).alias("unknown"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.min(known).alias("first"))
    hhi = F.least(F.col("squares") / (F.col("total") * F.col("total")), F.lit(1.0))
    return g.select(key, "total", "unknown", hhi.alias("hhi"), F.when(-2 * F.col("first.n") >= F.col("total"), F.col("first.name")).alias("dominant"))


def hierarchy(owners: DataFrame) -> DataFrame:
    """(owner_id, ancestor_id, depth) of owners (owner_id, parent_id): every ancestor at the least depth it is met; cycles end where they would repeat.

    A loop of joins on the parent: each step's frontier is what the one before
    found and no earlier one had, so there are as many steps as levels.
    """
    parents = owners.where("parent_id is not null and parent_id <> owner_id").select(F.col("owner_id").alias("child"), "parent_id").distinct()
    step = parents.select(F.col("child").alias("owner_id"), F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth"))
    out, depth = step, 1
    while True:
        depth += 1
        further = step.join(parents, step.ancestor_id == parents.child).select("owner_id", F.col("parent_id").alias("ancestor_id"), F.lit(depth).alias("depth")).where("ancestor_id <> owner_id")
        step = shared_checkpoint(further.distinct().join(out.select("owner_id", "ancestor_id"), ["owner_id", "ancestor_id"], "left_anti"))
        if step.isEmpty():
            return out
        out = out.unionByName(step)


# Properties of ownership, the strongest first.
PROPERTY_PLACE = {"P127": 0, "P749": 1, "P123": 2}


def resolved(statements: DataFrame) -> DataFrame:
    """(subject, owner, ambiguous) of statements (subject, owner, property, rank).

    An owner stands for its best statement (preferred rank, then the stronger
    property). A single owner is taken; of several, the one of the better rank,
    provided that their best statements have one property and no two share the
    best rank. All else is ambiguous.
    """
    rank = F.when(F.col("rank") == "preferred", 0).otherwise(1)
    s = statements.where(F.col("rank") != "deprecated").select("subject", "owner", F.struct(rank.alias("r"), F.coalesce(lookup(F.col("property"), PROPERTY_PLACE), F.lit(len(PROPERTY_PLACE))).alias("p")).alias("place"))
    each = s.groupBy("subject", "owner").agg(F.min("place").alias("place"))
    best = each.groupBy("subject").agg(F.min("place").alias("best"), F.count(F.lit(1)).alias("n"), F.min("place.p").alias("lo"), F.max("place.p").alias("hi"))
    top = each.join(best, "subject").where("place = best").groupBy("subject", "n", "lo", "hi").agg(F.min("owner").alias("owner"), F.count(F.lit(1)).alias("winners"))
    sure = (F.col("n") == 1) | ((F.col("lo") == F.col("hi")) & (F.col("winners") == 1))
    return top.select("subject", F.when(sure, F.col("owner")).alias("owner"), (~sure).alias("ambiguous"))


# Owner types by the classes of a public knowledge base.
CLASS_KINDS = {
    "Q891723": "public_company",
    "Q4830453": "private_company",
    "Q17343363": "private_company",
    "Q163740": "nonprofit",
    "Q4287745": "nonprofit",
    "Q5": "individual",
    "Q157031": "public_broadcaster",
    "Q483551": "public_broadcaster",
    "Q131589": "cooperative",
    "Q157857": "state_adjacent",
    "Q18199255": "state_adjacent",
    "Q20530050": "trust",
}


def owner_kind(instance_of: Column) -> Column:
    """Owner type by the first known class of an entity's array of classes; a private company if there is none."""
    kinds = F.filter(F.transform(instance_of, lambda c: lookup(c, CLASS_KINDS)), lambda k: k.isNotNull())
    return F.coalesce(F.get(kinds, F.lit(0)), F.lit("private_company"))


def backfill(owner: Column, current: Column, proposed: Column, overwrite: bool, confidence: Column) -> Column:
    """(action, confidence): what to do with a source that has an owner or none, given the entity its owner has now and the proposed one."""
    same = F.coalesce(current == proposed, F.lit(False))
    action = F.when(owner.isNull(), "insert").when(same, "confirmed").otherwise("link" if overwrite else "mismatch")
    return F.struct(action.alias("action"), F.when(owner.isNull() | same, confidence).otherwise("low").alias("confidence"))


def buckets(sources: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner_id, owner, n, members, place): sources' names by owner, the largest group first, then by the owner's name. Sources without an owner are one group with neither id nor place."""
    named = sources.select("source_id", "name", "owner_id").join(owners.select("owner_id", F.col("name").alias("owner")), "owner_id", "left")
    g = named.groupBy("owner_id").agg(F.first("owner").alias("owner"), F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("name", "source_id"))), lambda x: x["name"]).alias("members"))
    place = F.row_number().over(Window.partitionBy(F.col("owner_id").isNull()).orderBy(F.desc("n"), "owner"))
    return g.withColumn("place", F.when(F.col("owner_id").isNotNull(), place))


def profiles(owners: DataFrame, sources: DataFrame, articles: DataFrame, stories: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """(owner_id, name, n_sources, biases, topics, n_stories): an owner's sources by bias, from left to right, and the topics of the stories its sources have covered in the last `days`, the commonest first."""
    mine = sources.where(F.col("owner_id").isNotNull())
    by_bias = mine.groupBy("owner_id", "bias").agg(F.count(F.lit(1)).alias("n"))
    biases = by_bias.groupBy("owner_id").agg(F.sum("n").alias("n_sources"), F.array_sort(F.collect_list(F.struct(ordinal(F.col("bias"), BIASES).alias("o"), "bias", "n"))).alias("biases"))
    recent = articles.where(F.col("owner_id").isNotNull() & (hours_between(F.col("published_at"), as_of) <= 24 * days)).select("owner_id", "story_id").distinct()
    by_topic = recent.join(stories.select("story_id", "topic"), "story_id").groupBy("owner_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    topics = by_topic.groupBy("owner_id").agg(F.sum("n").alias("n_stories"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "topic", "n"))).alias("topics"))
    out = owners.select("owner_id", "name").join(biases, "owner_id", "left").join(topics, "owner_id", "left")
    return out.select("owner_id", "name", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "biases", "topics", F.coalesce("n_stories", F.lit(0)).alias("n_stories"))
