"""Ingestion of articles: deduplication, caps, inserts, upserts, purges, the embedding cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .latest import first_seen, newest_n


def without_existing(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Items whose canonical URL, raw URL, and (source, title fingerprint) are all unknown; null keys never match."""
    out = items
    for keys in (["canonical_url"], ["url"], ["source_id", "fingerprint"]):
        known = existing.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct()
        out = out.join(known, keys, "left_anti")
    return out


def ingest(items: DataFrame, existing: DataFrame, cap: int = 30, order: list | None = None) -> DataFrame:
    """What is new: not existing, first of each canonical URL, newest `cap` of each source, in that order."""
    order = order or ["place"]
    fresh = first_seen(without_existing(items, existing), ["canonical_url"], order)
    return newest_n(fresh, "source_id", "published_at", order, cap)


def inserted(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Insert that ignores conflicts: the table after it, the rows that were there first winning."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def upserted(new: DataFrame, existing: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert or update: the newest of each key, in new as in the table."""
    from .latest import latest

    return latest(existing.unionByName(new), keys, [version])


def updated_from(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """UPDATE .. FROM: `column` is that of values where it has the key, 0 where it has not."""
    v = values.select(key, F.col(column).alias("_v"))
    return rows.drop(column).join(v, key, "left").withColumn(column, F.coalesce("_v", F.lit(0))).drop("_v")


def embedded(items: DataFrame, cache: DataFrame, model) -> DataFrame:
    """Items (fingerprint, embedding_text, ..) with `embedding`: from the cache where fingerprint and text both match, from the model for the others.

    model takes a DataFrame with embedding_text and adds embedding; it is called for what the cache misses only.
    """
    known = cache.groupBy("fingerprint", "embedding_text").agg(F.min_by("embedding", "cached_at").alias("_hit"))
    joined = items.join(known, ["fingerprint", "embedding_text"], "left")
    hits = joined.where("_hit is not null").withColumn("embedding", F.col("_hit")).drop("_hit")
    return hits.unionByName(model(joined.where("_hit is null").drop("_hit")))


def purged(rows: DataFrame, doomed: DataFrame, key: str, limit: int, as_of, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(what stays, audit): at most `limit` of the doomed, the smallest keys first; a dry run keeps all and lists them."""
    chosen = doomed.select(key).distinct().orderBy(key).limit(limit)
    audit = chosen.agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list(key)), 1, 20).alias("sample_ids")).withColumn("dry_run", F.lit(dry_run)).withColumn("at", as_of)
    return (rows if dry_run else rows.join(chosen, key, "left_anti")), audit


def tags_upserted(found: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links to keep, links to delete) of found and stored (story_id, slug, tag_type, relevance): most relevant of each slug and type; stored ones that are not found go."""
    keys = ["story_id", "slug", "tag_type"]
    best = found.groupBy(*keys).agg(F.max("relevance").alias("relevance"))
    touched = stored.join(found.select("story_id").distinct(), "story_id", "left_semi")
    return best, touched.join(best.select(*keys), keys, "left_anti")


def link_deltas(changes: DataFrame, published: DataFrame) -> DataFrame:
    """(tag_id, delta) of links (story_id, tag_id, op 'insert' or 'delete') that came to or went from published stories."""
    shown = changes.join(published.select("story_id").distinct(), "story_id", "left_semi")
    return shown.select("tag_id", F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0).alias("delta"))


def publication_deltas(changes: DataFrame, links: DataFrame) -> DataFrame:
    """(tag_id, delta) of stories (story_id, old_status, new_status) that became published, or are so no longer."""
    shown = lambda c: F.coalesce(F.col(c) == "published", F.lit(False)).cast("int")
    moved = changes.select("story_id", (shown("new_status") - shown("old_status")).alias("delta")).where("delta <> 0")
    return moved.join(links.select("story_id", "tag_id").distinct(), "story_id").select("tag_id", "delta")


def counts_applied(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """(tag_id, n) after (tag_id, delta): only the tags that changes touch are added up."""
    d = deltas.groupBy("tag_id").agg(F.sum("delta").alias("delta"))
    return counts.join(d, "tag_id", "left").select("tag_id", (F.col("n") + F.coalesce("delta", F.lit(0))).alias("n"))
