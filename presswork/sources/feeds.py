"""Feeds, news-API files and CSV lists of sources as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enums import BIASES, FACTUALITY, FEED_CATEGORY_REGIONS, FEED_CATEGORY_TOPICS, OWNERSHIP, REGIONS

ITEM = "title string, link string, description string, pubDate string, category array<string>, enclosure struct<_url:string,_type:string>"
SOURCE_HEADER = ["name", "url", "rss_url", "bias", "factuality", "ownership", "region", "slug"]


def categories(raw: Column) -> Column:
    """Trimmed categories without empty ones; null for none."""
    kept = F.filter(F.transform(raw, F.trim), lambda c: c != "")
    return F.when(F.size(kept) > 0, kept)


def feed_date(text: Column) -> Column:
    """Dates of feeds (RFC 822, ISO) as timestamps; null where they cannot be read."""
    short = F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]{3},\\s*", ""), "\\s+(GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(short, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(short, F.lit("d MMM yyyy HH:mm Z")))


def compact_date(text: Column) -> Column:
    """yyyyMMddTHHmmssZ, as a news index writes times."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def items(rows: DataFrame) -> DataFrame:
    """(title, url, description, image, published_at, categories) of raw feed items; title and link are required."""
    text = lambda c: F.trim(F.col(c))
    image = F.when(F.col("enclosure._type").startswith("image/") | F.col("enclosure._type").isNull(), F.col("enclosure._url"))
    out = rows.select(text("title").alias("title"), text("link").alias("url"), text("description").alias("description"), image.alias("image"), feed_date(F.col("pubDate")).alias("published_at"), categories(F.col("category")).alias("categories"))
    return out.where("title <> '' and url <> ''")


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of the RSS files under a path."""
    return items(spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path))


def news_index(rows: DataFrame) -> DataFrame:
    """Articles of a news index (title, url, seendate, socialimage)."""
    return rows.where("trim(title) <> '' and trim(url) <> ''").select(F.trim("title").alias("title"), F.trim("url").alias("url"), F.col("socialimage").alias("image"), compact_date(F.col("seendate")).alias("published_at"))


def news_api(rows: DataFrame) -> DataFrame:
    """Articles of a headline API (title, url, description, urlToImage, publishedAt) that were not taken back."""
    gone = (F.coalesce(F.trim("title"), F.lit("")) == "[Removed]") | (F.coalesce(F.trim("description"), F.lit("")) == "[Removed]")
    kept = rows.where(~gone).where("trim(title) <> '' and trim(url) <> ''")
    return kept.select(F.trim("title").alias("title"), F.trim("url").alias("url"), F.trim("description").alias("description"), F.col("urlToImage").alias("image"), F.try_to_timestamp("publishedAt").alias("published_at"))


def category_topic(raw: Column) -> Column:
    return _by_category(raw, FEED_CATEGORY_TOPICS)


def category_region(raw: Column) -> Column:
    return _by_category(raw, FEED_CATEGORY_REGIONS)


def _by_category(raw: Column, groups: dict[str, list[str]]) -> Column:
    key, out = F.lower(F.trim(raw)), F.lit(None).cast("string")
    for name, values in reversed(groups.items()):
        out = F.when(key.isin(values), name).otherwise(out)
    return out


def error_kind(message: Column) -> Column:
    """timeout, dns_error, http_error, parse_error or unknown, first match."""
    # Marks of messages, by kind.
    timeout = "ETIMEDOUT|ESOCKETTIMEDOUT|AbortError|timeout|timed out"
    dns = "ENOTFOUND|EAI_AGAIN"
    http = "\\b(403|404|429|5[0-9]{2})\\b|Status code"
    parse = "Non-whitespace before first tag|Unexpected close tag|Invalid XML|not well-formed|Unable to parse XML|Attribute without value|Unquoted attribute value|not recognized as RSS"
    return F.when(message.rlike(timeout), "timeout").when(message.rlike(dns), "dns_error").when(message.rlike(http), "http_error").when(message.rlike(parse), "parse_error").otherwise("unknown")


def read_sources_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with errors) of a CSV list of sources; header names in any case, quotes doubled within quotes."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE")
    raw = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    missing = [c for c in ("name", "url") if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    for c in SOURCE_HEADER:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    checks = [F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name is required"), F.when(~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)), "url is not http")]
    for c, values in (("bias", BIASES), ("factuality", FACTUALITY), ("ownership", OWNERSHIP), ("region", REGIONS)):
        checks.append(F.when(F.col(c).isNotNull() & ~F.col(c).isin(values), f"unknown {c}"))
    checked = raw.select(*SOURCE_HEADER).withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))
    return checked.where("size(errors) = 0").drop("errors"), checked.where("size(errors) > 0")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"', mode="overwrite")


def crawl_outcome(results: DataFrame) -> DataFrame:
    """(source_id, n, failed, source_failed) of (source_id, url, error): a source fails only if all its pages did."""
    return results.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed")).withColumn("source_failed", F.col("n") == F.col("failed"))


def failure_kind(message: Column) -> Column:
    """Kind of a page's failure by its message, as it is written; without a message the extraction failed."""
    m = F.coalesce(message, F.lit(""))
    return F.when(m.contains("robots.txt"), "robots_blocked").when(m.contains("SSRF") | m.contains("private"), "ssrf_blocked").when(m.contains("HTTP"), "fetch_error").otherwise("extraction_failed")


def statements_by_owner(parts: dict[str, DataFrame]) -> DataFrame:
    """(subject, owners, labels, kind) from tables (subject, owner, label, kind) of several properties: their union, grouped."""
    out = None
    for name, part in parts.items():
        part = part.select("subject", "owner", "label", "kind", F.lit(name).alias("property"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("subject").agg(F.array_join(F.sort_array(F.collect_set("owner")), "|").alias("owners"), F.array_join(F.sort_array(F.collect_set("label")), "|").alias("labels"), F.min("kind").alias("kind"))
