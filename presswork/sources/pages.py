"""Crawled pages: titles, links, times, images, feeds, as column expressions over the HTML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_public_url, squeezed

FEED_TYPES = "application/rss\\+xml|application/atom\\+xml|application/xml|text/xml"


def found(html: Column, pattern: str) -> Column:
    """The first group of the first match, null for none or an empty one."""
    v = F.regexp_extract(html, pattern, 1)
    return F.when(v != "", v)


def title(html: Column) -> Column:
    return F.coalesce(F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit(""))


def heading(html: Column) -> Column:
    return squeezed(F.regexp_replace(F.coalesce(found(html, "(?is)<h1[^>]*>(.*?)</h1>"), F.lit("")), "<[^>]*>", " "))


def links(html: Column) -> Column:
    """Distinct targets of links, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit("href=\"([^\"]*)\""), F.lit(1)), lambda x: x != ""))


def absolute(href: Column, base: Column) -> Column:
    """A link's URL from the page it stands on."""
    origin = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, href))


def meta(html: Column, name: str) -> Column:
    tag = F.regexp_extract(html, f"(?is)<meta[^>]*(?:property|name|itemprop)=[\"']{name}[\"'][^>]*>", 0)
    return found(tag, "(?is)content=[\"']([^\"']*)[\"']")


def published_at(html: Column) -> Column:
    """From meta tags, a time element, or linked data; null where none can be read."""
    names = ["article:published_time", "og:published_time", "datePublished", "date", "pubdate", "publish-date"]
    tries = [meta(html, n) for n in names] + [found(html, "(?is)<time[^>]*datetime=[\"']([^\"']*)[\"']"), found(html, "\"datePublished\"\\s*:\\s*\"([^\"]*)\"")]
    return F.coalesce(*[F.try_to_timestamp(t) for t in tries])


def image(html: Column) -> Column:
    return F.coalesce(found(html, "(?is)<article.*?<img[^>]*src=[\"']([^\"']*)[\"']"), meta(html, "og:image"))


def main_text(html: Column) -> Column:
    """Text of the article element, or of the body, without tags, scripts and the commonest entities."""
    body = F.coalesce(found(html, "(?is)<article[^>]*>(.*?)</article>"), found(html, "(?is)<body[^>]*>(.*?)</body>"), html)
    t = F.regexp_replace(F.regexp_replace(body, "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.regexp_replace(t, entity, char)
    return squeezed(t)


def articles(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, image, published_at) of pages (page_id, url, html); the title is the heading where there is one."""
    h = F.col("html")
    return pages.select("page_id", "url", F.when(heading(h) != "", heading(h)).otherwise(title(h)).alias("title"), main_text(h).alias("text"), image(h).alias("image"), published_at(h).alias("published_at"))


def discovered(pages: DataFrame, most: int = 30, robots: DataFrame | None = None) -> DataFrame:
    """(page_id, url): the first `most` public links of each page; hosts that a robots table (host, allowed) forbids go, unknown ones stay."""
    base = F.col("url")
    urls = F.transform(links(F.col("html")), lambda x: absolute(x, base))
    out = pages.select("page_id", F.slice(F.array_distinct(F.filter(urls, is_public_url)), 1, most).alias("u")).select("page_id", F.explode("u").alias("url"))
    if robots is None:
        return out
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return out.withColumn("host", host).join(robots, "host", "left").where(F.coalesce("allowed", F.lit(True))).select("page_id", "url")


def feeds(pages: DataFrame) -> DataFrame:
    """(page_id, feed_url): feeds that link elements of a page name, public ones only, first seen distinct."""
    tags = F.filter(F.regexp_extract_all("html", F.lit("(?i)<link[^>]*>"), F.lit(0)), lambda t: F.lower(t).rlike(f"type=[\"'][^\"']*({FEED_TYPES})"))
    base = F.col("url")
    urls = F.filter(F.transform(tags, lambda t: absolute(F.regexp_extract(t, "(?i)href=[\"']([^\"']+)[\"']", 1), base)), is_public_url)
    return pages.select("page_id", F.explode(F.array_distinct(urls)).alias("feed_url"))
