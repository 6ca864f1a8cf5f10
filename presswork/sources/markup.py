"""Feeds and pages as markup: RSS, RDF and Atom items, and what configured selectors find in HTML.

Files are read by Spark (whole, as binary), so any store that Spark reads will
do, and each is parsed within its task; a file or page that cannot be read gives
a row that says so, never an error. Selectors are the usual ones: tags, classes,
ids, attributes ([a], [a=v], [a^=v], [a$=v], [a*=v]), descendants, children (>)
and lists (,).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_public_url
from .feeds import categories, feed_date
from .pages import absolute, feeds

RAW = "path string, title string, link string, description string, content string, image string, published string, categories array<string>, problem string"
# Elements without content, and those that the next of their kind closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "h1", "h2", "h3", "h4", "table", "section", "article"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
# Where feeds are looked for if a page names none.
COMMON_PATHS = ["/feed", "/rss", "/rss.xml", "/atom.xml", "/feed.xml", "/feed/rss", "/feed/atom", "/index.xml", "/feeds/posts/default", "/.rss"]


# feeds


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _of(item, *names: str):
    """The first child with one of the local names, in the order of the names; media elements are no plain ones."""
    for name in names:
        for child in item:
            if _local(child.tag) == name and "search.yahoo.com/mrss" not in child.tag:
                return child
    return None


def _text(element) -> str | None:
    if element is None:
        return None
    return "".join(element.itertext()).strip() or None


def snippet(html: str | None) -> str | None:
    """The text of a piece of HTML."""
    if html is None:
        return None
    return unescape(re.sub(r"<[^>]*>", "", html)).strip() or None


def _link(item) -> str | None:
    """An item's link: RSS has it as text, Atom in the first link that is an alternate (or the first)."""
    links = [c for c in item if _local(c.tag) == "link"]
    for c in links:
        if c.get("href") and c.get("rel", "alternate") == "alternate":
            return c.get("href").strip()
    for c in links:
        if _text(c) or c.get("href"):
            return _text(c) or c.get("href").strip()
    return None


def _image(item) -> str | None:
    """An enclosure that is an image, else a media element that says it is one."""
    for c in item:
        kind, url = c.get("type") or "", c.get("url") or c.get("href")
        if (_local(c.tag) == "enclosure" or (_local(c.tag) == "link" and c.get("rel") == "enclosure")) and kind.startswith("image/") and url:
            return url
    for c in item:
        if _local(c.tag) == "content" and "search.yahoo.com/mrss" in c.tag and c.get("medium") == "image" and c.get("url"):
            return c.get("url")
    return None


def _categories(item) -> list[str]:
    return [t for c in item if _local(c.tag) == "category" and (t := c.get("term") or _text(c))]


def feed_items(data: bytes) -> Iterator[dict]:
    """Raw items of a feed document; raises ParseError for what is no XML."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(data)
    for item in root.iter():
        kind = _local(item.tag)
        if kind not in ("item", "entry"):
            continue
        content = _text(_of(item, "description") if kind == "item" else _of(item, "content"))
        yield {
            "title": _text(_of(item, "title")),
            "link": _link(item),
            "description": snippet(content) or snippet(_text(_of(item, "summary"))),
            "content": _text(_of(item, "encoded")) or content,
            "image": _image(item),
            "published": _text(_of(item, "pubdate", "published", "date", "updated")),
            "categories": _categories(item),
        }


def raw_items(files: DataFrame) -> DataFrame:
    """RAW rows of the feeds in files (path, content binary): an item each, or one row with the problem of a file that is no feed."""

    def parse(batches):
        from xml.etree import ElementTree

        import pyarrow as pa

        names = [c.split()[0] for c in RAW.split(", ")]
        types = [pa.list_(pa.string()) if n == "categories" else pa.string() for n in names]
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [{"path": path, **r} for r in feed_items(data or b"")]
                except ElementTree.ParseError as e:
                    rows = [{"path": path, "problem": f"parse_error: {e}"}]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    return files.select("path", "content").mapInArrow(parse, RAW)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """RAW rows of all feed files under a path."""
    return raw_items(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def items(raw: DataFrame) -> DataFrame:
    """(path, title, url, description, content, image, published_at, categories) of items with a title and a link."""
    kept = raw.where("problem is null and title is not null and link is not null")
    return kept.select("path", "title", F.col("link").alias("url"), "description", "content", "image", feed_date(F.col("published")).alias("published_at"), categories(F.col("categories")).alias("categories"))


# pages


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "order")

    def __init__(self, tag: str, attrs: dict, parent: Node | None, order: int = 0):
        self.tag, self.attrs, self.parent, self.children, self.order = tag, attrs, parent, [], order

    def walk(self) -> Iterator[Node]:
        """This node's descendants in the order of the document."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        """Text with single spaces, without scripts and styles."""
        parts: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style"):
                stack.extend(reversed(x.children))
        return " ".join("".join(parts).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.parent is not None and tag in CLOSED_BY.get(self.at.tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def document(html: str, references: tuple[str, ...] | None = None) -> Node:
    """The tree of a page; with `references` only these named ones, closed by a semicolon, stand for a character, others are text as they are."""
    if references is not None:
        html = re.sub(f"&(?!(?:{'|'.join(map(re.escape, references)) or '(?!)'});)", "&amp;", html)
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


PART = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?:\"(?P<q1>[^\"]*)\"|'(?P<q2>[^']*)'|(?P<q3>[^\]\s]+))\s*)?\]")


@lru_cache(maxsize=1024)
def selector(text: str) -> tuple:
    """A list of alternatives, each a tuple of (child of the one before?, tests); ValueError for what is none."""
    out = []
    for one in re.split(r",(?![^\[]*\])", text):
        steps, child = [], False
        for token in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", one):
            if token == ">":
                child = True
                continue
            tests, at = [], 0
            while at < len(token):
                m = PART.match(token, at)
                if not m or (m["tag"] and at):
                    raise ValueError(f"no selector: {text!r}")
                value = m["q1"] if m["q1"] is not None else m["q2"] if m["q2"] is not None else m["q3"]
                tests.append(("tag", m["tag"].lower(), None, None) if m["tag"] else ("class", m["cls"], None, None) if m["cls"] else ("id", m["id"], None, None) if m["id"] else ("attr", m["attr"].lower(), m["op"], value))
                at = m.end()
            steps.append((child, tuple(tests)))
            child = False
        if not steps or child:
            raise ValueError(f"no selector: {text!r}")
        out.append(tuple(steps))
    return tuple(out)


def _holds(node: Node, tests: tuple) -> bool:
    for kind, name, op, value in tests:
        if kind == "tag":
            if name != "*" and node.tag != name:
                return False
        elif kind == "class":
            if name not in node.attrs.get("class", "").split():
                return False
        elif kind == "id":
            if node.attrs.get("id") != name:
                return False
        else:
            have = node.attrs.get(name)
            if have is None:
                return False
            if op and not {"=": have == value, "^=": have.startswith(value), "$=": have.endswith(value), "*=": value in have, "~=": value in have.split()}[op]:
                return False
    return True


def _fits(node: Node, steps: tuple) -> bool:
    child, tests = steps[-1]
    if not _holds(node, tests):
        return False
    if len(steps) == 1:
        return True
    up = node.parent
    while up is not None and up.tag:
        if _fits(up, steps[:-1]):
            return True
        if child:
            return False
        up = up.parent
    return False


def select(root: Node, text: str) -> list[Node]:
    """The nodes that a selector finds, in the order of the document."""
    alternatives = selector(text)
    return [n for n in root.walk() if any(_fits(n, steps) for steps in alternatives)]


FOUND = "page_id long, hrefs array<string>, title string, content string, description string, image string, problem string"


def extracted(pages: DataFrame, references: tuple[str, ...] | None = None) -> DataFrame:
    """FOUND for pages (page_id, html, link_selector, title_selector, content_selector, image_selector), selectors being null where a page's source has none.

    Without a title selector the first h1 is the title, without a content
    selector the article element or the body; without an image, og:image.
    description is what the page's meta element says. A selector that is none
    is the row's problem. `references` as for `document`.
    """

    def find(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in FOUND.split(", ")]
        types = [pa.int64(), pa.list_(pa.string()), *[pa.string()] * 5]

        def first(root, chosen, *others):
            for s in (chosen, *others):
                if s and (found := select(root, s)):
                    return found[0]
                if s and s == chosen:
                    return None
            return None

        def attribute(node, *which):
            return next((node.attrs[a] for a in which if node is not None and node.attrs.get(a)), None)

        for batch in batches:
            rows = []
            for page_id, html, *wanted in zip(*(batch.column(i).to_pylist() for i in range(6))):
                links, title, content, image = wanted
                root, r = document(html or "", references), {"page_id": page_id}
                try:
                    r["hrefs"] = [n.attrs["href"] for n in select(root, links) if n.attrs.get("href")] if links else []
                    t, c = first(root, title, "h1"), first(root, content, "article", "body")
                    r["title"], r["content"] = (x.text() or None if x is not None else None for x in (t, c))
                    r["description"] = attribute(first(root, None, 'meta[name="description"]', 'meta[property="og:description"]'), "content")
                    src = attribute(first(root, image), "src", "data-src") if image else None
                    r["image"] = src or attribute(first(root, None, 'meta[property="og:image"]'), "content")
                except ValueError as e:
                    r = {"page_id": page_id, "problem": str(e)}
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    columns = [F.col(c).cast("string") for c in ("html", "link_selector", "title_selector", "content_selector", "image_selector")]
    return pages.select(F.col("page_id").cast("long"), *columns).mapInArrow(find, FOUND)


def robots_allow(status: Column, allowed: Column) -> Column:
    """What robots rules say of a URL: missing rules allow, rules that could not be fetched forbid, parsed ones tell."""
    return F.when(status == "missing", True).when(status == "error", False).otherwise(F.coalesce(allowed, F.lit(True)))


def article_links(found: DataFrame, pages: DataFrame, robots: DataFrame | None = None, most: int = 30) -> DataFrame:
    """(page_id, url): the first `most` allowed public links of each page, each once, in the order of the page. robots: (host, status, allowed)."""
    each = found.join(pages.select("page_id", F.col("url").alias("base")), "page_id").select("page_id", "base", F.posexplode("hrefs").alias("at", "href"))
    urls = each.select("page_id", absolute(F.col("href"), F.col("base")).alias("url"), "at").where(is_public_url(F.col("url")))
    once = urls.groupBy("page_id", "url").agg(F.min("at").alias("at"))
    if robots is not None:
        host = F.lower(F.regexp_extract("url", "^[A-Za-z]+://(?:[^@/?#]*@)?([^/?#]*)", 1))
        ruled = robots.select("host", robots_allow(F.col("status"), F.col("allowed")).alias("_allowed"))
        once = once.withColumn("host", host).join(ruled, "host", "left").where(F.coalesce("_allowed", F.lit(True))).drop("host", "_allowed")
    kept = F.slice(F.array_sort(F.collect_list(F.struct("at", "url"))), 1, most)
    return once.groupBy("page_id").agg(kept.alias("l")).select("page_id", F.inline("l")).select("page_id", "url")


def feed_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, feed_url, found_by): the feeds that a page's link elements name; of pages that name none, the usual paths on their host."""
    named = feeds(pages).withColumn("found_by", F.lit("html-link"))
    origin = F.regexp_extract("url", "^([A-Za-z]+://[^/?#]+)", 1)
    rest = pages.join(named.select("page_id"), "page_id", "left_anti").where(origin != "")
    guessed = rest.select("page_id", F.explode(F.transform(F.array(*map(F.lit, COMMON_PATHS)), lambda p: F.concat(origin, p))).alias("feed_url"))
    return named.unionByName(guessed.where(is_public_url(F.col("feed_url"))).withColumn("found_by", F.lit("common-path")))
