"""Feeds of all kinds, selectors, links and feed candidates."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from presswork.sources import markup

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Feed</title>
<item><title> First &amp; best </title><link> https://a.example/1 </link><description><![CDATA[<p>Some <b>bold</b> text &amp; more</p>]]></description><content:encoded><![CDATA[<p>Whole</p>]]></content:encoded>
<pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><category domain="d">Politics</category><category> </category><category>World </category><enclosure url="https://a.example/i.jpg" type="image/jpeg"/><media:content url="https://a.example/no.jpg" medium="image"/></item>
<item><title>Audio</title><link>https://a.example/2</link><enclosure url="https://a.example/s.mp3" type="audio/mpeg"/><media:content url="https://a.example/m.jpg" medium="image"/><media:title>not the title</media:title><pubDate>never</pubDate></item>
<item><title>No link</title></item><item><link>https://a.example/3</link></item></channel></rss>"""
ATOM = """<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title>
<entry><title>One</title><link rel="self" href="https://b.example/self"/><link rel="alternate" href="https://b.example/1"/><summary>Short &lt;i&gt;sum&lt;/i&gt;</summary><updated>2024-01-02T03:04:05Z</updated><category term="Tech"/></entry>
<entry><title>Two</title><link href="https://b.example/2"/><content type="html">&lt;p&gt;Long&lt;/p&gt;</content><published>2024-01-03T00:00:00+02:00</published><updated>2024-01-09T00:00:00Z</updated><link rel="enclosure" type="image/png" href="https://b.example/p.png"/></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><item><title>Old</title><link>https://c.example/1</link><dc:date>2024-02-01T00:00:00Z</dc:date></item></rdf:RDF>"""


def test_feeds_of_all_kinds(spark, tmp_path):
    for name, text in (("r.xml", RSS), ("a.xml", ATOM), ("d.xml", RDF), ("broken.xml", "<rss><item>"), ("none.xml", "<html><body/></html>")):
        (tmp_path / name).write_text(text)
    raw = markup.read_feeds(spark, str(tmp_path))
    got = {r.url: r for r in markup.items(raw).withColumn("at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).collect()}
    assert sorted(got) == ["https://a.example/1", "https://a.example/2", "https://b.example/1", "https://b.example/2", "https://c.example/1"]
    first = got["https://a.example/1"]
    assert (first.title, first.description, first.content, first.image, first.at, first.categories) == ("First & best", "Some bold text & more", "<p>Whole</p>", "https://a.example/i.jpg", "2024-01-01 10:00:00", ["Politics", "World"])
    second = got["https://a.example/2"]
    assert (second.title, second.description, second.image, second.published_at, second.categories) == ("Audio", None, "https://a.example/m.jpg", None, None)
    one, two = got["https://b.example/1"], got["https://b.example/2"]
    assert (one.description, one.at, one.categories) == ("Short sum", "2024-01-02 03:04:05", ["Tech"])
    assert (two.description, two.image, two.at) == ("Long", "https://b.example/p.png", "2024-01-02 22:00:00")
    assert got["https://c.example/1"].published_at == datetime(2024, 2, 1)
    assert sorted(r.path.rsplit("/", 1)[1] for r in raw.where("problem is not null").collect()) == ["broken.xml"]


HTML = """<html><head><meta property="og:image" content="/og.png"><meta name="description" content="About it"></head><body>
<nav class="top main"><ul><li><a href="/one">One<li><a href="two.html">Two</a></ul></nav><div id="list"><h2><a class="t" href="https://x.example/3" data-k="v 1">Three</a></h2><span><h2><a href='//y.example/4'>Four</a></h2></span><a href="http://10.0.0.1/">in</a><a>none</a><a href="/one">again</a></div>
<article><h1>The <b>head</b> &amp; line</h1><p>First<p>Second<script>var p = "<p>";</script><br/>third<img src="" data-src="/lazy.jpg"></article></body></html>"""


@pytest.mark.parametrize(
    "chosen,found",
    [
        ("nav li a", ["/one", "two.html"]),
        (".top.main a, #list a.t", ["/one", "two.html", "https://x.example/3"]),
        ("#list > h2 > a", ["https://x.example/3"]),
        ("#list h2 a", ["https://x.example/3", "//y.example/4"]),
        ("a[href^='/one']", ["/one", "/one"]),
        ('a[data-k~="1"], a[href$=".html"]', ["two.html", "https://x.example/3"]),
        ("a[href*=example]", ["https://x.example/3", "//y.example/4"]),
        ("*[class='t']", ["https://x.example/3"]),
        ("table a", []),
    ],
)
def test_selectors(chosen, found):
    assert [n.attrs["href"] for n in markup.select(markup.document(HTML), chosen)] == found


def test_selectors_that_are_none():
    for bad in ("", "a >", "a..b", "a:hover", "[", "a,,b"):
        with pytest.raises(ValueError):
            markup.selector(bad)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, link_selector string, title_selector string, content_selector string, image_selector string")


def test_extraction_by_selectors_and_without(spark):
    base = "https://www.news.example/section/index.html"
    rows = [(1, base, HTML, "a", None, None, None), (2, base, HTML, None, "h2", "#list > h2", "article img"), (3, base, HTML, None, ".gone", None, ".gone"), (4, base, "<p>a", "a:hover", None, None, None), (5, base, None, "a", None, None, None), (6, base, "", None, None, None, None)]
    df = pages(spark, rows)
    found = markup.extracted(df)
    got = {r.page_id: r for r in found.collect()}
    assert (got[1].title, got[1].content, got[1].description, got[1].image) == ("The head & line", "The head & lineFirstSecondthird", "About it", "/og.png")
    assert (got[2].title, got[2].content, got[2].image, got[2].hrefs) == ("Three", "Three", "/lazy.jpg", [])
    assert (got[3].title, got[3].image) == (None, "/og.png")
    assert "a:hover" in got[4].problem and got[5].hrefs == [] and got[6].title is None
    links = [(r.page_id, r.url) for r in markup.article_links(found, df).collect()]
    assert links == [(1, "https://www.news.example/one"), (1, "https://www.news.example/section/two.html"), (1, "https://x.example/3"), (1, "https://y.example/4")]
    robots = spark.createDataFrame([("www.news.example", "error", True), ("x.example", "missing", False), ("y.example", "parsed", False)], "host string, status string, allowed boolean")
    assert [r.url for r in markup.article_links(found, df, robots).collect()] == ["https://x.example/3"]
    assert [r.url for r in markup.article_links(found, df, most=1).collect()] == ["https://www.news.example/one"]


def test_feed_candidates(spark):
    link = '<link rel="alternate" type="application/rss+xml" href="/f.xml"><link type="text/css" href="/c.css">'
    df = spark.createDataFrame([(1, "https://a.example/x", link), (2, "https://b.example", "<p>"), (3, "http://127.1/x", ""), (4, "nowhere", "")], "page_id long, url string, html string")
    got = {(r.page_id, r.feed_url, r.found_by) for r in markup.feed_candidates(df).collect()}
    assert got == {(1, "https://a.example/f.xml", "html-link")} | {(2, f"https://b.example{p}", "common-path") for p in markup.COMMON_PATHS}


def test_selected_texts_keeps_unclosed_and_other_references_as_its_sql_does(spark, tmp_path):
    import duckdb

    from presswork import plans, registry  # noqa: F401

    from .conftest import same_rows

    rows = [(1, "<article><h1>One&amp;&amp</h1></article><div class=\"ad\">a &quot;b&quot; &amp;lt; &#39;</div>"), (2, "<article><h1>&lt;Two</h1></article><div class=\"ad\">&amp</div>"), (3, "<article><h1></h1></article>")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(registry.QUERIES["selected_texts"](spark, str(tmp_path)), con, registry.ORACLES["selected_texts"])
    assert markup.document("<p>&amp;&lt;&ltx", ()).text() == "&amp;&lt;&ltx" and markup.document("<p>&amp;&lt;").text() == "&<"
