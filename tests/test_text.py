import pytest
from pyspark.sql import functions as F

from presswork.functions import text as tx
from presswork.operators import entities, verify
from presswork.plans.feeds import FeedParams
from presswork.sources import feeds, pages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url,expected",
    [
        ("https://a.com/x#part", "https://a.com/x"),
        ("https://a.com/x?utm_source=n&b=2&a=1", "https://a.com/x?a=1&b=2"),
        ("https://WWW.A.com/x/", "https://www.a.com/x"),
        ("https://amp.a.com/x", "https://a.com/x"),
        ("https://m.a.com/amp/x", "https://a.com/x"),
        ("https://a.com/x/amp", "https://a.com/x"),
        ("https://a.com/x?a=&B=2", "https://a.com/x?b=2"),
        ("https://a.com/x?UTM_SOURCE=n", "https://a.com/x?utm_source=n"),
        ("https://a.com", "https://a.com/"),
        ("https://a.com:443/x", "https://a.com/x"),
        ("  no url ", "no url"),
        ("https://a.com/x?b=1&b=0", "https://a.com/x?b=1&b=0"),
    ],
)
def test_canonical_urls(spark, url, expected):
    assert one(spark, tx.canonical_url(F.lit(url))) == expected


@pytest.mark.parametrize("url,public", [("https://a.com/x", True), ("http://localhost/x", False), ("http://10.1.2.3/", False), ("http://172.20.0.1", False), ("http://172.32.0.1", True), ("http://[::ffff:127.0.0.1]/", False), ("http://[fd00::1]/", False), ("ftp://a.com", False), ("http://192.168.1.1:80/a", False), ("http://2130706433/", False), ("http://0x7f000001/", False), ("http://0177.0.0.1/", False), ("http://127.1/", False), ("http://0X7F.1.", False), ("http://134744072/", True), ("http://8.8.8.8/", True), ("http://1.2.3.4.5/", False), ("http://256.1.1.1/", False), ("http://10.example/", True), ("http://user@0/", False), ("http://4294967296/", False)])
def test_public_urls(spark, url, public):
    assert one(spark, tx.is_public_url(F.lit(url))) is public


def test_titles_slugs_domains(spark):
    assert one(spark, tx.fingerprint(F.lit("Hello,  World! 2"))) == "hello world 2"
    assert one(spark, tx.fingerprint(tx.unaccented(F.lit("Élan à Zürich")))) == "elan a zurich"
    assert one(spark, tx.source_slug(F.lit(" A & B News "))) == "a-and-b-news"
    assert one(spark, tx.domain(F.lit("https://www.cnn.com:80/news/?x#y"))) == "cnn.com"
    assert tx.like_escaped("5%_\\") == "5\\%\\_\\\\"


@pytest.mark.parametrize("title,topic,region", [("AI beats market", "technology", "us"), ("Paid maids rejoice", "politics", "us"), ("UK bank earnings", "business", "uk"), ("United Nations summit", "world", "international"), ("", "politics", "us")])
def test_classification(spark, title, topic, region):
    assert (one(spark, tx.topic_of(F.lit(title))), one(spark, tx.region_of(F.lit(title)))) == (topic, region)


def test_web_search(spark):
    m = lambda t, q: one(spark, tx.matches(F.lit(t), q))
    assert m("The climate summit opens", 'climate "summit opens"') and not m("Summit of climate opens", '"climate summit"')
    assert m("Oil price", "gas or oil") and not m("Oil price", "oil -price") and m("anything", "")


def test_claims_need_overlap_numbers_and_polarity(spark):
    articles = spark.createDataFrame([(1, "Senate passed the budget bill by 12.5% on Monday. The mayor did not speak.", "left")], "k long, text string, bias string")
    texts = ["Senate passed budget bill Monday", "Senate rejected the budget bill on Monday", "Senate passed budget bill 13.5 percent Monday", "Senate passed budget bill 12.5 percent", "Dogs and cats are friends"]
    claims = spark.createDataFrame([(1, i, t, "both") for i, t in enumerate(texts)], "k long, claim_id int, claim string, side string")
    assert {r.claim_id for r in verify.verified_claims(claims, articles, "k").collect()} == {0, 3}
    right = claims.withColumn("side", F.lit("right"))
    assert verify.verified_claims(right, articles, "k").count() == 0


def test_quotes_stand_at_word_boundaries_of_the_named_outlet(spark):
    articles = spark.createDataFrame([(1, "A costly plan", "We “will act” now", "The Post")], "k long, title string, description string, source string")
    rows = [(1, 0, 'we "will act" now', "the post"), (1, 1, "cost", "The Post"), (1, 2, "costly plan", "{THE POST}"), (1, 3, "costly plan", "Other")]
    quotes = spark.createDataFrame(rows, "k long, quote_id int, quote string, source string")
    assert {r.quote_id for r in verify.verified_quotes(quotes, articles, "k").collect()} == {0, 2}


def test_entities(spark):
    rows = spark.createDataFrame([(1, 1, "The U.S. and NATO meet Angela Merkel in Paris"), (1, 2, "Supreme Court hears Angela Merkel on climate")], "k long, article long, text string")
    found = {(r.label, r.type): r for r in entities.entities(rows, "k").collect()}
    assert ("Angela Merkel", "person") in found and ("Paris", "location") in found and ("NATO", "organization") in found and ("United States", "location") in found
    assert ("Supreme Court", "organization") in found and ("Climate", "topic") in found
    assert found["Angela Merkel", "person"].relevance == 1.0 and found["Paris", "location"].relevance == 0.68


def test_entities_inside_headlines(spark):
    rows = [(1, 1, "Biden Meets NATO Leaders In Washington"), (2, 1, "Supreme Court Blocks New York Rule"), (3, 1, "COP28 And G7 open As Trump Speaks"), (4, 1, "NATO"), (5, 1, "said an aide")]
    found = {}
    for r in entities.entities(spark.createDataFrame(rows, "k long, article long, text string"), "k").collect():
        found.setdefault(r.k, set()).add((r.label, r.type, r.relevance))
    assert found[1] == {("NATO", "organization", 1.0), ("Washington", "location", 1.0)}
    assert found[2] == {("New York", "location", 1.0)}
    assert found[3] == {("COP28", "organization", 1.0), ("G7", "organization", 1.0), ("Trump Speaks", "person", 1.0)}
    assert found[4] == {("NATO", "organization", 1.0)} and 5 not in found


def test_mapped_addresses_and_failures(spark):
    assert [one(spark, tx.is_public_url(F.lit(u))) for u in ("http://[::ffff:7f00:1]/", "http://[::ffff:c0a8:101]/", "http://[::ffff:808:808]/", "http://[::ffff:10.0.0.1]/")] == [False, False, True, False]
    kinds = ["Blocked by robots.txt", "SSRF blocked", "private address", "HTTP 503", "fetch failed", "timeout", None]
    assert [one(spark, feeds.failure_kind(F.lit(k).cast("string"))) for k in kinds] == ["robots_blocked", "ssrf_blocked", "ssrf_blocked", "fetch_error", "extraction_failed", "extraction_failed", "extraction_failed"]
    assert one(spark, tx.embedding_text(F.lit("A"), F.lit("b"))) == "A \u2014 b" and one(spark, tx.embedding_text(F.lit("A"), F.lit(None))) == "A"
    assert one(spark, tx.entity_id(F.lit("http://www.wikidata.org/entity/Q42"))) == "Q42" and one(spark, tx.entity_id(F.lit("x"))) is None


def test_pages(spark):
    html = '<html><head><title>T</title><link rel="alternate" type="application/rss+xml" href="/feed"><link type="text/css" href="/a.css"><meta property="article:published_time" content="2026-01-01T00:00:00Z"></head><body><article><h1>Head <b>line</b></h1><p>One &amp; two</p><script>x()</script><a href="b">x</a></article></body></html>'
    p = spark.createDataFrame([(1, "https://a.com/d/e", html)], "page_id long, url string, html string")
    a = pages.articles(p).first()
    assert (a.title, a.text, a.published_at.year) == ("Head line", "Head line One & two x", 2026)
    assert [r.feed_url for r in pages.feeds(p).collect()] == ["https://a.com/feed"]
    assert {r.url for r in pages.discovered(p).collect()} == {"https://a.com/feed", "https://a.com/a.css", "https://a.com/d/b"}
    robots = spark.createDataFrame([("a.com", False)], "host string, allowed boolean")
    assert pages.discovered(p, robots=robots).count() == 0


def test_feeds_and_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><link>https://a.com/1</link><pubDate>Thu, 01 Jan 2026 10:00:00 GMT</pubDate><category> x </category><category></category></item><item><title>no link</title></item></channel></rss>")
    r = feeds.read_rss(spark, str(tmp_path / "f.xml")).collect()
    assert [(x.title, x.url, x.published_at.hour, x.categories) for x in r] == [("A", "https://a.com/1", 10, ["x"])]
    (tmp_path / "s.csv").write_text('Name,URL,Bias\n"A ""q"", Inc",https://a.com,left\n,https://b.com,left\nC,ftp://c,odd\n')
    good, bad = feeds.read_sources_csv(spark, str(tmp_path / "s.csv"))
    assert [x.name for x in good.collect()] == ['A "q", Inc'] and sorted(len(x.errors) for x in bad.collect()) == [1, 2]
    assert one(spark, feeds.compact_date(F.lit("20240615T120000Z"))).hour == 12 and one(spark, feeds.compact_date(F.lit("x"))) is None
    kinds = ["ETIMEDOUT", "getaddrinfo ENOTFOUND", "Status code 500", "Unexpected close tag", "?"]
    assert [one(spark, feeds.error_kind(F.lit(k))) for k in kinds] == ["timeout", "dns_error", "http_error", "parse_error", "unknown"]
    assert one(spark, feeds.category_topic(F.lit(" Markets "))) == "business" and one(spark, feeds.category_region(F.lit("nowhere"))) is None


def test_parameters_are_validated_before_any_plan():
    for bad in ({"topic": "x"}, {"biases": ["up"]}, {"limit": 0}, {"sort": "old"}):
        with pytest.raises(ValueError):
            FeedParams(**bad)
