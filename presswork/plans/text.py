"""Queries over texts: URLs, fingerprints, classification, search, entities, claims, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..enums import REGION_KEYWORDS, TOPIC_KEYWORDS
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import cluster, entities, textindex, verify
from ..registry import query
from ..views import BIAS_SQL


def keyword_sql(text: str, groups: dict, default: str, boundaries: bool) -> str:
    cases = []
    for name, words in groups.items():
        quoted = [w.replace(".", "\\.") for w in words]
        each = [w if " " in w or not boundaries else f"\\b{w}\\b" for w in quoted]
        cases.append(f"WHEN regexp_matches({text}, '{'|'.join(each)}') THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE '{default}' END"


_TITLE = "coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '')"


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?', ['proto', 'host', 'path', 'q']) AS u FROM pages),
h AS (SELECT page_id, u.proto AS proto, regexp_replace(lower(u.host), '^(amp\\.|mobile\\.|m\\.)', '') AS host, CASE WHEN u.path = '' THEN '/' ELSE u.path END AS path, string_split(substr(u.q, 2), '&') AS q FROM p),
k AS (SELECT *, list_filter(q, lambda x: x LIKE '%=_%' AND NOT regexp_matches(x, '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid|mc_cid|mc_eid)=')) AS kept FROM h)
SELECT page_id, proto || '://' || host || CASE WHEN path <> '/' AND len(kept) = 0 THEN regexp_replace(path, '/$', '') ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS url FROM k"""
)
def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


@query(
    "SELECT page_id, regexp_replace(regexp_replace(split_part(split_part(split_part(regexp_replace(lower(trim(url)), '^https?://', ''), '/', 1), '?', 1), '#', 1), '^www\\.', ''), ':[0-9]+', '') AS domain FROM pages"
)
def page_domains(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "pages").select("page_id", tx.domain(F.col("url")).alias("domain"))


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace(lower({_TITLE}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS fingerprint FROM pages")
def title_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.pages import title

    return views.table(spark, sf, "pages").select("page_id", tx.fingerprint(title(F.col("html"))).alias("fingerprint"))


@query(f"SELECT page_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(trim({_TITLE})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100), '-+$', '') AS slug FROM pages")
def title_slugs(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.pages import title

    return views.table(spark, sf, "pages").select("page_id", tx.slug(title(F.col("html"))).alias("slug"))


@query("SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1), lambda x: x <> ''))) AS n_links FROM pages")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.pages import links

    return views.table(spark, sf, "pages").select("page_id", F.size(F.filter(links(F.col("html")), lambda x: x.startswith("/"))).cast("long").alias("n_links"))


@query("SELECT page_id, regexp_matches(url, '^https?://') AND regexp_extract(url, '^[a-z]+://([^:/?#]*)', 1) NOT IN ('localhost') AS is_public FROM pages")
def public_urls(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "pages").select("page_id", tx.is_public_url(F.col("url")).alias("is_public"))


_NUMBER = "(page_id * 2654435761 % 4294967296)"
_PRIVATE = " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in [(0, 2**24 - 1), (10 * 2**24, 11 * 2**24 - 1), (127 * 2**24, 128 * 2**24 - 1), (169 * 2**24 + 254 * 2**16, 169 * 2**24 + 255 * 2**16 - 1), (172 * 2**24 + 16 * 2**16, 172 * 2**24 + 32 * 2**16 - 1), (192 * 2**24 + 168 * 2**16, 192 * 2**24 + 169 * 2**16 - 1), (100 * 2**24 + 64 * 2**16, 100 * 2**24 + 128 * 2**16 - 1)])


@query(f"SELECT page_id, CASE WHEN page_id % 5 = 4 THEN n % 16777216 + 2130706432 ELSE n END AS address, NOT (page_id % 5 = 4 OR {_PRIVATE}) AS is_public FROM (SELECT page_id, {_NUMBER} AS n FROM pages)")
def numeric_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts given as one number, its parts in hexadecimal or octal, or short, one in five of them local: as an address by page."""
    k, n = F.col("page_id"), F.expr(_NUMBER)
    n = F.when(k % 5 == 4, n % 16777216 + 2130706432).otherwise(n)
    octets = [F.shiftright(n, b) % 256 for b in (24, 16, 8, 0)]
    hexed = F.concat_ws(".", *[F.concat(F.lit("0X"), F.conv(o.cast("string"), 10, 16)) for o in octets])
    octal = F.concat_ws(".", *[F.concat(F.lit("0"), F.conv(o.cast("string"), 10, 8)) for o in octets])
    short = F.concat_ws(".", octets[0].cast("string"), (n % 16777216).cast("string"))
    host = F.when(k % 4 == 0, n.cast("string")).when(k % 4 == 1, hexed).when(k % 4 == 2, octal).otherwise(short)
    return views.table(spark, sf, "pages").select("page_id", n.alias("address"), tx.is_public_url(F.concat(F.lit("http://"), host, F.lit("/x"))).alias("is_public"))


_SAMPLE = "CASE doc_id % 12 WHEN 0 THEN 'NASA research on space' WHEN 1 THEN 'Bank of England and inflation' WHEN 2 THEN 'Films at a festival in Toronto' WHEN 3 THEN 'Paid maids in Spain' WHEN 4 THEN 'Wildfire and storm in Europe' WHEN 5 THEN 'The summit of the G20' WHEN 6 THEN 'AI chip makers' WHEN 7 THEN 'A vaccine for the UK now' ELSE '' END || ' ' || text"


def sample_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a lead of real words before their own."""
    return views.table(spark, sf, "documents").where("text is not null").select("doc_id", F.expr(_SAMPLE).alias("title"))


@query(f"SELECT doc_id, {keyword_sql('lower(t)', TOPIC_KEYWORDS, 'politics', True)} AS topic, {keyword_sql(chr(39) + ' ' + chr(39) + ' || lower(t) || ' + chr(39) + ' ' + chr(39), REGION_KEYWORDS, 'us', False)} AS region FROM (SELECT doc_id, {_SAMPLE} AS t FROM documents)")
def topics_and_regions(spark: SparkSession, sf: str) -> DataFrame:
    return sample_titles(spark, sf).select("doc_id", tx.topic_of(F.col("title")).alias("topic"), tx.region_of(F.col("title")).alias("region"))


@query(
    """WITH t AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), ' ') || ' ' AS p FROM documents)
SELECT doc_id FROM t WHERE (contains(p, ' the ') OR contains(p, ' der die ')) AND NOT contains(p, ' thand ') AND contains(p, ' of ')"""
)
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    """A web search with a phrase, an alternative and an exclusion, on postings of whole texts with words as they are."""
    index = textindex.postings(views.table(spark, sf, "documents"), "doc_id", ["text"], english=False)
    return textindex.search(index, 'the or "der die" -thand of', english=False).select(F.col("id").alias("doc_id"))


@query(
    """WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM documents), n AS (SELECT term, doc_id, count(*) AS n FROM w GROUP BY ALL)
SELECT term, count(*) AS n_docs, sum(n)::BIGINT AS n_positions FROM n GROUP BY term HAVING count(*) >= 5"""
)
def index_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of five documents or more in the index of all texts."""
    index = textindex.postings(views.table(spark, sf, "documents"), "doc_id", ["text"], english=False)
    g = index.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_positions"))
    return g.where("n_docs >= 5")


@query(
    """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s) AS n_sentences, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) AS n_words FROM s JOIN documents USING (doc_id)"""
)
def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "documents").where("text is not null")
    words = F.filter(F.split(F.trim("text"), "\\s+"), lambda w: w != "")
    return d.select("doc_id", F.size(verify.sentences(F.col("text"))).cast("long").alias("n_sentences"), F.size(words).cast("long").alias("n_words"))


@query()
def entity_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample_titles(spark, sf).select((F.col("doc_id") % 100).alias("story_id"), F.col("doc_id").alias("article"), F.col("title").alias("text"))
    return entities.entities(rows, "story_id")


# vectors


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4")
def similar_articles(spark: SparkSession, sf: str) -> DataFrame:
    p = cluster.similar_pairs(views.table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4)
    return p.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    """WITH RECURSIVE e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node) SELECT node AS vec_id, min(root) AS component FROM r GROUP BY node"""
)
def article_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.clustered(views.table(spark, sf, "embeddings"), 0.4, "vec_id", "embedding")


_CENTROIDS = "x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)"


def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.coverage import weighted_centroid

    e = views.table(spark, sf, "embeddings").withColumn("w", F.lit(1.0))
    return weighted_centroid(e, "label", "embedding", "w").select(F.col("label").cast("long").alias("story_id"), "centroid")


@query(f"WITH {_CENTROIDS}, s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], c) AS s FROM embeddings CROSS JOIN (SELECT label, c FROM c)) SELECT vec_id, label, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM s WHERE s >= 0.1) WHERE k = 1".replace("SELECT vec_id, label, list_cosine", "SELECT vec_id, c.label, list_cosine").replace("(SELECT label, c FROM c))", "c)"))
def story_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector's best centroid at or over 0.1."""
    a = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    b = cluster.best_matches(a, label_centroids(spark, sf), 0.1)
    return b.select(F.col("id").alias("vec_id"), F.col("story_id").cast("int").alias("label"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_CENTROIDS} SELECT vec_id, e.label FROM embeddings e JOIN c USING (label) WHERE list_cosine_similarity(embedding::DOUBLE[], c) < 0.05")
def drifted_articles(spark: SparkSession, sf: str) -> DataFrame:
    a = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("story_id"), "embedding")
    return cluster.detached(a, label_centroids(spark, sf), 0.05).select(F.col("id").alias("vec_id"), F.col("story_id").cast("int").alias("label"))


@query(
    f"""WITH RECURSIVE {_CENTROIDS}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), e AS (SELECT a.label AS x, b.label AS y FROM c a JOIN c b ON a.label <> b.label WHERE list_cosine_similarity(a.c, b.c) >= 0.1),
r AS (SELECT label AS node, label AS root FROM c UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node), g AS (SELECT node, min(root) AS g FROM r GROUP BY node)
SELECT node AS label, first_value(node) OVER (PARTITION BY g ORDER BY n DESC, node) AS target FROM g JOIN n ON n.label = g.node"""
)
def merged_stories(spark: SparkSession, sf: str) -> DataFrame:
    n = views.table(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("story_id")).agg(F.count(F.lit(1)).alias("n_articles"))
    m = cluster.merged_stories(label_centroids(spark, sf).join(n, "story_id"), 0.1)
    return m.select(F.col("story_id").cast("int").alias("label"), F.col("target").cast("int").alias("target"))


_SIM = lambda a, b: f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def _means(rows: str, key: str) -> str:
    return f"(SELECT {key}, list(m ORDER BY i) AS c FROM (SELECT {key}, i, avg(x) AS m FROM (SELECT {key}, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM {rows}) GROUP BY ALL) GROUP BY {key})"


@query(
    f"""WITH RECURSIVE {_CENTROIDS}, rc AS (SELECT label::BIGINT AS story_id, c FROM c WHERE label < 4),
ms AS (SELECT vec_id, story_id FROM (SELECT vec_id, story_id, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, story_id) AS k FROM (SELECT vec_id, story_id, {_SIM('embedding', 'c')} AS s FROM embeddings CROSS JOIN rc) WHERE s >= 0.35) WHERE k = 1),
re AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM ms)),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM re a JOIN re b ON a.vec_id <> b.vec_id WHERE {_SIM('a.embedding', 'b.embedding')} >= 0.35),
r AS (SELECT vec_id AS node, vec_id AS root FROM re UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
g AS (SELECT node AS vec_id, min(root) AS g FROM r GROUP BY node),
gm AS (SELECT vec_id, g, embedding, count(*) OVER (PARTITION BY g) AS n FROM g JOIN re USING (vec_id)),
k AS (SELECT vec_id, g, embedding FROM gm JOIN {_means('gm', 'g')} m USING (g) WHERE n > 1 AND {_SIM('embedding', 'm.c')} >= 0.35),
k2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM k) WHERE n > 1),
du AS (SELECT g, story_id FROM (SELECT g, story_id, row_number() OVER (PARTITION BY g ORDER BY s DESC, story_id) AS k FROM (SELECT g, story_id, {_SIM('m.c', 'rc.c')} AS s FROM {_means('k2', 'g')} m CROSS JOIN rc) WHERE s >= 0.35) WHERE k = 1),
nw AS (SELECT g, min(vec_id) + 1000000 AS new_id FROM k2 GROUP BY g)
SELECT vec_id, story_id, 'matched' AS how FROM ms UNION ALL
SELECT re.vec_id, coalesce(du.story_id, nw.new_id) AS story_id, CASE WHEN k2.g IS NULL THEN 'single' WHEN du.g IS NOT NULL THEN 'duplicate' ELSE 'created' END AS how FROM re LEFT JOIN k2 USING (vec_id) LEFT JOIN du ON du.g = k2.g LEFT JOIN nw ON nw.g = k2.g"""
)
def placed_articles(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors as a batch against five stories, one of them too old to take articles."""
    age = F.when(F.col("story_id") < 4, 24).otherwise(200)
    as_of = F.lit(views.AS_OF).cast("timestamp_ntz")
    stories = label_centroids(spark, sf).where("story_id < 5").withColumn("last_published", as_of - F.make_dt_interval(F.lit(0), age))
    batch = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit(1.0).alias("weight"))
    out = cluster.placed(batch, stories, as_of, 0.35, new_id=lambda i: i + 1_000_000)
    return out.select(F.col("id").alias("vec_id"), "story_id", "how")
