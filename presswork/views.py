"""The news domain as views of the warehouse tables, and the same views as SQL.

Supplier is a source, nation an owner and region its parent, orders are
stories, line items articles, parts tags, customers readers, events engagement.
Stories and articles are rebased on a news clock that ends at AS_OF, so that
they share it with the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .enums import BIASES, FACTUALITY, OWNER_TYPES, OWNERSHIP, REGIONS, TOPICS
from .functions.basics import instant, pick

AS_OF = "2024-01-31 00:00:00"
START = "2024-01-01 00:00:00"
#: What makes the order of articles complete: (story, line) is not unique.
TIES = ["published_at", "tag_id", "source_id", "line", "shipped", "price", "quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(k: Column) -> list[Column]:
    """Bias, factuality and ownership of the source of an id."""
    return [pick(BIASES, k % 7).alias("bias"), pick(FACTUALITY, k % 5).alias("factuality"), pick(OWNERSHIP, k % 8).alias("ownership")]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("source_id"),
        F.col("s_name").alias("name"),
        F.regexp_replace(F.lower("s_name"), "[^a-z0-9]+", "-").alias("slug"),
        *ratings(k),
        pick(REGIONS, k % 5).alias("region"),
        F.when(k % 11 != 0, F.col("s_nationkey")).alias("owner_id"),
        pick(["rss", "crawler", "news_api"], k % 3).alias("source_type"),
        (F.col("s_acctbal") > -500).alias("is_active"),
        (k % 13).cast("int").alias("failures"),
        (k % 37).cast("int").alias("successes"),
    )


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(k.alias("owner_id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"), pick(OWNER_TYPES, k % 8).alias("owner_type"), F.col("n_regionkey").alias("parent_id"))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("story_id"),
        F.concat(F.lit("Story "), k.cast("string")).alias("headline"),
        pick(TOPICS, k % 9).alias("topic"),
        pick(REGIONS, k % 5).alias("region"),
        F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("draft").alias("status"),
        pick(FACTUALITY, 5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("factuality"),
        (instant(START) + F.expr("make_dt_interval(0, cast((o_orderkey * 17) % 720 as int), 0, 0)")).alias("first_published"),
        F.col("o_custkey").alias("reader_id"),
        (k % 100).alias("audience"),
        F.col("o_totalprice").alias("weight"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles up to AS_OF with their source's ratings; the dimension of sources is joined as Spark sees fit."""
    l = table(spark, sf_dir, "lineitem")
    shift = F.expr("make_dt_interval(0, cast((l_orderkey * 17) % 720 + (l_partkey * 5 + l_linenumber * 3) % 96 as int), 0, 0)")
    a = l.select(
        F.col("l_orderkey").alias("story_id"),
        F.col("l_suppkey").alias("source_id"),
        (instant(START) + shift).alias("published_at"),
        F.col("l_partkey").alias("tag_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").alias("shipped"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
    ).where(F.col("published_at") <= instant(AS_OF))
    s = sources(spark, sf_dir).select("source_id", F.col("name").alias("source"), "bias", "factuality", "ownership", "owner_id")
    return a.join(s, "source_id")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("tag_id"), F.col("p_name").alias("label"), pick(["person", "organization", "location", "event", "topic"], k % 5).alias("tag_type"))


def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as engagement with a bucket of stories (`audience`, 0 to 99)."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "view", "view").when(F.col("event_type") == "click", "read_through").when(F.col("event_type") == "purchase", "share").when(F.col("event_type") == "signup", "dwell")
    return e.select("event_id", F.col("ts").alias("created_at"), F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").cast("long").alias("audience"), action.alias("action"), "event_type", "value")


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL = f"""WITH src AS (SELECT s_suppkey AS source_id, s_name AS name, regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') AS slug,
  {_list(BIASES)}[(s_suppkey % 7 + 1)::INT] AS bias, {_list(FACTUALITY)}[(s_suppkey % 5 + 1)::INT] AS factuality, {_list(OWNERSHIP)}[(s_suppkey % 8 + 1)::INT] AS ownership,
  {_list(REGIONS)}[(s_suppkey % 5 + 1)::INT] AS region, CASE WHEN s_suppkey % 11 <> 0 THEN s_nationkey END AS owner_id, ['rss', 'crawler', 'news_api'][(s_suppkey % 3 + 1)::INT] AS source_type,
  s_acctbal > -500 AS is_active, (s_suppkey % 13)::INT AS failures, (s_suppkey % 37)::INT AS successes FROM supplier),
own AS (SELECT n_nationkey AS owner_id, n_name AS name, lower(n_name) AS slug, {_list(OWNER_TYPES)}[(n_nationkey % 8 + 1)::INT] AS owner_type, n_regionkey AS parent_id FROM nation),
sto AS (SELECT o_orderkey AS story_id, 'Story ' || o_orderkey AS headline, {_list(TOPICS)}[(o_orderkey % 9 + 1)::INT] AS topic, {_list(REGIONS)}[(o_orderkey % 5 + 1)::INT] AS region,
  CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'needs_review' ELSE 'draft' END AS status, {_list(FACTUALITY)}[6 - substr(o_orderpriority, 1, 1)::INT] AS factuality,
  TIMESTAMP '{START}' + to_hours(((o_orderkey * 17) % 720)::INT) AS first_published, o_custkey AS reader_id, o_orderkey % 100 AS audience, o_totalprice AS weight FROM orders),
art AS (SELECT l_orderkey AS story_id, a.source_id, a.published_at, tag_id, line, shipped, price, quantity, src.name AS source, bias, factuality, ownership, owner_id FROM
  (SELECT l_orderkey, l_suppkey AS source_id, TIMESTAMP '{START}' + to_hours(((l_orderkey * 17) % 720 + (l_partkey * 5 + l_linenumber * 3) % 96)::INT) AS published_at, l_partkey AS tag_id, l_linenumber AS line,
  l_shipdate AS shipped, l_extendedprice AS price, l_quantity AS quantity FROM lineitem) a JOIN src USING (source_id) WHERE published_at <= TIMESTAMP '{AS_OF}'),
tag AS (SELECT p_partkey AS tag_id, p_name AS label, ['person', 'organization', 'location', 'event', 'topic'][(p_partkey % 5 + 1)::INT] AS tag_type FROM part),
eng AS (SELECT event_id, ts AS created_at, user_id AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS audience, CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'read_through'
  WHEN 'purchase' THEN 'share' WHEN 'signup' THEN 'dwell' END AS action, event_type, value FROM events)
"""
BIAS_SQL, OWNERSHIP_SQL, TOPIC_SQL, FACT_SQL = map(_list, (BIASES, OWNERSHIP, TOPICS, FACTUALITY))
