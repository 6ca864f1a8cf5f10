import datetime as dt

import pytest
from pyspark.sql import functions as F

from presswork.functions import text as tx
from presswork.functions.basics import instant
from presswork.functions.vectors import cosine
from presswork.operators import cluster, ingest, lookups, ratings, state
from presswork.streaming import events as stream

from .conftest import SMALL


@pytest.mark.parametrize("a,b,expected", [([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], 32 / (14 * 77) ** 0.5)])
def test_cosine(spark, a, b, expected):
    r = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("c")).first().c
    assert r == pytest.approx(expected)


G = {1: [1.0, 0.0], 2: [0.99, 0.14], 3: [0.98, 0.20], 4: [0.0, 1.0], 5: [0.14, 0.99], 6: [-1.0, 0.1]}


@pytest.mark.parametrize("order", [1, -1])
def test_clusters_in_any_order(spark, order):
    rows = spark.createDataFrame(sorted(G.items())[::order], "id long, embedding array<double>")
    assert {r.id: r.component for r in cluster.clustered(rows).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_blocks_give_the_pairs_of_one_block(spark):
    rows = spark.createDataFrame(list(G.items()), "id long, embedding array<double>")
    pairs = lambda n: {(r.a, r.b) for r in cluster.similar_pairs(rows, "id", "embedding", 0.7, n).collect()}
    assert pairs(2) == pairs(100) == {(1, 2), (1, 3), (2, 3), (4, 5)}


def test_members_far_from_the_centroid_leave(spark):
    rows = [(1, 1, [1.0, 0.0], 1.0), (2, 1, [1.0, 0.1], 1.0), (3, 1, [0.9, 0.0], 1.0), (4, 1, [-0.2, 1.0], 1.0), (5, 5, [0.0, 1.0], 1.0)]
    m = spark.createDataFrame(rows, "id long, component long, embedding array<double>, weight double")
    assert {r.id: r.component for r in cluster.validated(m).collect()} == {1: 1, 2: 1, 3: 1, 4: None, 5: 5}


def test_matches_and_merges(spark):
    c = spark.createDataFrame([(7, [1.0, 0.0], 3), (8, [0.9, 0.1], 9), (9, [0.0, 1.0], 1)], "story_id long, centroid array<double>, n_articles long")
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, -1.0])], "id long, embedding array<double>")
    assert [(r.id, r.story_id) for r in cluster.best_matches(a, c).collect()] == [(1, 7)]
    assert {r.story_id: r.target for r in cluster.merged_stories(c).collect()} == {7: 8, 8: 8, 9: 9}


def test_singletons_are_promoted_at_the_third_attempt(spark):
    s = spark.createDataFrame([(1, 0), (2, 2)], "id long, attempts int")
    assert {r.id: r.state for r in cluster.attempts(s).collect()} == {1: "pending", 2: "promoted"}


def test_ingest_order(spark):
    cols = "place long, canonical_url string, url string, source_id string, fingerprint string, published_at timestamp_ntz"
    t = dt.datetime(2026, 1, 1)
    old = spark.createDataFrame([(0, "u0", "r0", "s", "f0", t)], cols)
    new = spark.createDataFrame([(1, "u0", "x", "s", "z", t), (2, "u1", "r1", "s", "f0", t), (3, "u1", "r2", "q", "f0", None), (4, "u1", "r3", "q", "f2", t), (5, "u2", "r4", "q", "f3", t)], cols)
    assert [r.place for r in ingest.ingest(new, old, cap=1).collect()] == [5]
    assert sorted(r.place for r in ingest.ingest(new, old).collect()) == [3, 5]


def test_upserts_purges_and_tags(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, v long, x string")
    new = spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "id long, v long, x string")
    assert {r.id: r.x for r in ingest.upserted(new, rows, ["id"], "v").collect()} == {1: "c", 2: "b", 3: "d"}
    assert {r.id: r.x for r in ingest.inserted(new, rows, "id").collect()} == {1: "a", 2: "b", 3: "d"}
    kept, audit = ingest.purged(rows, new, "id", 1, instant("2024-01-01 00:00:00"), dry_run=False)
    assert [r.id for r in kept.collect()] == [2] and audit.first().sample_ids == [1]
    kept, _ = ingest.purged(rows, new, "id", 1, instant("2024-01-01 00:00:00"))
    assert kept.count() == 2
    cols = "story_id long, slug string, tag_type string, relevance double"
    best, gone = ingest.tags_upserted(spark.createDataFrame([(1, "a", "t", 0.5), (1, "a", "t", 0.7)], cols), spark.createDataFrame([(1, "a", "t", 0.1), (1, "b", "t", 0.1), (2, "b", "t", 0.1)], cols))
    assert best.first().relevance == 0.7 and [(r.story_id, r.slug) for r in gone.collect()] == [(1, "b")]


def test_the_model_sees_only_what_the_cache_misses(spark):
    items = spark.createDataFrame([("f", "t"), ("f", "u"), (None, "t")], "fingerprint string, embedding_text string")
    cache = spark.createDataFrame([("f", "t", [1.0], 1)], "fingerprint string, embedding_text string, embedding array<double>, cached_at long")
    out = ingest.embedded(items, cache, lambda m: m.withColumn("embedding", F.array(F.lit(9.0))))
    assert sorted((r.embedding_text, r.embedding[0]) for r in out.collect()) == [("t", 1.0), ("t", 9.0), ("u", 9.0)]


def test_state_transitions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(state.cooldown_minutes(F.lit(n))) for n in (1, 3, 8, 20)] == [2, 8, 240, 240]
    assert [one(state.backoff_seconds(F.lit(n))) for n in (0, 3, 9)] == [60.0, 480.0, 3600.0] and one(state.backoff_seconds(F.lit(0), F.lit(1.0))) == 75.0
    assert one(state.ema(F.array(F.lit(10.0), F.lit(20.0)))) == pytest.approx(14.0)
    b = lambda m, p: tuple(one(state.recommended_batch(F.lit(m).cast("double"), F.lit(p), 15.0, 10, 100)))
    assert [b(None, 50), b(30.0, 50), b(5.0, 50), b(5.0, 90), b(12.0, 50), b(9.0, 100), b(5.0, 100)] == [(50, "no_history"), (25, "over_budget"), (63, "under_budget"), (100, "at_ceiling"), (50, "under_budget"), (100, "under_budget"), (100, "at_ceiling")]
    rows = spark.createDataFrame([(1, 3, "failed"), (2, 4, "failed")], "id long, version int, state string")
    expected = spark.createDataFrame([(1, 3), (2, 3)], "id long, version int")
    assert {r.id: (r.version, r.state) for r in state.requeued(rows, expected).collect()} == {1: (4, "pending"), 2: (4, "failed")}
    assert tuple(one(state.quota(F.lit(5), F.lit("a"), F.lit("b"), 5))) == (1, True) and tuple(one(state.quota(F.lit(5), F.lit("a"), F.lit("a"), 5))) == (5, False)


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def folder(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(2).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_stream_windows_are_those_of_the_batch(spark, tmp_path):
    batch = stream.windowed(spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    got = run(stream.windowed(stream.read_events(spark, folder(spark, tmp_path)), "1 day"), "w", "complete")
    rows = lambda d: {(r.window_start, r.event_type): r.n for r in d.collect()}
    assert rows(got) == rows(batch)


def test_stream_counts_repeated_views_once(spark, tmp_path):
    e = stream.read_events(spark, folder(spark, tmp_path))
    out = run(stream.deduplicated(e.unionByName(e), ["user_id"], "60 days"), "d", "append").groupBy("event_type").count()
    base = spark.read.parquet(f"{SMALL}/events.parquet")
    want = base.withColumn("m", F.date_trunc("MINUTE", "ts")).groupBy("event_type").agg(F.count_distinct("user_id", "m").alias("n"), F.count_distinct("event_id").alias("all")).collect()
    got = {r.event_type: r["count"] for r in out.collect()}
    assert got == {r.event_type: r.n if r.event_type in ("view", "click") else r["all"] for r in want}


def test_stream_of_sessions_and_sliding_viewers(spark, tmp_path):
    e = stream.read_events(spark, folder(spark, tmp_path))
    base = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    key = lambda d, c: {tuple(r[x] for x in c) for r in d.collect()}
    got = run(stream.sessions(e, late="60 days"), "s", "complete")
    assert key(got, ["user_id", "start", "end", "n"]) == key(stream.sessions(base), ["user_id", "start", "end", "n"])


RATED = [
    # the last entry of a domain counts, whatever the URL around it
    ("mbfc", 1, "https://www.a.example/x", "left", "high"),
    ("mbfc", 2, "A.example:80", "extreme-right", "mostly-factual"),
    ("allsides", 1, "a.example", "center", None),
    ("mbfc", 3, "b.example", "satire", "low"),
    ("allsides", 2, "b.example", "mixed", None),
    ("mbfc", 4, "c.example", "unheard of", "very-low"),
]


def test_ratings_of_providers(spark):
    entries = spark.createDataFrame(RATED, "provider string, position long, url string, bias string, factuality string")
    sources = [(1, "http://a.example/", "left", "low", None), (2, "b.example", "left", "low", False), (3, "c.example", "left", "low", False), (4, "a.example", "left", "low", True), (5, None, "left", "low", True), (6, "", "left", None, None)]
    got = ratings.synced(spark.createDataFrame(sources, "source_id long, url string, bias string, factuality string, bias_override boolean"), entries)
    assert {r.source_id: tuple(r)[1:] for r in got.collect()} == {
        1: ("updated", 2, "right", "high"),  # the middle of center and far-right is 4.5 of 6, half up
        2: ("unmatched", 0, "left", "low"),
        3: ("updated", 1, "left", "very-low"),
        4: ("overridden", 2, "left", "low"),
        5: ("skipped", 0, "left", "low"),
        6: ("skipped", 0, "left", None),
    }
    assert ratings.synced(spark.createDataFrame(sources, "source_id long, url string, bias string, factuality string, bias_override boolean"), entries.limit(0)).where("outcome = 'updated'").count() == 0


def test_events_are_checked_in_the_batch_and_the_stream(spark):
    ok = "3F2504E0-4f89-41d3-9a0c-0305e82c3301"
    rows = [
        (ok, "view", None, None, "web", None),
        (ok, "dwell", 3, "feed", "mobile", None),
        (ok, "dwell", None, "feed", "mobile", "dwell_bucket"),
        (ok, "view", 4, None, "web", "dwell_bucket"),
        ("story-1", "view", None, None, "web", "story_id"),
        (None, "jump", None, None, None, "story_id"),
        (ok, None, None, None, "web", "action"),
        (ok, "share", None, "mail", "web", "referrer_kind"),
        (ok, "share", None, "search", None, "client"),
    ]
    given = spark.createDataFrame(rows, "story_id string, action string, dwell_bucket int, referrer_kind string, client string, want string")
    assert all(r.problem == r.want for r in stream.checked(given).collect())


def test_search_takes_signs_as_they_are(spark):
    rows = spark.createDataFrame([(1, "100% News", "a"), (2, "1000 News", "b"), (3, None, "x_100%"), (4, "under_score", None)], "id long, name string, slug string")
    found = lambda text: {r.id for r in lookups.matching(rows, text, "name", "slug").collect()}
    assert found("100%") == {1, 3} and found("R_S") == {4} and found("") == {1, 2, 3, 4} and found("\\") == set()


def test_embedding_text(spark):
    rows = spark.createDataFrame([("T", "D"), ("T", None), ("T", "")], "t string, d string")
    assert [r[0] for r in rows.select(tx.embedding_text(F.col("t"), F.col("d"))).collect()] == ["T — D", "T", "T"]
