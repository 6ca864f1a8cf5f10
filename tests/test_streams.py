"""Keyed state with timers and refreshed scores against batches; late, shuffled and repeated input."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from presswork.streaming import stateful, trending

START = datetime(2024, 1, 1)


def stream_of(spark, tmp_path, rows, schema, n_files):
    """Rows (with `ts` as minutes) as a stream of files, in the order given; a last event far ahead moves the watermark past all."""
    folder = str(tmp_path / "in")
    rows = [(START + timedelta(minutes=m), *r) for m, *r in rows]
    size = -(-len(rows) // n_files)
    for a in range(0, len(rows), size):
        spark.createDataFrame(rows[a : a + size], "ts timestamp, " + schema).coalesce(1).write.mode("append").parquet(folder)
    kind = spark.read.parquet(folder).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)


def collected(spark, tmp_path, stream, name):
    stateful.ready(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return [tuple(r) for r in spark.table(name).collect()]


def shuffled(rnd, rows, minutes):
    """Rows in an order in which none comes more than so many minutes after a later one."""
    return sorted(rows, key=lambda r: r[0] + rnd.uniform(0, minutes))


CLOSE = 10**7


def test_source_health_is_that_of_the_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows, event = [], 0
    for source in range(5):
        at = 0
        for _ in range(40):
            at += rnd.choice([1, 2, 3, 10, 30, 300])
            rows.append((at, source, event, rnd.random() < (0.95 if source == 0 else 0.6)))
            event += 1
    given = [*shuffled(rnd, rows, 50), (CLOSE, 99, -1, False)]
    stream = stream_of(spark, tmp_path, given, "source_id long, event_id long, failed boolean", 4)
    got = collected(spark, tmp_path, stateful.source_health(stream), "health")
    batch = spark.createDataFrame([(START + timedelta(minutes=m), *r) for m, *r in rows], "ts timestamp, source_id long, event_id long, failed boolean")
    wanted = [tuple(r) for r in stateful.health_after(batch).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((r for r in got if r[0] != 99), key=key) == sorted(wanted, key=key)
    assert any(r[5] for r in wanted) and any(r[7] == "eligible" for r in wanted)


def test_retries_fall_due_and_end(spark, tmp_path):
    rows = [(0, 1, 0, False), (5, 1, 1, False), (9, 1, 2, True), (10, 1, 3, False), (0, 2, 4, False), (1, 2, 5, False), (2, 2, 6, False), (30, 3, 7, True)]
    given = [rows[5], rows[1], rows[0], rows[6], rows[4], rows[2], rows[7], rows[3], (CLOSE, 99, -1, True)]
    stream = stream_of(spark, tmp_path, given, "id long, event_id long, ok boolean", 3)
    got = collected(spark, tmp_path, stateful.retried(stream, "assemble"), "items")
    minute = lambda ms: None if ms is None else round((ms / 1000 - START.replace().timestamp()) / 60, 3)
    seen = sorted((i, minute(ms), event, n, state, minute(after)) for i, ms, event, n, state, after in got if i != 99 and event is not None)
    due = sorted((i, minute(ms), n) for i, ms, event, n, state, after in got if state == "due")
    assert seen == [(1, 0, 0, 1, "retry", 2), (1, 5, 1, 2, "retry", 9), (1, 9, 2, 2, "done", None), (2, 0, 4, 1, "retry", 2), (2, 1, 5, 2, "retry", 5), (2, 2, 6, 3, "dead_letter", None), (3, 30, 7, 0, "done", None)]
    assert due == [(1, 2, 1), (1, 9, 2)]  # what is due comes before the event of the same instant; the dead letter waits for nothing


def test_leases_end_by_themselves(spark, tmp_path):
    rows = [(0, 1, 0, "claim", "a"), (10, 1, 1, "claim", "b"), (29, 1, 2, "claim", "a"), (59, 1, 3, "claim", "b"), (60, 1, 4, "release", "a"), (70, 1, 5, "release", "b"), (71, 1, 6, "claim", "a")]
    given = [rows[2], rows[0], rows[1], rows[4], rows[3], rows[6], rows[5], (CLOSE, 99, -1, "claim", "z")]
    stream = stream_of(spark, tmp_path, given, "id long, event_id long, action string, owner string", 3)
    got = collected(spark, tmp_path, stateful.leased(stream, 30), "leases")
    base = START.timestamp() * 1000
    told = sorted(((ms - base) / 60_000, owner, what) for i, ms, _, owner, what in got if i == 1)
    assert told == [(0, "a", "granted"), (10, "b", "refused"), (29, "a", "granted"), (59, "a", "expired"), (59, "b", "granted"), (60, "a", "not_held"), (70, "b", "released"), (71, "a", "granted"), (101, "a", "expired")]


STORIES = "story_id long, impact_score int, articles_24h long, factor double, first_published timestamp"


def views(seed, n=400):
    rnd = random.Random(seed)
    return [(rnd.uniform(0, 1500), rnd.randint(1, 6), rnd.randint(1, 30), rnd.choice(["view", "read_through", "dwell", "share"])) for _ in range(n)]


def plain_scores(rows, as_of, stories):
    import math

    out = {}
    for i, impact, n24, factor, published in stories:
        seen = {s for m, story, s, a in rows if story == i and a in ("view", "read_through") and as_of - 360 <= m <= as_of}
        age = max((as_of - published) / 60, 0)
        score = 0.0 if impact <= 0 else impact * (1 + math.log10(max(n24, 1))) * factor * (age + 2) ** -1.5 * (1 + math.log10(1 + len(seen)))
        out[i] = (len(seen), None if age > 168 else score)
    return out


STATIC = [(1, 50, 3, 0.9, 0), (2, 80, 0, 0.5, -60), (3, 0, 5, 0.7, 0), (4, 60, 10, 1.0, -168 * 60 + 600), (5, 70, 2, 0.6, 1490), (7, 10, 1, 0.5, -20_000)]


def static(spark):
    return spark.createDataFrame([(i, a, b, c, START + timedelta(minutes=m)) for i, a, b, c, m in STATIC], STORIES)


def same_scores(spark, folder, batch_id, wanted):
    got = {r.story_id: (r.viewers, r.score) for r in trending.latest_scores(spark, folder, batch_id).collect()}
    assert got.keys() == wanted.keys()
    for i, (n, score) in wanted.items():
        assert got[i][0] == n and (got[i][1] is None) == (score is None) and (score is None or got[i][1] == pytest.approx(score))


def frame(spark, rows):
    return spark.createDataFrame([(START + timedelta(microseconds=round(m * 6e7)), *r) for m, *r in rows], "ts timestamp, story_id long, session_id long, action string")


def test_scores_over_several_batches_and_a_repeated_one(spark, tmp_path):
    rows = sorted(views(3))
    rows = [(round(m * 6e7) / 6e7, *r) for m, *r in rows]
    parts = [rows[:150], [], rows[150:260] + rows[5:20], rows[260:]]  # some come again, late
    write = trending.refresh(static, str(tmp_path))
    done = []
    for n, part in enumerate(parts):
        write(frame(spark, part), n)
        done += part
        wanted = plain_scores(done, max(r[0] for r in done), STATIC)
        same_scores(spark, str(tmp_path), n, wanted)
        if n == 2:  # the batch is run again
            write(frame(spark, part), n)
            same_scores(spark, str(tmp_path), n, wanted)
    # a story that grew too old has lost the score it had
    first = {r.story_id: r.score for r in trending.latest_scores(spark, str(tmp_path), 0).collect()}
    last = {r.story_id: r.score for r in trending.latest_scores(spark, str(tmp_path), 3).collect()}
    assert first[4] is not None and last[4] is None


def test_refreshing_a_stream(spark, tmp_path):
    rows = [(round(m * 6e7) / 6e7, *r) for m, *r in views(4, 200)]
    for a in range(0, 200, 70):
        frame(spark, rows[a : a + 70]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "out")
    q = trending.refreshed(stream, static, folder, str(tmp_path / "cp"))
    q.awaitTermination()
    same_scores(spark, folder, 2, plain_scores(rows, max(r[0] for r in rows), STATIC))


def test_no_views_and_no_events(spark, tmp_path):
    write = trending.refresh(static, str(tmp_path))
    write(frame(spark, []), 0)
    write(frame(spark, [(5.0, 1, 1, "share")]), 1)
    same_scores(spark, str(tmp_path), 1, plain_scores([], 5.0, STATIC))
