"""Joins of similar vectors by pivots, and clustering batch after batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.functions.basics import instant
from presswork.operators import cluster


def vectors(seed, n=300, dims=6, groups=8):
    """Groups of like vectors, copies at other lengths, vectors of length zero."""
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(groups, dims))[rnd.integers(0, groups, n)] + rnd.normal(scale=0.4, size=(n, dims))
    x[n // 2 : n // 2 + 40] = 3 * x[7]
    x[-3:] = 0
    return x


def brute(x, t):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    s = u @ u.T
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= t}


def components(pairs, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("threshold,block,pivots", [(0.7, 16, 12), (0.95, 2048, 3), (0.2, 50, 64), (0.7, 64, 1)])
def test_pairs_by_pivots_are_all_pairs(spark, monkeypatch, threshold, block, pivots):
    monkeypatch.setattr(cluster, "PIVOTS", pivots)
    x = vectors(int(threshold * 100))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(None, [1.0] * 6), (999, None)], "id long, embedding array<double>").repartition(3)
    wanted = brute(x, threshold)
    assert {(r.a, r.b) for r in cluster.similar_pairs(rows, "id", "embedding", threshold, block).collect()} == wanted
    links = [(r.a, r.b) for r in cluster.similar_links(rows, "id", "embedding", threshold, block).collect()]
    assert set(links) <= wanted | {(b, a) for a, b in wanted} or threshold < 1  # a forest may join ends of a chain
    assert components(links, len(x)) == components(wanted, len(x))


def test_far_cells_do_not_meet(spark):
    rnd = np.random.default_rng(0)
    middle = np.eye(16)
    x = middle[rnd.integers(0, 16, 800)] + rnd.normal(scale=0.02, size=(800, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "rep long, v array<double>")
    pivots = cluster.pivots_of(nodes, 4096, 64)
    radii = [0.2] * len(pivots)
    met = nodes.mapInArrow(cluster._cells(pivots, (2 - 2 * 0.9) ** 0.5, radii), cluster.CELLS).count()
    assert met < 0.2 * 800 * len(pivots)


def test_empty_and_single_vectors(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    assert cluster.similar_pairs(none, "id", "embedding").count() == 0 and cluster.clustered(none).count() == 0
    one = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "id long, embedding array<double>")
    assert [(r.id, r.component) for r in cluster.clustered(one).orderBy("id").collect()] == [(1, 1), (2, 2)]


NOW = "2024-01-31 00:00:00"


def batch(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, t) for i, v, t in rows], "id long, embedding array<double>, weight double, t string").withColumn("published_at", F.col("t").cast("timestamp_ntz")).drop("t")


def empty_state(spark):
    members = spark.createDataFrame([], "id long, story_id long, embedding array<double>, weight double, published_at timestamp_ntz")
    return members, spark.createDataFrame([], "story_id long, centroid array<double>, last_published timestamp_ntz")


def test_placing_a_batch(spark):
    stories = spark.createDataFrame([(500, [1.0, 0.0, 0.0], "2024-01-30 00:00:00"), (600, [0.0, 0.0, 1.0], "2024-01-01 00:00:00")], "story_id long, centroid array<double>, t string").withColumn("last_published", F.col("t").cast("timestamp_ntz"))
    rows = [(1, [0.9, 0.1, 0.0]), (2, [0.0, 0.1, 1.0]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 1.0, 0.0])]
    found = {r.id: (r.story_id, r.how) for r in cluster.placed(batch(spark, [(i, v, NOW) for i, v in rows]), stories, instant(NOW)).collect()}
    assert found[1] == (500, "matched") and found[4] == (None, "single")
    assert found[2] == found[3] == (2, "created")  # story 600 is too old


def test_a_cluster_joins_the_story_its_centroid_is_near_to(spark):
    stories = spark.createDataFrame([(500, [1.0, 0.0, 0.0])], "story_id long, centroid array<double>").withColumn("last_published", instant(NOW))
    side = (1 - 0.69**2) ** 0.5
    rows = [(1, [0.69, side * 0.6, side * 0.8], NOW), (2, [0.69, side * 0.8, -side * 0.6], NOW), (3, [0.69, side, side * 0.1], NOW)]
    found = {r.id: (r.story_id, r.how) for r in cluster.placed(batch(spark, rows), stories, instant(NOW), 0.699).collect()}
    kept = [i for i in found if found[i][1] != "single"]
    assert len(kept) >= 2 and {found[i] for i in kept} == {(500, "duplicate")}


def test_batches_give_what_one_batch_gives(spark):
    rnd = np.random.default_rng(4)
    middle = np.eye(8)[:5]
    x = middle[rnd.integers(0, 5, 60)] + rnd.normal(scale=0.05, size=(60, 8))
    rows = [(i, [float(c) for c in v], f"2024-01-{20 + i % 10} 00:00:00") for i, v in enumerate(x)]
    step = lambda state, part: cluster.batch_step(batch(spark, part), *state, instant(NOW), hours=1000)
    whole = step(empty_state(spark), rows)
    state = step(empty_state(spark), rows[:35])
    halves = step(state, rows[35:])
    again = step(halves, rows[20:50])  # a batch that comes again
    get = lambda s: {r.id: r.story_id for r in s[0].collect()}
    assert get(whole) == get(halves) == get(again) and len(set(get(whole).values())) == 5
    centroids = lambda s: {r.story_id: [round(c, 9) for c in r.centroid] for r in s[1].collect()}
    assert centroids(whole) == centroids(halves) == centroids(again)


def test_a_centroid_of_one_member_stays(spark):
    stories = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "story_id long, centroid array<double>").withColumn("last_published", instant(NOW))
    members = batch(spark, [(1, [0.5, 0.5], NOW), (2, [0.0, 3.0], NOW), (3, [1.0, 1.0], NOW)]).withColumn("story_id", F.when(F.col("id") == 1, 1).otherwise(2).cast("long"))
    out = {r.story_id: r.centroid for r in cluster.recentred(stories, members).collect()}
    assert out == {1: [1.0, 0.0], 2: [0.5, 2.0]}


def test_cells_meet_once_in_parts_of_bounded_size(spark, monkeypatch):
    """Parts of cells and of their guests give what all pairs give, and a row is a guest of its own cell and later ones only, so vectors are not sent for every pair of blocks."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(120, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "rep long, v array<double>")
    s = x @ x.T
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.6}
    for tile in (7, 65536):
        monkeypatch.setattr(cluster, "TILE", tile)
        got = [(r.a, r.b) for r in cluster.similar_nodes(nodes, 0.6, block=5).collect()]
        assert set(got) == want and len(got) == len(want)
    pivots = x[:8].tolist()
    guests = nodes.mapInArrow(cluster._packed(cluster._cells(pivots, 2.0, [2.0] * 8)), cluster.PACKED).agg({"n": "sum"}).first()[0]
    homes = ((x[:, None] - x[None, :8]) ** 2).sum(axis=2).argmin(axis=1)
    assert guests == (8 - homes).sum()
