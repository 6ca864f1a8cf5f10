"""Grouping of articles by similarity of their vectors.

Similar pairs come from an exact join by pivots: equal vectors are one node,
nodes are put into the cells of their nearest pivots, and a node meets only the
cells that the triangle inequality leaves. Rows are packed where they are read;
a part of a cell and a part of its guests meet in small matrix products in
Arrow, so no row pair below the threshold is ever emitted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import hours_between
from ..functions.vectors import cosine
from . import coverage
from .lineage import shared_checkpoint

THRESHOLD, SPLIT = 0.70, 0.60
BLOCK = 2048
#: parts that articles are dealt over where they meet a block of centroids
SALTS = 16


def _unit(vector: str):
    """A vector as doubles of length one; a zero vector stays."""
    x = F.transform(vector, lambda v: v.cast("double"))
    return x, lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v))


def distinct_vectors(rows: DataFrame, id_: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(rep, v) for each different direction, and (rep, id) for every row: equal vectors are one node from here on."""
    x, norm = _unit(vector)
    given = rows.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), x.alias("x")).withColumn("n", norm(F.col("x")))
    unit = given.select("id", F.transform("x", lambda v: F.when(F.col("n") > 0, v / F.col("n")).otherwise(0.0)).alias("v"))
    named = unit.groupBy("v").agg(F.min("id").alias("rep"))
    return named.select("rep", "v"), unit.join(named, "v").select("rep", "id")


def pivots_of(nodes: DataFrame, sample: int, most: int) -> list:
    """At most `most` pivots from a bounded sample of the nodes, each the farthest from those before it; k rows on the driver."""
    import numpy as np

    rows = nodes.orderBy(F.xxhash64("rep")).limit(sample).collect()
    if not rows:
        return []
    x = np.array([r.v for r in rows], float).reshape(len(rows), -1)
    k = min(most, max(1, int(len(x) ** 0.5)))
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < k and far.max() > 0:
        i = int(far.argmax())
        chosen.append(i)
        far = np.minimum(far, ((x - x[i]) ** 2).sum(axis=1))
    return x[chosen].tolist()


#: rows that pivots are chosen from, and how many there are at most; both bound what the driver and the tasks hold, not what is joined
SAMPLE, PIVOTS = 4096, 64
CELLS = "cell int, far double, id long, v array<double>, home int"
PACKED = "cell int, far double, n long, ids binary, data binary, foreign binary"
#: rows of a cell, or guests of it, that one task holds at a time
TILE = 65536


def _cells(pivots: list, reach: float, radii: list | None):
    """Batches of (rep, v) -> their cells with the distance to its pivot, and the nearest pivot as `home`: that one's cell; with radii every one from there on that a row within `reach` may be in, as two cells need to meet only once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        p = np.array(pivots)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T, 0))
            home = d.argmin(axis=1)
            if radii is None:
                i, j = np.arange(len(ids)), home
            else:  # triangle: a row of the cell is at most its radius from the pivot
                i, j = np.nonzero((d <= np.array(radii) + reach) & (home[:, None] <= np.arange(len(p))))
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(d[i, j]), pa.array(ids[i]), batch.column(1).take(pa.array(i)), pa.array(home[i].astype(np.int32))], names=["cell", "far", "id", "v", "home"])

    return run


def _packed(cells):
    """The rows of _cells with those of a batch and a cell as one, by their greatest distance; `foreign` tells guests from the cell's own."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rows in cells(batches):
            cell, far, ids, home = (rows.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 4))
            x = rows.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for j in np.unique(cell):
                i = np.flatnonzero(cell == j)
                packed_ = [ids[i].astype(np.int64), x[i].astype(float), (home[i] != j).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([far[i].max()]), pa.array([len(i)], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in packed_]], names=["cell", "far", "n", "ids", "data", "foreign"])

    return run


def _forest(i, j, n: int):
    """For pairs of places of n rows a smallest set of pairs that connects the same rows: each row with the first of its component."""
    import numpy as np

    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            at = np.flatnonzero(root != np.arange(n))
            return root[at], at


def similar_nodes(nodes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, links_only: bool = False) -> DataFrame:
    """(a, b, similarity): pairs a < b of nodes (rep, v of length one) with a cosine of at least the threshold, by pivots.

    Each node lies in the cell of its nearest pivot. As a cosine of t is a
    distance of sqrt(2 - 2t), a node meets only cells whose pivot is no farther
    than that and the cell's radius; others are never joined. Rows are packed
    where they are read and sent once for each part of a cell that they meet,
    so what is shuffled grows with the nodes until a cell has more than TILE;
    a part with its guests is many small matrix products. With
    links_only a product's pairs are reduced to a forest that connects the same
    nodes, so a dense group emits rows, not pairs.
    """
    spark = nodes.sparkSession
    nodes = shared_checkpoint(nodes)
    chosen = pivots_of(nodes, SAMPLE, PIVOTS)
    if not chosen:
        return spark.createDataFrame([], "a long, b long, similarity double")
    reach = max(0.0, 2 - 2 * threshold) ** 0.5 + 1e-6
    own = shared_checkpoint(nodes.select("rep", "v").mapInArrow(_packed(_cells(chosen, reach, None)), PACKED))
    radii, parts = [-9.0] * len(chosen), [1] * len(chosen)  # of at most PIVOTS cells
    total = 0
    for r in own.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("radius")).collect():
        radii[r.cell], parts[r.cell] = r.radius + 1e-6, -(-r.n // TILE)
        total += r.n
    deals = -(-total // TILE)  # no cell has more guests than there are nodes
    guests = nodes.select("rep", "v").mapInArrow(_packed(_cells(chosen, reach, radii)), PACKED)
    # packed rows of a cell are dealt over parts, its guests over parts too; each goes to every part of the other side
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1).cast("array<long>"))
    of_cell = F.get(F.array(*[F.lit(n) for n in parts]), F.col("cell")).cast("long")
    left = guests.withColumns({"g": F.pmod(F.xxhash64("ids"), F.lit(deals)), "o": every(of_cell)}).select("cell", "g", "o", "ids", "data", "foreign")
    right = own.withColumns({"o": F.pmod(F.xxhash64("ids"), of_cell), "g": every(F.lit(deals))}).select("cell", "g", "o", "ids", "data")

    def multiply(l_table, r_table):
        import numpy as np
        import pyarrow as pa

        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        if not l_table.num_rows or not r_table.num_rows:
            return empty
        joined = lambda t, c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        a, foreign, b = joined(l_table, "ids", np.int64), joined(l_table, "foreign", np.uint8) > 0, joined(r_table, "ids", np.int64)
        x, y = joined(l_table, "data", float).reshape(len(a), -1), joined(r_table, "data", float).reshape(len(b), -1)
        found = []
        for l in range(0, len(a), block):
            for r in range(0, len(b), block):
                s = x[l : l + block] @ y[r : r + block].T
                i, j = np.nonzero(s >= threshold)
                u, v = a[l + i], b[r + j]
                keep = foreign[l + i] | (u < v)  # rows of one cell meet twice
                i, j, u, v = i[keep], j[keep], u[keep], v[keep]
                u, v = np.minimum(u, v), np.maximum(u, v)
                if links_only and len(u):
                    all_, place = np.unique(np.concatenate([u, v]), return_inverse=True)
                    first, at = _forest(place[: len(u)], place[len(u) :], len(all_))
                    found.append((all_[first], all_[at], np.full(len(first), float(threshold))))
                elif len(u):
                    found.append((u, v, s[i, j]))
        return pa.table(dict(zip(("a", "b", "similarity"), map(np.concatenate, zip(*found))))) if found else empty

    keys = ("cell", "g", "o")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiply, "a long, b long, similarity double")


def similar_pairs(rows: DataFrame, id_: str, vector: str, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity): all pairs of rows with a < b and a cosine of at least the threshold. Where groups of equal vectors are large, ask for `similar_links`."""
    nodes, members = distinct_vectors(rows, id_, vector)
    members = shared_checkpoint(members)
    between = similar_nodes(nodes, threshold, block)
    x, y = (members.select(F.col("rep").alias(r), F.col("id").alias(i)) for r, i in (("a", "x"), ("b", "y")))
    apart = between.join(x, "a").join(y, "b").select("x", "y", "similarity")
    zero = nodes.where(~F.exists("v", lambda c: c != 0)).select(F.col("rep").alias("a")) if threshold > 0 else None
    same = members.select(F.col("rep").alias("a"), F.col("id").alias("x")).join(members.select(F.col("rep").alias("a"), F.col("id").alias("y")), "a").where("x < y and " + str(threshold <= 1).lower())
    same = same if zero is None else same.join(zero, "a", "left_anti")
    out = apart.unionByName(same.select("x", "y", F.lit(1.0).alias("similarity")))
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def similar_links(rows: DataFrame, id_: str, vector: str, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect what similar_pairs connects; copies are linked with one of them, and no group emits all its pairs."""
    nodes, members = distinct_vectors(rows, id_, vector)
    members = shared_checkpoint(members)
    copies = members.where("rep <> id")
    if threshold > 0:  # vectors without length are like nothing
        copies = copies.join(nodes.where(F.exists("v", lambda c: c != 0)).select("rep"), "rep", "left_semi")
    return similar_nodes(nodes, threshold, block, links_only=True).select("a", "b").unionByName(copies.select(F.col("rep").alias("a"), F.col("id").alias("b")))


def packed(rows: DataFrame, id_: str, vector: str, block: int) -> DataFrame:
    """(block, ids, data): unit vectors as doubles, packed where they are read, at most `block` to a row; block is a number of its own for each."""
    x, norm = _unit(vector)
    given = rows.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), x.alias("x"))

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([x.tobytes()])], names=["ids", "data"])

    return given.mapInArrow(pack, "ids binary, data binary")


def components(edges: DataFrame, nodes: DataFrame, id_: str) -> DataFrame:
    """(id, component): the smallest id reachable, by large-star and small-star rounds until nothing changes.

    Lineage is cut by checkpoint() into the shared folder.
    """
    e = shared_checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = shared_checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        same = [tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()) for x in (e, new)]
        e = new
        if same[0] == same[1]:
            break
    return nodes.select(F.col(id_)).join(e.select(F.col("u").alias(id_), "v"), id_, "left").select(id_, F.coalesce("v", id_).alias("component"))


def clustered(articles: DataFrame, threshold: float = THRESHOLD, id_: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, component): articles without a similar one are their own component."""
    return components(similar_links(articles, id_, vector, threshold), articles, id_)


def validated(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """members (id, component, embedding, weight) with `component` null for those under the threshold to the
    component's weighted centroid; it is computed once, and who stays is not tested again."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    c = coverage.weighted_centroid(members, "component", "embedding", "weight")
    out = members.join(c, "component").join(sizes, "component")
    near = (F.col("_n") < 2) | (cosine(F.col("embedding"), F.col("centroid")) >= threshold)
    return out.withColumn("component", F.when(near, F.col("component"))).drop("centroid", "_n")


def best_matches(articles: DataFrame, centroids: DataFrame, threshold: float = THRESHOLD, k: int = 1) -> DataFrame:
    """(id, story_id, similarity): the k most similar stories of each article at or over the threshold, ties to the smaller story.

    Centroids are those of stories of a few days, packed in blocks; articles are packed where they are read, and their
    blocks are dealt over tasks whatever the number of centroids, so one block of centroids is no hot key.
    """
    c = shared_checkpoint(packed(centroids, "story_id", "centroid", BLOCK))
    n = max(1, c.count())
    c = c.select(F.pmod(F.xxhash64("ids"), F.lit(n)).alias("slot"), F.col("ids").alias("r_ids"), F.col("data").alias("r_data"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))
    c = c.withColumn("salt", salts)
    a = packed(articles, "id", "embedding", BLOCK).select(F.col("ids").alias("l_ids"), F.col("data").alias("l_data"), F.pmod(F.xxhash64("ids"), F.lit(SALTS)).alias("salt"))
    a = a.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))

    def match(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for l_ids, l_data, r_ids, r_data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = np.frombuffer(l_ids, np.int64), np.frombuffer(r_ids, np.int64)
                order = np.argsort(y)
                s = np.frombuffer(l_data).reshape(len(x), -1) @ np.frombuffer(r_data).reshape(len(y), -1)[order].T
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                i = np.repeat(np.arange(len(x)), top.shape[1])
                j = top.ravel()
                keep = (s[i, j] >= threshold) & (s[i, j] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(x[i][keep]), pa.array(y[order][j][keep]), pa.array(s[i, j][keep])], names=["id", "story_id", "similarity"])

    found = a.join(c, ["slot", "salt"]).select("l_ids", "l_data", "r_ids", "r_data").mapInArrow(match, "id long, story_id long, similarity double")
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "story_id")
    return found.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k).drop("_k")


def merged_stories(stories: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(story_id, target): stories (story_id, centroid, n_articles) at or over the threshold become one, that with most articles (ties to the smaller id)."""
    groups = components(similar_links(stories, "story_id", "centroid", threshold), stories, "story_id")
    sized = groups.join(stories.select("story_id", "n_articles"), "story_id")
    best = sized.groupBy("component").agg(F.max(F.struct("n_articles", (-F.col("story_id")).alias("s"))).alias("b"))
    return sized.join(best, "component").select("story_id", (-F.col("b.s")).alias("target"))


def detached(articles: DataFrame, centroids: DataFrame, least: float = SPLIT) -> DataFrame:
    """Articles (id, story_id, embedding) that have drifted under `least` from their story's centroid."""
    return articles.join(centroids, "story_id").where(cosine(F.col("embedding"), F.col("centroid")) < least).select("id", "story_id")


def repaired(members: DataFrame, stories: DataFrame, least: float = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(members, stories) without the articles that have drifted from their story, whose centroids are taken anew; members as for `recentred`, with an id."""
    gone = detached(members.select("id", "story_id", "embedding"), stories.select("story_id", "centroid"), least)
    kept = shared_checkpoint(members.join(gone, ["id", "story_id"], "left_anti"))
    touched = kept.join(gone.select("story_id").distinct(), "story_id", "left_semi")
    return kept, recentred(stories, touched)


def attempts(singles: DataFrame, promote_at: int = 3) -> DataFrame:
    """Adds one attempt to singletons (id, attempts); those that reach the limit become stories of their own."""
    n = F.col("attempts") + 1
    return singles.select("id", n.alias("attempts"), F.when(n >= promote_at, "promoted").otherwise("pending").alias("state"))


def placed(articles: DataFrame, stories: DataFrame, as_of: Column, threshold: float = THRESHOLD, hours: float = 168, new_id: Callable[[Column], Column] = lambda smallest: smallest) -> DataFrame:
    """(id, story_id, how) of a batch of articles (id, embedding, weight) against stories (story_id, centroid, last_published).

    `matched`: an article joins its nearest story of the last `hours`. The rest
    is clustered; members that are not near their cluster's centroid leave it.
    A cluster of two or more whose own centroid is near a story joins that one
    (`duplicate`), else it is a new story (`created`), named by its smallest
    article id and so the same whenever the batch is run again. Others stay
    `single`, without a story.
    """
    recent = shared_checkpoint(stories.where(hours_between(F.col("last_published"), as_of) <= hours).select("story_id", "centroid"))
    matched = shared_checkpoint(best_matches(articles.select("id", "embedding"), recent, threshold).select("id", "story_id"))
    rest = shared_checkpoint(articles.join(matched.select("id"), "id", "left_anti").select("id", "embedding", "weight"))
    kept = validated(rest.join(clustered(rest, threshold), "id"), threshold)
    kept = shared_checkpoint(kept.withColumn("_kept", F.count("component").over(Window.partitionBy("component"))).withColumn("component", F.when(F.col("_kept") > 1, F.col("component"))).drop("_kept"))
    members = kept.where("component is not null")
    centroids = coverage.weighted_centroid(members, "component", "embedding", "weight")
    twins = best_matches(centroids.select(F.col("component").alias("id"), F.col("centroid").alias("embedding")), recent, threshold).select(F.col("id").alias("component"), F.col("story_id").alias("_twin"))
    named = members.groupBy("component").agg(new_id(F.min("id")).alias("_new")).join(twins, "component", "left")
    out = kept.select("id", "component").join(named, "component", "left")
    how = F.when(F.col("component").isNull(), "single").when(F.col("_twin").isNotNull(), "duplicate").otherwise("created")
    out = out.select("id", F.coalesce("_twin", "_new").alias("story_id"), how.alias("how"))
    return matched.select("id", "story_id", F.lit("matched").alias("how")).unionByName(out)


def recentred(stories: DataFrame, members: DataFrame) -> DataFrame:
    """stories (story_id, centroid, last_published) with the centroids of their members (story_id, embedding, weight, published_at) anew; of one member or none they stay as they are. New stories are added."""
    c = coverage.weighted_centroid(members, "story_id", "embedding", "weight").select("story_id", F.col("centroid").alias("_centroid"))
    n = members.groupBy("story_id").agg(F.count(F.lit(1)).alias("_n"), F.max("published_at").alias("_last"))
    out = stories.join(c.join(n, "story_id"), "story_id", "full")
    moved = F.col("centroid").isNull() | (F.col("_n") > 1)
    return out.select("story_id", F.when(moved, F.col("_centroid")).otherwise(F.col("centroid")).alias("centroid"), F.greatest("last_published", "_last").alias("last_published"))


def batch_step(articles: DataFrame, members: DataFrame, stories: DataFrame, as_of: Column, threshold: float = THRESHOLD, hours: float = 168) -> tuple[DataFrame, DataFrame]:
    """(members, stories) after one more batch: articles (id, embedding, weight, published_at) that have a story already are left as they are, so a batch that comes again changes nothing. Only stories that gain articles get new centroids."""
    new = articles.join(members.select("id"), "id", "left_anti")
    found = placed(new.select("id", "embedding", "weight"), stories, as_of, threshold, hours).where("story_id is not null").select("id", "story_id")
    gained = shared_checkpoint(new.join(found, "id").select("id", "story_id", "embedding", "weight", "published_at"))
    all_ = members.select(gained.columns).unionByName(gained)
    touched = all_.join(gained.select("story_id").distinct(), "story_id", "left_semi")
    return shared_checkpoint(all_), shared_checkpoint(recentred(stories, touched))
