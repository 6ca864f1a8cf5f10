"""Exact k-means by Yinyang grouping (operator 13).

Centroids are put into groups once, by a few rounds of k-means among
themselves. A vector carries its centroid, an upper bound of its distance to it
and a lower bound for each group (of the distances to the group's other
centroids). When centroids have moved, bounds move by as much: a vector whose
upper bound is below all lower bounds keeps its centroid unseen (global
filter); else its distance is taken exactly and compared again, and only groups
whose bound is not above the best distance so far are scanned, all of their
centroids exactly (group filter). A bound filters only if it is strictly
greater, so ties are decided exactly, for the smaller number.

Vectors are packed in blocks of a bounded number where they are read. A round
is one pass over the blocks: it writes them with their new state and the change
of each cluster's sum and count, and these k * (dims + 1) numbers are added up
by Spark; the driver holds the k centroids and nothing that grows with the
vectors.

Components are whole numbers (`quantized`), held at -2^27 and 2^27, so all
squared distances are exact and fit into longs; sums are decimals, and inertias
past the range of a long are held at its end. Vectors that are null, of another
length or hold null or non-finite components take no part, and neither do rows
without an id; rows with one id are vectors each. With fewer vectors than k
there are fewer centroids; without vectors there are no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import maxscore
from ._shared import staged, unstage

MOST = 2**27
BLOCK_ROWS, BLOCK_NUMBERS = 8192, 1 << 22
#: centroids in a group on average
PER_GROUP = 4
#: relative error that a bound in doubles is allowed
SLACK = 1e-12
BLOCKS = "n int, ids binary, data binary, width int, cluster binary, upper binary, lower binary, sums array<decimal(38,0)>, scanned long"
FOUND = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantized(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of usable vectors with `dims` components."""
    given = maxscore.quantized(vectors, scale).where(F.size("v") == dims)
    return given.select("vec_id", F.transform("v", lambda x: F.least(F.greatest(x, F.lit(-float(MOST))), F.lit(float(MOST)))).alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of salt and id; of one id those with smaller components come first."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [[int(x) for x in r.v] for r in vectors.orderBy(order, "v").limit(k).collect()]


def squares(x, centroids):
    """Exact squared distances, int64, of rows of x to all centroids."""
    import numpy as np

    most = max((int(np.abs(m).max()) if m.size else 0) for m in (x, centroids))
    if most * most * 4 * max(1, x.shape[1]) < 2**53:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
        return np.rint(d).astype(np.int64)
    a, out = x.astype(np.int64), np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids.astype(np.int64)):
        out[:, j] = ((a - c) ** 2).sum(axis=1)
    return out


def own_squares(x, centroids):
    """Exact squared distances of each row of x to the same row of centroids."""
    import numpy as np

    d = x.astype(np.int64) - centroids
    return np.einsum("ij,ij->i", d, d)


def groups_of(centroids, n_groups: int, rounds: int = 5):
    """A group for each centroid, by k-means among the centroids; all groups have members."""
    import numpy as np

    c = np.asarray(centroids, np.float64)
    means = c[np.linspace(0, len(c) - 1, n_groups).astype(int)]
    for _ in range(rounds):
        of = ((c[:, None] - means) ** 2).sum(axis=2).argmin(axis=1)
        means = np.array([c[of == g].mean(axis=0) if (of == g).any() else means[g] for g in range(n_groups)])
    return np.unique(of, return_inverse=True)[1]


def _pack(rows: int):
    """Batches of (vec_id, v) -> blocks without a state."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list = []

        def block():
            ids, data = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            most = np.abs(data).max() if data.size else 0
            data = data.astype(np.int8 if most < 2**7 else np.int16 if most < 2**15 else np.int32)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()]), pa.array([data.tobytes()]), pa.array([data.itemsize], pa.int32())], names=["n", "ids", "data", "width"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            ends = lists.offsets.to_numpy()
            data = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].reshape(len(ids), -1)
            for a in range(0, len(ids), rows):
                held.append((ids[a : a + rows], data[a : a + rows]))
                if sum(len(h[0]) for h in held) >= rows:
                    yield block()
        if held:
            yield block()

    return run


class State:
    """Centroids of a round as tasks need them: their groups, and how far each and the farthest of each group has moved."""

    def __init__(self, centroids, before, group):
        import numpy as np

        self.centroids, self.group = np.array(centroids, np.int64), group
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max()) + 1)]
        if before is not None:
            self.drift = np.sqrt(own_squares(self.centroids, np.array(before, np.int64))) * (1 + SLACK)
            self.group_drift = np.array([self.drift[m].max() for m in self.members])

    def assigned(self, x, cluster, upper, lower):
        """New (cluster, upper, lower) of a block's vectors, and how many distances were taken; without a cluster so far all are."""
        import numpy as np

        k, n = len(self.centroids), len(x)
        if cluster is None:
            cluster, upper = np.zeros(n, np.int32), np.full(n, np.inf)
            lower = np.zeros((n, len(self.members)))
            at, taken = np.arange(n), 0
            best = np.full(n, np.iinfo(np.int64).max)
        else:
            upper = (upper + self.drift[cluster]) * (1 + SLACK)
            lower = (lower - self.group_drift) * (1 - SLACK * np.sign(lower - self.group_drift))
            nearest = lower.min(axis=1)
            at = np.flatnonzero(upper >= nearest)
            exact = own_squares(x[at], self.centroids[cluster[at]])
            taken = len(at)
            upper[at] = np.sqrt(exact) * (1 + SLACK)
            open_ = upper[at] >= nearest[at]
            at, best = at[open_], exact[open_]
        if not len(at):
            return cluster, upper, lower, taken
        old, now, first = cluster[at], cluster[at].copy(), best.copy()
        bound, reach = lower[at], np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        known = np.full((len(at), k), np.inf)  # distances taken in this round
        scanned = np.zeros(bound.shape, bool)
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(bound[:, g] <= reach)
            if not len(rows):
                continue
            d = squares(x[at[rows]], self.centroids[members])
            taken += d.size
            scanned[rows, g] = True
            known[np.ix_(rows, members)] = np.sqrt(d) * (1 - SLACK)
            j = d.argmin(axis=1)  # the first, so the smallest number, of equal ones
            least, number = d[np.arange(len(rows)), j], members[j]
            better = (least < best[rows]) | ((least == best[rows]) & (number < now[rows]))
            won = rows[better]
            best[won], now[won] = least[better], number[better]
            reach[won] = np.sqrt(best[won]) * (1 + SLACK)
        known[np.arange(len(at)), now] = np.inf
        for g, members in enumerate(self.members):
            bound[scanned[:, g], g] = known[np.ix_(scanned[:, g], members)].min(axis=1)
        left = np.flatnonzero((now != old) & (first < np.iinfo(np.int64).max))
        left = left[~scanned[left, self.group[old[left]]]]  # the old centroid is one of its group's others now
        g = self.group[old[left]]
        bound[left, g] = np.minimum(bound[left, g], np.sqrt(first[left]) * (1 - SLACK))
        cluster = cluster.copy()
        cluster[at], upper[at], lower[at] = now, reach, bound
        return cluster, upper, lower, taken


def _round(state: State, last: bool):
    """One pass: blocks -> blocks with their new state. sums are the changes of sums and counts by cluster; in the last round the distances summed by cluster, and `upper` holds the distances."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        k, dims = state.centroids.shape
        groups = len(state.members)
        for batch in batches:
            for i in range(batch.num_rows):
                n, ids, data, width, cluster, upper, lower = (batch.column(c)[i].as_py() for c in ("n", "ids", "data", "width", "cluster", "upper", "lower"))
                x = np.frombuffer(data, {1: np.int8, 2: np.int16, 4: np.int32}[width]).reshape(n, dims)
                old = None if cluster is None else np.frombuffer(cluster, np.int32)
                bounds = (None, None) if old is None else (np.frombuffer(upper, np.float32).astype(np.float64), np.frombuffer(lower, np.float32).astype(np.float64).reshape(n, groups))
                now, high, low, taken = state.assigned(x, old, *bounds)
                if last:
                    d = own_squares(x, state.centroids[now])
                    sums = [sum(d[now == c].tolist()) for c in range(k)]
                    high, low = d, np.zeros(0)
                else:
                    moved = np.arange(n) if old is None else np.flatnonzero(now != old)
                    change = np.zeros((k, dims + 1), np.int64)
                    rows = np.hstack([x[moved].astype(np.int64), np.ones((len(moved), 1), np.int64)])
                    np.add.at(change, now[moved], rows)
                    if old is not None:
                        np.subtract.at(change, old[moved], rows)
                    sums = change.ravel().tolist()
                    # rounded outwards to floats
                    high = np.nextafter(high.astype(np.float32), np.float32(np.inf))
                    low = np.nextafter(low.astype(np.float32), np.float32(-np.inf))
                kinds = (("n", [n], pa.int32()), ("ids", [ids], pa.binary()), ("data", [None if last else data], pa.binary()), ("width", [width], pa.int32()), ("cluster", [now.astype(np.int32).tobytes()], pa.binary()))
                kinds += (("upper", [high.tobytes()], pa.binary()), ("lower", [low.tobytes()], pa.binary()), ("scanned", [taken], pa.int64()))
                arrays = {name: pa.array(v, t) for name, v, t in kinds}
                numbers = pa.array(sums, pa.decimal128(38, 0)) if last else pa.array(sums, pa.int64()).cast(pa.decimal128(38, 0))
                arrays["sums"] = pa.ListArray.from_arrays(pa.array([0, len(sums)], pa.int32()), numbers)
                names = [c.split()[0] for c in BLOCKS.split(", ")]
                yield pa.RecordBatch.from_arrays([arrays[c] for c in names], names=names)

    return run


def added(blocks: DataFrame, n: int) -> list[int]:
    """The n sums of all blocks."""
    rows = blocks.select(F.posexplode("sums").alias("i", "x")).where("x <> 0").groupBy("i").agg(F.sum("x").cast("string").alias("x")).collect()
    out = [0] * n
    for r in rows:
        out[r.i] = int(r.x)
    return out


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, salt: str = "1:", n_groups: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """FOUND for vectors (vec_id long, v array<double> of whole numbers, all of one length): k-means of `rounds` rounds from `first_centroids`."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, salt)
    if not centroids:
        return spark.createDataFrame([], FOUND)
    k, dims = len(centroids), len(centroids[0])
    group = groups_of(centroids, n_groups or -(-k // PER_GROUP))
    rows = max(1, min(block_rows, BLOCK_NUMBERS // max(k, dims, 1)))
    state = ("cluster", "upper", "lower")
    packed = vectors.mapInArrow(_pack(rows), "n int, ids binary, data binary, width int")
    blocks = staged(packed.withColumns({c: F.lit(None).cast("binary") for c in state}), "vectors")
    totals, before = [[0] * (dims + 1) for _ in range(k)], None
    for turn in range(rounds + 1):
        last = turn == rounds
        after = staged(blocks.mapInArrow(_round(State(centroids, before, group), last), BLOCKS), "clusters")
        unstage(blocks)
        blocks = after
        if last:
            break
        change = added(blocks, k * (dims + 1))
        totals = [[t + c for t, c in zip(row, change[i * (dims + 1) :])] for i, row in enumerate(totals)]
        before, centroids = centroids, [[s // row[-1] for s in row[:-1]] if row[-1] else c for row, c in zip(totals, centroids)]
    inertias = added(blocks, k)
    most = 2**63 - 1
    held, whole = [min(x, most) for x in inertias], min(sum(inertias), most)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def rows_of(batches):
        import numpy as np
        import pyarrow as pa

        by_cluster, digest = np.array(held, np.int64), pa.array(digests)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, cluster, distance = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((0, np.int64), (1, np.int32), (2, np.int64)))
                columns = [pa.array(ids), pa.array(cluster), pa.array(distance), pa.array(by_cluster[cluster]), pa.array(np.full(len(ids), whole, np.int64)), digest.take(pa.array(cluster))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    return blocks.select("ids", "cluster", "upper").mapInArrow(rows_of, FOUND)
