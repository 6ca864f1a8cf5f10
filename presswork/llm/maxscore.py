"""Exact top-k inner-product search by MaxScore (operator 1).

A dimension is a query term; a shard of vectors holds one posting list per
term (the term's components of all its vectors, by vector id). Per shard and
query the terms are sorted by their score bound, the largest product of the
query's component with any in the list. The non-essential terms are the longest
run of small bounds that cannot reach the k-th best score so far on their own:
the essential lists are traversed over all vectors, then the others are probed
a few lists at a time, and only for vectors whose score so far plus the bounds
that are left can still enter the top k. A vector goes only when its bound is
strictly below the k-th score, so ties are decided by the smaller id.

Vectors are packed in shards of a bounded number where they are read. Queries
are packed in blocks; each block meets each shard once, in a join of packed
rows on the shard's number, and shards are merged by rank per query.

Arithmetic is exact: in doubles while every sum stays below 2^53, in Python's
integers beyond; scores past the range of a long are held at its ends. Vectors
that are null or hold null or non-finite components take no part, and neither
do rows without an id, nor vectors of another length than the query's. Equal
rows are different candidates of the same id; a query's own id is no candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged

SHARD_ROWS = 16384
QUERY_ROWS = 512
PROBE = 8
FOUND = "query_id long, vec_id long, score long"
PACK = "dims int, rows int, ids binary, data binary, wide boolean"


def _floor(x: Column) -> Column:
    """floor as a double, also beyond the longs."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of usable vectors; whole numbers, which doubles hold."""
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    given = vectors.where("vec_id is not null and embedding is not null")
    given = given.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("x")).where(~bad)
    return given.select("vec_id", F.transform("x", lambda c: _floor(c * scale)).alias("v"))


def _packer(rows: int):
    """Batches of (vec_id, v) -> packed rows of at most `rows` vectors of one length."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}

        def row(dims, parts):
            ids = np.concatenate([p[0] for p in parts])
            data = np.concatenate([p[1] for p in parts])
            small = not data.size or np.abs(data).max() < 2**15
            data = data.astype(np.int16) if small else data
            return pa.RecordBatch.from_pylist(
                [{"dims": dims, "rows": len(ids), "ids": ids.tobytes(), "data": data.tobytes(), "wide": not small}],
                schema=pa.schema([("dims", pa.int32()), ("rows", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("wide", pa.bool_())]),
            )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            values, sizes = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                data = values[ends[at][:, None] + np.arange(dims)] if dims else np.zeros((len(at), 0))
                for a in range(0, len(at), rows):
                    parts = held.setdefault(int(dims), [])
                    parts.append((ids[at[a : a + rows]], data[a : a + rows]))
                    if sum(len(p[0]) for p in parts) >= rows:
                        yield row(int(dims), held.pop(int(dims)))
        for dims, parts in held.items():
            yield row(dims, parts)

    return pack


def _unpacked(dims, rows, ids, data, wide):
    import numpy as np

    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64 if wide else np.int16).reshape(rows, dims).astype(np.float64)


class Shard:
    """Posting lists of one shard, by term, and what bounds a term's products."""

    def __init__(self, ids, data):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        self.ids, self.lists = ids[order], np.ascontiguousarray(data[order].T)
        self.low, self.high = self.lists.min(axis=1), self.lists.max(axis=1)

    def search(self, own: int, q, k: int):
        """Ids and scores of the k best for one query, ties to smaller ids; q in the shard's number type."""
        import numpy as np

        ids, lists = self.ids, self.lists
        bound = np.maximum(q * self.low, q * self.high)
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # bounds of the terms from a place on
        alive = np.flatnonzero(ids != own)
        # the threshold: k vectors scored whole
        theta = None
        if len(alive) > k:
            reach = np.argsort(-(q[order[:2]] @ lists[order[:2]])[alive], kind="stable")[: 4 * k]
            theta = np.sort(q @ lists[:, alive[reach]])[-k]
        essential = len(order)
        if theta is not None:
            essential = int(np.argmax(rest < theta)) if (rest < theta).any() else len(order)
        first = order[:essential]
        score = (q[first] @ lists[first])[alive]
        for at in range(essential, len(order), PROBE):
            keep = score + rest[at] >= theta
            alive, score = alive[keep], score[keep]
            terms = order[at : at + PROBE]
            score = score + q[terms] @ lists[np.ix_(terms, alive)]
        if len(score) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[score >= least], score[score >= least]
        best = np.lexsort((ids[alive], -score))[:k]
        return ids[alive[best]], score[best]


def _searcher(k: int):
    def search(batches):
        import numpy as np
        import pyarrow as pa

        names = ("dims", "rows", "ids", "data", "wide", "q_rows", "q_ids", "q_data", "q_wide")
        for batch in batches:
            for i in range(batch.num_rows):
                dims, rows, ids, data, wide, q_rows, q_ids, q_data, q_wide = (batch.column(n)[i].as_py() for n in names)
                ids, data = _unpacked(dims, rows, ids, data, wide)
                q_ids, q_data = _unpacked(dims, q_rows, q_ids, q_data, q_wide)
                most = [float(np.abs(x).max()) if x.size else 0.0 for x in (data, q_data)]
                if most[0] * most[1] * max(dims, 1) >= 2.0**53:  # Python's integers do not overflow
                    data, q_data = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (data, q_data))
                out: list[list] = [[], [], []]
                if dims == 0:
                    data, q_data = np.zeros((rows, 1)), np.zeros((q_rows, 1))
                shard = Shard(ids, data)
                for own, q in zip(q_ids.tolist(), q_data):
                    found, score = shard.search(own, q, k)
                    out[0] += [own] * len(found)
                    out[1] += found.tolist()
                    out[2] += [max(-(2**63), min(2**63 - 1, int(s))) for s in score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return search


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) from vectors and queries (vec_id long, v array<double> of whole numbers)."""
    shards = staged(vectors.mapInArrow(_packer(shard_rows), PACK), "shards")
    slots = max(1, shards.count())
    shards = shards.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)))
    n_blocks = max(1, -(-queries.count() // query_rows))

    def block(table):
        import pyarrow as pa

        return pa.Table.from_batches(list(_packer(query_rows)(table.combine_chunks().to_batches())))

    blocks = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))).groupBy("block").applyInArrow(block, PACK)
    blocks = blocks.select("dims", *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "data", "wide")])
    # each block goes to every shard: packed rows, never pairs of vectors
    blocks = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<long>")))
    found = shards.join(blocks, ["dims", "slot"]).mapInArrow(_searcher(k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
