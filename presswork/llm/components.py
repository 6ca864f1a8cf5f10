"""Connected components, and links found inside buckets without listing all pairs.

`components` alternates large-star and small-star (Kiveris et al., 2014) until
the edges no longer change: every round is two grouped minima with a join back
and one table in the shared folder. A round is dealt by its number of edges:
up to TASK_EDGES of them are one task, more are shuffled by node, and no task
holds a neighbourhood in memory, as its sorts spill.

`linked` finds the components that buckets of nodes and an exact test of pairs
define. In each round some nodes of a bucket are its centres, the smallest of
each part of it: they are tested against every node of the bucket that is not
yet in their component, and then leave the bucket, as all that they could add
is known. There are GROWTH times as many parts each round, and buckets whose nodes are
in one component are done. So a bucket of m linked nodes costs m tests, not
m * m, no link between different components goes untested, and there is no
cap. A caller that has narrower buckets for nodes that do not link asks for a
few rounds, and gets what is open after them.

All joins are sort-merge joins by name: their sides grow with the input, Spark
splits their skewed partitions, and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import measured, unstage

GROWTH = 16
#: edges that one task takes (some 20 MB); Spark plans no exchange over a table of one task
TASK_EDGES = 500_000
#: parts that the rows of a hot key are dealt over where they meet a table that has each key once
SALTS = 4


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def salted(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join of rows whose `on` may be hot with right, which has each `on` once and is repeated for each of SALTS parts."""
    salt = F.pmod(F.xxhash64(*[c for c in left.columns if c != on]), F.lit(SALTS)).cast("int").alias("__salt")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    return merged(left.select("*", salt), right.select("*", parts), [on, "__salt"]).drop("__salt")


def dealt(edges: DataFrame, n: int | None) -> DataFrame:
    """n edges as one task where they fit, else (or where n is not known) as they are."""
    return edges.coalesce(1) if n is not None and n <= TASK_EDGES else edges


def components(edges: DataFrame, name: str = "components", n: int | None = None) -> tuple[DataFrame, int]:
    """From n edges (u long, v long), a staged table or as cheap to read twice, rows (node, root) and their number: root is the smallest node reachable; nodes that are their own root have no row."""
    e, before, last = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None, None
    while True:
        both = dealt(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), n)
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = merged(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = merged(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        both = dealt(small.unionByName(least.select("u", F.col("m").alias("v"))), n)
        e, n, found = measured(both.distinct(), name, F.bit_xor(F.xxhash64("u", "v")).alias("edges"))
        unstage(last)
        after, last = (n, found.get("edges")), e
        if after == before or not n:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.staged_path = e.staged_path
            return out, n
        before = after


def linked(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    name: str = "linked",
    roots: DataFrame | None = None,
    n_roots: int = 0,
    rounds: int | None = None,
    order: tuple[str, ...] = ("node",),
    width: int = 1,
    possible: str = "true",
) -> tuple[DataFrame | None, int, DataFrame, int]:
    """From staged (bucket, node long) and an exact test of pairs (a, b): rows (node, root) as `components` gives (None where nothing is linked), what is still open, and the number of rows of each.

    verify takes pairs (a, b, u, v), a > b, u and v being their roots so far,
    and returns those that are linked. roots, if given, are n_roots links known
    before. After `rounds` (None: as many as it takes) the buckets' nodes that
    are not yet tested against each other are left as what is open. The first
    round takes `width` centres of each bucket, the first of each part by
    `order`; `possible` may name a condition on the columns of a centre (with
    c_ before their names) and of a node that linked pairs fulfil in at least
    one of their buckets.
    """
    more = [c for c in buckets.columns if c not in ("bucket", "node")]
    live, open_, done, n = None, buckets, 0, 1
    while True:
        if "root" in open_.columns:  # no new links since
            fresh = open_
        elif roots is None:
            fresh = open_.withColumn("root", F.col("node"))
        else:
            fresh = merged(open_, roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        if done or roots is not None:
            several = fresh.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
            fresh, n, _ = measured(salted(fresh, several, "bucket"), name)
            unstage(live)
        live = fresh
        if done == rounds or not n:
            return roots, n_roots, live, n
        part = F.pmod(F.xxhash64("node"), F.lit(width)).alias("part")
        first = F.min(F.struct(*order, *[c for c in ("node", "root", *more) if c not in order])).alias("c")
        centres = live.groupBy("bucket", part).agg(first).select("bucket", *[F.col(f"c.{c}").alias(f"c_{c}") for c in ("node", "root", *more)])
        pairs = merged(live, centres, "bucket").where(f"root <> c_root and ({possible})")
        pairs = pairs.select(F.greatest("node", "c_node").alias("a"), F.least("node", "c_node").alias("b"), F.greatest("root", "c_root").alias("u"), F.least("root", "c_root").alias("v"))
        found, links, _ = measured(verify(pairs.distinct()).select("u", "v").distinct(), name)
        if links:
            known = roots
            edges = found if known is None else found.unionByName(known.select(F.col("node").alias("u"), F.col("root").alias("v")))
            roots, n_roots = components(edges, name, links + n_roots)
            if done:
                unstage(known)
        unstage(found)
        open_ = merged(live.select("bucket", "node", *more, *([] if links else ["root"])), centres.select("bucket", F.col("c_node").alias("node")), ["bucket", "node"], "left_anti")
        width, done = GROWTH * width, done + 1
