"""MinHash near-duplicate groups of whole documents (operator 2).

1. One pass in Arrow batches takes each document's set of 5-word shingles and
   BANDS * ROWS universal hash minima (a * x + b modulo 2^64) of it.
2. Documents with equal sets collapse to one node (a 128-bit digest of the
   set), so thousands of copies are one row from here on.
3. Nodes that share a band's hash are candidates. `components.linked` tests
   each against its bucket's centres: first by the signature (one byte of each
   minimum; the allowance is seven standard deviations), then by the exact
   intersection of the full sets. Nodes of buckets that are still open after
   ROUNDS rounds (large groups of texts that are alike but mostly not linked)
   are tested by narrower buckets: those that share one of their rarest
   shingles, of which linked sets always have one in common.
4. Components by alternating large-star and small-star; the smallest doc_id
   names them.

With 25 bands of 4 rows a pair at a similarity of 0.85 stays unseen with
probability (1 - 0.85^4)^25 < 1e-8.

Null and empty texts have no shingles, are linked with nothing and kept. Rows
with the same doc_id are the same document: each gets a row. Rows without
doc_id take no part in `near_duplicates`; `deduplicated` lets them pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WordHashes, shingle_hashes, staged, texts_as_bytes, unstage, word_hashes, words_of
from .components import linked, merged, salted

BANDS, ROWS = 25, 4
#: of tests against centres of the bands' buckets; the nodes that are open after them go by their rare shingles, against so many centres of each first
ROUNDS, RARE_CENTRES = 1, 64
BLOCK = 2048


def coefficients(n: int, seed: int = 17):
    import numpy as np

    draws = np.random.default_rng(seed).integers(0, 2**63, size=(2, n), dtype=np.uint64)
    return draws[0] * np.uint64(2) + np.uint64(1), draws[1] * np.uint64(2) + np.uint64(1)


def minima(shingles, a, b):
    """The minimum of each hash function a * x + b over the shingles."""
    import numpy as np

    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        x = np.multiply.outer(a, shingles[at : at + BLOCK])
        x += b[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, digest, signature, buckets) of whole texts; without shingles the last three are null."""

    def sign(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        cache, (a, b) = WordHashes(), coefficients(bands * rows)
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in texts_as_bytes(batch.column(1)):
                s = np.unique(shingle_hashes(word_hashes(words_of(text), cache)))
                out[0].append(len(s))
                if not len(s):
                    for c in out[1:]:
                        c.append(None)
                    continue
                m = minima(s, a, b)
                out[1].append(xxhash.xxh3_128_digest(s.tobytes()))
                out[2].append((m >> np.uint64(56)).astype(np.uint8).tobytes())
                h = salt.copy()
                for r in range(rows):
                    h = (h ^ m[r::rows]) * np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(29)
                out[3].append(h.astype(np.int64))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "n_shingles", "digest", "signature", "buckets"])

    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, signature binary, buckets array<long>")


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, shingles): each document's distinct shingle hashes."""

    def take(batches):
        import numpy as np
        import pyarrow as pa

        cache = WordHashes()
        for batch in batches:
            sets = [np.unique(shingle_hashes(word_hashes(words_of(t), cache), k)).astype(np.int64) for t in texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(take, "doc_id long, shingles array<long>")


def likely(pairs: DataFrame, signatures: DataFrame, similarity: float, n: int) -> DataFrame:
    """Pairs whose signatures agree in as many places as the similarity lets expect, less seven standard deviations."""
    least = int(n * similarity - 7 * (n * similarity * (1 - similarity)) ** 0.5)

    def agree(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, n) for i in (4, 5))
            yield batch.select([0, 1, 2, 3]).filter(pa.array((x == y).sum(axis=1) >= least))

    x, y = (signatures.select(F.col("node").alias(c), F.col("signature").alias(s)) for c, s in (("a", "sa"), ("b", "sb")))
    return merged(merged(pairs, x, "a"), y, "b").select("a", "b", "u", "v", "sa", "sb").mapInArrow(agree, "a long, b long, u long, v long")


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets."""
    x, y = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "sa"), ("b", "sb")))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return merged(merged(pairs, x, "a"), y, "b").withColumn("common", common).where(100 * F.col("common") >= percent * union).select("a", "b", "u", "v")


def by_rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, node, place, size): each set's shingles that come first by rarity, as many as a similar set must share one of.

    Of two sets with 100 * intersection >= percent * union the first shingle
    that both have, in any one order of all shingles, is among the first
    size - ceil(percent / 100 * size) + 1 of either; and if it stands at `place`
    in both, no more than 1 + least(size - place) are in common.
    """
    each = staged(sets.select(F.col("doc_id").alias("node"), F.size("shingles").alias("size"), F.explode("shingles").alias("bucket")), "rarity")
    often = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "bucket"))
    first = salted(each, often, "bucket").withColumn("place", place).where(f"100 * (place - 1) <= (100 - {percent}) * size")
    first = staged(first.select("bucket", "node", "place", "size"), "rare")
    shared = first.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    out = staged(salted(first, shared, "bucket"), "rare-shared")
    unstage(each)
    unstage(first)
    return out


def grouped(buckets: DataFrame, verify, sets: DataFrame, percent: int, name: str) -> DataFrame | None:
    """(node, root) of the nodes that the test links: ROUNDS rounds of centres of the bands' buckets, then the rare shingles of the nodes still open."""
    roots, n_roots, open_, n = linked(buckets, verify, name, rounds=ROUNDS)
    if n:
        nodes = open_.select(F.col("node").alias("doc_id")).distinct()
        narrow = by_rare_shingles(merged(sets, nodes, "doc_id", "left_semi"), percent)
        possible = f"(100 + {percent}) * (1 + least(size - place, c_size - c_place)) >= {percent} * (size + c_size)"
        roots, _, left, _ = linked(narrow, verify, name + "-rare", roots=roots, n_roots=n_roots, order=("place", "node"), width=RARE_CENTRES, possible=possible)
        unstage(left)
        unstage(narrow)
    unstage(open_)
    return roots


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document with an id."""
    signed = staged(signatures(docs, bands, rows), "signatures")
    nodes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("buckets").alias("buckets"))
    nodes = staged(nodes, "nodes")
    buckets = nodes.select(F.explode("buckets").alias("bucket"), "node")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    buckets = staged(salted(buckets, shared, "bucket"), "buckets")
    wanted = buckets.select(F.col("node").alias("doc_id")).distinct()
    sets = staged(shingle_sets(merged(docs.select("doc_id", "text"), wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        return alike(likely(pairs, nodes, percent / 100, bands * rows), sets, percent)

    roots = grouped(buckets, verify, sets, percent, "near")
    unstage(buckets)
    unstage(sets)
    named = nodes.select("digest", "node").withColumn("root", F.col("node")) if roots is None else merged(nodes.select("digest", "node"), roots, "node", "left")
    named = named.select("digest", F.coalesce("root", "node").alias("component_id"))
    out = merged(signed.select("doc_id", "n_shingles", "digest"), named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents of which near_duplicates keeps one of each group; those without an id stay."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
