"""Removal of passages that repeat across documents (operator 6).

Texts need not mark their paragraphs, and a copied passage may begin within a
line. A paragraph here is a run of WORDS words from an anchor: the first word,
and every word at which the hash of it and the next is smallest among RADIUS
words on either side. Anchors depend on the words around them alone, so a
passage of some fifty words has the same paragraphs wherever it stands.

1. Bands of MinHash over a paragraph's 5-word shingles; `tuned` picks as many
   bands as a wanted recall at the threshold takes.
2. Bands' buckets are counted, each once for a document (twice if it holds
   two paragraphs apart), with partial sums ahead of the shuffle; only the
   paragraphs in buckets with more than one are named by place.
3. Equal paragraphs (a 64-bit hash of their shingles) are one node. Nodes that
   share a bucket are linked where the exact Jaccard similarity of their
   shingle sets reaches the threshold: centres first, then the buckets of rare
   shingles for what is open (see `components` and `near_dup`).
4. Each component keeps its first place (smallest doc_id, then position);
   other places that do not overlap it are removals.

Null and empty texts, and texts of fewer than WORDS words, have no paragraphs;
rows without doc_id take no part and are passed unchanged by `without_repeats`.
A document is known by row_id, a hash of doc_id and text: equal rows count as
one document, and rows with the same doc_id and different texts are documents
of their own, each cut at its own places alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WordHashes, hashes_of_texts, mixed, shingle_hashes, staged, texts_as_bytes, unstage
from .components import merged, salted
from .near_dup import alike, coefficients, grouped

WORDS, RADIUS, SHINGLE, ROWS = 20, 5, 5, 2
RECALL, PERCENT = 0.98, 80


def tuned(percent: int = PERCENT, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of `rows` minima that find a pair at the threshold with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


def chunks(texts: list, words: int = 100_000):
    """Runs (from, to) of texts of about so many words, that numpy works on whole runs."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"") // 5
        if size >= words:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def paragraphs(texts: list, cache: WordHashes, a=None, b=None):
    """(document, place, node, shingles, buckets by band) of the paragraphs of some texts; without a and b no buckets.

    Texts stand in one array with a gap between them in which no word is a
    minimum, so each has the anchors that it has alone.
    """
    import numpy as np

    found, sizes = hashes_of_texts(texts, cache)
    gap = np.zeros(RADIUS + 1, np.uint64)
    starts = np.cumsum(sizes + len(gap)) - sizes - len(gap)
    hashes = np.zeros(len(found) + len(sizes) * len(gap), np.uint64)
    hashes[np.arange(len(found)) + np.repeat(np.arange(len(sizes)) * len(gap), sizes)] = found
    top = np.iinfo(np.uint64).max
    g = np.full(len(hashes), top)
    if len(hashes):
        g[:-1] = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    for d in range(-1, len(gap)):  # the last word has no next one
        g[starts[sizes + d >= 0] + sizes[sizes + d >= 0] + d] = top
    least = g < top
    for d in range(1, RADIUS + 1):
        least[d:] &= g[d:] < g[:-d]
        least[:-d] &= g[:-d] <= g[d:]
    least[starts[sizes >= WORDS]] = True
    at = np.flatnonzero(least)
    doc = np.searchsorted(starts, at, "right") - 1
    place = at - starts[doc]
    fits = place <= sizes[doc] - WORDS
    at, doc, place = at[fits], doc[fits], place[fits]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, WORDS - SHINGLE + 1), np.uint64), np.zeros((0, 0 if a is None else len(a) // ROWS), np.int64)
    s = shingle_hashes(hashes, SHINGLE)[at[:, None] + np.arange(WORDS - SHINGLE + 1)]
    node = np.zeros(len(at), np.uint64)
    for j in range(s.shape[1]):
        node = node * np.uint64(0x9E3779B97F4A7C15) + s[:, j]
    bands = 0 if a is None else len(a) // ROWS
    buckets = np.empty((len(at), bands), np.uint64)
    for k in range(bands):
        h = np.full(len(at), k + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(k * ROWS, (k + 1) * ROWS):
            h = mixed(h ^ (s * a[r] + b[r]).min(axis=1))
        buckets[:, k] = h
    return doc, place, mixed(node).view(np.int64), s, buckets.view(np.int64)


def _given(docs: DataFrame) -> DataFrame:
    given = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.select("doc_id", "text", row_id())


def row_id() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row_id")


def buckets_of(docs: DataFrame, bands: int) -> DataFrame:
    """(bucket, weight): for each document its buckets once, with weight 2 where two paragraphs apart share it."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        cache, (a, b) = WordHashes(), coefficients(bands * ROWS, 23)
        for batch in batches:
            texts = texts_as_bytes(batch.column(1))
            for x, y in chunks(texts):
                doc, place, _, _, buckets = paragraphs(texts[x:y], cache, a, b)
                doc, place, bucket = np.repeat(doc, bands), np.repeat(place, bands), buckets.ravel()
                order = np.lexsort((place, bucket, doc))
                doc, place, bucket = doc[order], place[order], bucket[order]
                first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(bucket, prepend=0) != 0))
                last = np.append(first[1:], len(doc)) - 1
                weight = 1 + (place[last] - place[first] >= WORDS) if len(doc) else first
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(weight.astype(np.int32))], names=["bucket", "weight"])

    return _given(docs).mapInArrow(count, "bucket long, weight int")


def places_of(docs: DataFrame, bands: int) -> DataFrame:
    """(bucket, row_id, place int) of every paragraph and band; place is bands * its first word + the band."""

    def name(batches):
        import numpy as np
        import pyarrow as pa

        cache, (a, b) = WordHashes(), coefficients(bands * ROWS, 23)
        for batch in batches:
            ids, texts = batch.column(2).to_numpy(), texts_as_bytes(batch.column(1))
            for x, y in chunks(texts):
                doc, place, _, _, buckets = paragraphs(texts[x:y], cache, a, b)
                at = place[:, None] * bands + np.arange(bands)
                yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), pa.array(np.repeat(ids[x:y][doc], bands)), pa.array(at.ravel().astype(np.int32))], names=["bucket", "row_id", "place"])

    return _given(docs).mapInArrow(name, "bucket long, row_id long, place int")


def members_of(docs: DataFrame, places: DataFrame, bands: int) -> DataFrame:
    """(node, doc_id, row_id, start int, buckets, shingles) of the paragraphs at `places` (row_id, places), each row once: the buckets of these bands, and the set where a task's run of texts meets the node first, else null."""

    def take(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        cache, (a, b) = WordHashes(), coefficients(bands * ROWS, 23)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        names = ["node", "doc_id", "row_id", "start", "buckets", "shingles"]
        for batch in batches:
            ids, rows, texts, wanted = batch.column(0).to_numpy(), batch.column(2).to_numpy(), texts_as_bytes(batch.column(1)), batch.column(3)
            for x, y in chunks(texts):
                doc, place, node, s, buckets = paragraphs(texts[x:y], cache, a, b)
                wants = wanted.slice(x, y - x)
                of = np.repeat(np.arange(y - x), np.asarray(pc.list_value_length(wants)))
                asked = wants.flatten().to_numpy()
                order = np.lexsort((asked, of))
                of, asked = of[order], asked[order]
                # paragraphs stand by document and place, and so do those that are asked for
                wide = int(max(place.max(initial=0), asked.max(initial=0) // bands)) + 1
                all_, one = doc * wide + place, of * wide + asked // bands
                at = np.searchsorted(all_, one)
                fits = at < len(all_)
                fits[fits] = all_[at[fits]] == one[fits]
                at, band = at[fits], asked[fits] % bands
                begins = np.flatnonzero(np.diff(at, prepend=-1))
                rows_at = at[begins]
                ends = np.append(begins, len(at)).astype(np.int32)
                first = np.zeros(len(rows_at), bool)
                first[np.unique(node[rows_at], return_index=True)[1]] = True
                sets = np.sort(s[rows_at[first]], axis=1)
                new = np.diff(sets, axis=1, prepend=0) != 0
                new[:, 0] = True
                lengths = np.zeros(len(rows_at), np.int64)
                lengths[first] = new.sum(axis=1)
                offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32), mask=np.append(~first, False))
                columns = [
                    *(pa.array(c, k) for c, k in zip((node[rows_at], ids[x:y][doc[rows_at]], rows[x:y][doc[rows_at]], place[rows_at].astype(np.int32)), kinds)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets[at, band])),
                    pa.ListArray.from_arrays(offsets, pa.array(sets[new].view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = merged(_given(docs), places, "row_id").select("doc_id", "text", "row_id", "places")
    return found.mapInArrow(take, "node long, doc_id long, row_id long, start int, buckets array<long>, shingles array<long>")


def repeats(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """(doc_id, row_id, start, first_doc_id, first_row_id, first_start): every paragraph that has a like elsewhere; `first` is the place that stays."""
    bands = tuned(percent, recall)
    often = buckets_of(docs, bands).groupBy("bucket").agg(F.sum("weight").alias("n")).where("n > 1").select("bucket")
    # a table between the shuffles of buckets and that of texts: the first are over before the second begins
    places = salted(places_of(docs, bands), often, "bucket").groupBy("row_id").agg(F.collect_list("place").alias("places"))
    places = staged(places, "places")
    members = staged(members_of(docs, places, bands), "members")
    unstage(places)
    buckets = members.select(F.explode("buckets").alias("bucket"), "node").distinct()
    several = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    buckets = staged(salted(buckets, several, "bucket"), "passages")
    wanted = buckets.select("node").distinct()
    sets = members.where("shingles is not null").select("node", "shingles")
    sets = staged(merged(sets, wanted, "node", "left_semi").dropDuplicates(["node"]).withColumnRenamed("node", "doc_id"), "passage-sets")
    roots = grouped(buckets, lambda pairs: alike(pairs, sets, percent), sets, percent, "passages")
    unstage(buckets)
    unstage(sets)
    place = F.struct("doc_id", "start", "row_id")
    named = members.select("node", "doc_id", "row_id", "start").distinct()
    named = named.withColumnRenamed("node", "root") if roots is None else merged(named, roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "doc_id", "row_id", "start")
    # a place overlaps the first if it is in the same document within WORDS words
    ends = named.groupBy("root").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"))
    ends = ends.where((F.col("lo") != F.col("hi")) | (F.col("last.start") - F.col("first.start") >= WORDS)).select("root", "first")
    out = salted(named, ends, "root")
    return out.select("doc_id", "row_id", "start", F.col("first.doc_id").alias("first_doc_id"), F.col("first.row_id").alias("first_row_id"), F.col("first.start").alias("first_start"))


def stays() -> str:
    """Condition on rows of `repeats`: the place that stays, or one that overlaps it."""
    return f"row_id = first_row_id and start - first_start < {WORDS}"


def without_repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs less the words of repeated paragraphs, with the long words_removed; white space is that of the words that stay."""
    gone = repeats(docs, percent).where(f"not ({stays()})").groupBy(F.col("row_id").alias("__passages_id")).agg(F.sort_array(F.collect_set("start")).alias("__passages_gone"))
    joined = docs.withColumn("__passages_row", F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), row_id()))
    joined = joined.join(gone, F.col("__passages_row") == F.col("__passages_id"), "left")

    @F.pandas_udf("text string, n long")
    def cut(texts, starts):
        import numpy as np
        import pandas as pd
        import regex

        word = regex.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
        out, removed = [], []
        for text, at in zip(texts, starts):
            if text is None or at is None:
                out.append(text)
                removed.append(0)
                continue
            raw = text.encode()
            spans = [m.span() for m in word.finditer(raw)]
            keep = np.ones(len(spans), bool)
            for s in at:
                keep[s : s + WORDS] = False
            lead = raw[: spans[0][0]] if spans else raw
            out.append((lead + b"".join(raw[x:y] for (x, y), k in zip(spans, keep) if k)).decode())
            removed.append(int((~keep).sum()))
        return pd.DataFrame({"text": out, "n": removed})

    done = joined.withColumn("__passages_cut", F.when(F.col("__passages_gone").isNotNull(), cut(F.col("text"), F.col("__passages_gone"))))
    text = F.when(F.col("__passages_gone").isNull(), F.col("text")).otherwise(F.col("__passages_cut.text"))
    return done.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], F.coalesce("__passages_cut.n", F.lit(0)).cast("long").alias("words_removed"))
