"""Removal of repeated multi-line chunks (operator 7), in DataFrame functions only.

A text is its lines. A rolling hash covers two lines; a chunk begins where the
rolling hash is a local minimum, so boundaries depend on a few lines around
them alone and chunks line up again after an insertion. Two local minima are
never neighbours: every chunk but the first and the last has two lines or more.

A chunk of at least MIN_LINES lines that occurs more than once anywhere stays
at its first place (smallest doc_id, then position) and is removed elsewhere.
Chunks are matched by a 64-bit key first; the texts of those whose key repeats
are then grouped by their bytes, so a collision of keys removes nothing. Only
occurrences travel: keys first, texts of repeated chunks after that.

Null texts stay null, empty ones empty. Rows without doc_id pass unchanged. A
row's identity is (doc_id, hash of its text), so rows with a repeated doc_id
keep their own chunks, and equal rows count as one occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import staged
from .components import salted

MIN_LINES = 2

#: Columns that are added here begin with this, so as not to meet those of the caller.
P = "__lines_"

LINES = "split({text}, '\n', -1)"
#: for each line but the last the rolling hash of it and the next: hex digits of an md5, which other SQL engines have too
ROLL = f"transform(sequence(1, greatest(size({P}lines) - 1, 1)), i -> substring(md5(concat({P}lines[i - 1], '\n', coalesce(get({P}lines, i), ''))), 1, 8))"
#: 1-based lines at which chunks begin: the first, and local minima of the rolling hash
STARTS = f"""filter(sequence(1, size({P}lines)), i -> i = 1 or (i < size({P}lines)
  and get({P}roll, i - 1) < get({P}roll, i - 2) and (i >= size({P}lines) - 1 or get({P}roll, i - 1) <= get({P}roll, i))))"""
#: (a, b): first line of each chunk, and the line after its last
SPANS = f"transform({P}starts, (s, k) -> struct(s as a, coalesce(get({P}starts, k + 1), size({P}lines) + 1) as b))"
CHUNK = f"array_join(slice({P}lines, x.a, x.b - x.a), '\n')"


def chunked(df: DataFrame, only: str = "true") -> DataFrame:
    """Adds the lines of `text` and the spans of its chunks, where `only` holds."""
    for name, what in (("lines", LINES.format(text="text")), ("roll", ROLL), ("starts", STARTS), ("spans", SPANS)):
        df = df.withColumn(P + name, F.expr(f"case when {only} then {what} end"))
    return df.drop(P + "roll", P + "starts")


def removals(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, row_id, gone): the first lines of the chunks that go, for rows that lose any."""
    given = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_id"))
    keys = f"transform(filter({P}spans, x -> x.b - x.a >= {min_lines}), x -> struct(x.a as a, xxhash64({CHUNK}) as key))"
    keyed = chunked(given).select("doc_id", "row_id", F.explode(F.expr(keys)).alias("x")).select("doc_id", "row_id", "x.a", "x.key").distinct()
    keyed = staged(keyed, "chunks")
    repeated = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    places = salted(keyed, repeated, "key").groupBy("doc_id", "row_id").agg(F.collect_set("a").alias("places"))
    texts = chunked(given.join(places, ["doc_id", "row_id"]).dropDuplicates(["doc_id", "row_id"]))
    texts = texts.select("doc_id", "row_id", F.explode(F.expr(f"transform(filter({P}spans, x -> array_contains(places, x.a)), x -> struct(x.a as a, {CHUNK} as chunk))")).alias("x"))
    texts = staged(texts.select("doc_id", "row_id", "x.a", "x.chunk"), "repeated-chunks")
    place = F.struct("doc_id", "a", "row_id")
    first = texts.groupBy("chunk").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = salted(texts, first, "chunk").where(place != F.col("first"))
    return gone.groupBy("doc_id", "row_id").agg(F.collect_set("a").alias("gone"))


def without_repeats(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with what stays as `text`, and the longs lines_removed and chunks_removed."""
    gone = removals(docs, min_lines).select(F.col("doc_id").alias(P + "doc_id"), F.col("row_id").alias(P + "row_id"), F.col("gone").alias(P + "gone"))
    joined = docs.join(gone, (F.col("doc_id") == F.col(P + "doc_id")) & (F.xxhash64("text") == F.col(P + "row_id")), "left")
    out = chunked(joined, f"{P}gone is not null")
    stay = f"filter({P}spans, x -> not array_contains({P}gone, x.a))"
    text = F.expr(f"case when {P}gone is null then text else array_join(transform({stay}, x -> {CHUNK}), '\n') end")
    lines = F.expr(f"aggregate(filter({P}spans, x -> array_contains({P}gone, x.a)), 0L, (n, x) -> n + x.b - x.a)")
    # as a generator's output: a condition on it is not pushed down into what makes the chunks, which would make them again for each use
    done = F.struct(text.alias("text"), F.coalesce(lines, F.lit(0)).cast("long").alias("lines_removed"), F.coalesce(F.size(P + "gone"), F.lit(0)).cast("long").alias("chunks_removed"))
    out = out.withColumn(P + "done", F.explode(F.array(done)))
    keep = [F.col(f"{P}done.text").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*keep, f"{P}done.lines_removed", f"{P}done.chunks_removed")


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The documents without repeated chunks, n_chars counted anew; a document that repeats left nothing of goes."""
    out = without_repeats(docs, min_lines).where("chunks_removed = 0 or text <> ''")
    n = F.when(F.col("chunks_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[n.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
