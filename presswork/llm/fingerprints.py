"""One-permutation MinHash fingerprints (operator 4), in DataFrame functions only.

A text's 5-word shingles (of the lower-cased text; with fewer words the whole
sequence is one) are hashed once. The top bits of a hash name one of BINS bins
and each bin keeps its smallest hash. An empty bin i is filled by optimal
densification: it tries the bins that a 2-universal hash of (i, attempt) names
until one holds a hash, and after TRIES attempts takes the one of all filled
bins that a hash of (i, bin) ranks first, so every bin is filled at last. Of
each bin the BITS low-order bits stay, packed 16 bins to a long and written in
hex. Two texts agree in a bin by chance with probability 2^-BITS, which
`likeness` corrects: (m - 2^-BITS) / (1 - 2^-BITS), at least 0, m being the
share of bins that agree.

A text without words has the empty fingerprint: like another such text 1, like
any other 0. Null texts are empty ones; rows without doc_id take no part. Rows
with one doc_id are ordered by a hash of their texts; equal rows count as one
document in that order, and each gets its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged

#: of ids, at most, whatever the number of rows
RANGES = 4096
BINS, BITS, TRIES = 256, 4, 8
SHINGLE = 5
P = "__print_"
#: 63 bits of hash; the top 8 of them are the bin
SHIFT = 55
#: a prime above all (i, attempt), and odd multipliers of the 2-universal hash
PRIME, MULT, STEP = 2147483647, 1103515245, 12345 * 7919
SPACES = "[\\x20\\x09-\\x0D]+"


def _try(m: str, a: int) -> str:
    return f"get({m}, cast(((i * {MULT}L + {a * STEP}L + 40503L) % {PRIME}L) % {BINS}L as int))"


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`, an array of BINS * BITS / 64 longs (empty for a text without words), of the column `text`."""
    w, h, s, m, f, b = (f"{P}{c}" for c in "whsmfb")
    longest = (1 << SHIFT) - 1
    df = df.withColumn(w, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACES), lambda x: x != ""))
    df = df.withColumn(h, F.expr(f"transform({w}, x -> xxhash64(x))")).drop(w)
    shingles = f"transform(sequence(1, greatest(size({h}) - {SHINGLE - 1}, 1)), i -> xxhash64(slice({h}, i, {SHINGLE})) & {2**63 - 1}L)"
    marks = f"transform(sequence(0L, {BINS - 1}L), i -> i * {1 << SHIFT}L + {longest}L)"  # the largest hash of each bin, so that none is missing
    df = df.withColumn(s, F.expr(f"case when size({h}) > 0 then sort_array(concat({shingles}, {marks})) end"))
    least = f"filter({s}, (x, i) -> i = 0 or shiftright(x, {SHIFT}) <> shiftright(get({s}, i - 1), {SHIFT}))"
    df = df.withColumn(m, F.expr(f"transform({least}, x -> case when (x & {longest}L) < {longest}L then x end)")).drop(h, s)
    # (bin, hash) of the filled bins, for the few that TRIES attempts leave empty
    df = df.withColumn(f, F.expr(f"filter({m}, x -> x is not null)"))
    tries = ", ".join(_try(m, a) for a in range(1, TRIES + 1))
    last = f"element_at(array_sort(transform({f}, x -> struct(xxhash64(i, shiftright(x, {SHIFT})) as r, x as x))), 1).x"
    full = f"transform(sequence(0, {BINS - 1}), i -> xxhash64(coalesce(get({m}, i), {tries}, {last}), i) & {(1 << BITS) - 1}L)"
    df = df.withColumn(b, F.expr(f"case when size({f}) > 0 then {full} end")).drop(m, f)
    per = 64 // BITS
    packed = f"transform(sequence(0, {BINS // per - 1}), j -> aggregate(slice({b}, j * {per} + 1, {per}), 0L, (a, x) -> shiftleft(a, {BITS}) | x))"
    return df.withColumn(name, F.expr(f"case when size({b}) > 0 then {packed} else cast(array() as array<bigint>) end")).drop(b)


def written(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimated similarity of the texts of two packed fingerprints, 0 to 1."""
    ones = int("1" * (64 // BITS), 16)
    x = "(p ^ q)"
    unlike = f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & {ones}L)"
    same = f"({BINS} - aggregate(zip_with({a}, {b}, (p, q) -> {unlike}), 0, (n, x) -> n + x)) / {BINS}D"
    chance = 2.0**-BITS
    return F.expr(f"case when size({a}) = 0 or size({b}) = 0 then cast(size({a}) = size({b}) as double) else greatest(0D, ({same} - {chance}D) / {1 - chance}D) end")


def neighbours(ids: DataFrame) -> DataFrame:
    """ids (doc_id, row_id) with next_id and next_row: the next in descending order, after the last the first.

    Ranges of ids are dealt to partitions; within one the next is a window's,
    and a range's last row is followed by the head of the next range. Only the
    heads, a row for each range, are ordered together.
    """
    ranged = ids.repartitionByRange(max(1, min(RANGES, -(-ids.count() // 4096))), F.desc("doc_id"), F.desc("row_id"))
    ranged = staged(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("part").agg(F.max(F.struct("doc_id", "row_id")).alias("head"))
    follows = heads.withColumn("after", F.lead("head").over(Window.orderBy(F.desc("head")))).select("part", "after")
    order = Window.partitionBy("part").orderBy(F.desc("doc_id"), F.desc("row_id"))
    top = heads.agg(F.max("head")).first()[0]
    wrap = F.struct(F.lit(top.doc_id).alias("doc_id"), F.lit(top.row_id).alias("row_id")) if top else F.lit(None).cast("struct<doc_id:bigint,row_id:bigint>")
    out = ranged.withColumn("n", F.lead(F.struct("doc_id", "row_id")).over(order)).join(follows, "part")
    n = F.coalesce("n", "after", wrap)
    return out.select("doc_id", "row_id", n["doc_id"].alias("next_id"), n["row_id"].alias("next_row"))


def edited_by_next(docs: DataFrame) -> DataFrame:
    """(doc_id, row_id, text, n_chars, edited, next_id, next_row): the second half gives way to the next document's beginning."""
    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    given = given.withColumn("row_id", F.xxhash64("text"))
    ids = staged(given.select("doc_id", "row_id", F.length("text").cast("long").alias("n_chars")), "ids")
    single = ids.groupBy("doc_id", "row_id").agg(F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    repeated = not single.where("copies > 1").isEmpty()
    near = staged(neighbours(single.select("doc_id", "row_id")).join(single.select("doc_id", "row_id", "n_chars"), ["doc_id", "row_id"]), "next")
    once = given.dropDuplicates(["doc_id", "row_id"]) if repeated else given
    begins = once.join(near.select(F.col("doc_id").alias("for_id"), F.col("row_id").alias("for_row"), F.col("next_id").alias("doc_id"), F.col("next_row").alias("row_id"), "n_chars"), ["doc_id", "row_id"])
    begins = begins.select(F.col("for_id").alias("doc_id"), F.col("for_row").alias("row_id"), F.col("doc_id").alias("next_id"), F.col("row_id").alias("next_row"), "n_chars", F.expr("substring(text, 1, cast(n_chars div 2 as int))").alias("begin"))
    out = given.join(begins, ["doc_id", "row_id"])
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), "begin")
    return out.select("doc_id", "row_id", "text", "n_chars", edited.alias("edited"), "next_id", "next_row")


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    both = with_fingerprint(edited_by_next(docs).withColumn("edited_sha256", F.sha2("edited", 256)), "text", "own").drop("text")
    both = staged(with_fingerprint(both, "edited", "other").drop("edited"), "fingerprints")
    next_ = both.select(F.col("doc_id").alias("next_id"), F.col("row_id").alias("next_row"), F.col("own").alias("next_own")).dropDuplicates(["next_id", "next_row"])
    out = both.join(next_, ["next_id", "next_row"])
    return out.select("doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "next_own").alias("near_next"))
