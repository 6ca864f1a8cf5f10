"""Audit of how document filters interact (operator 11).

1. Texts are range-sorted by (fingerprint, text, doc_id). The ranges are cut by
   fingerprint and doc_id alone, so their bounds hold no text and the copies of
   one text, however many, fall into as many ranges as they need.
2. One pass over each sorted range computes the failures of a text, once for
   all copies that follow each other, and compares every row with those before
   it: a row is a duplicate if its text, byte by byte, is that of a smaller
   doc_id. Only the first rows of a range can have such a row in another range.
   They leave with their text, as do the first rows of the texts that a range
   ends with; these few are matched in a join.
3. Failures are bits of a mask. Counts by part and mask are additive, with and
   without labels, and every order of the filters is evaluated on these counts:
   no order reads the documents again.

A null text counts as empty. Rows without doc_id are documents: they are no
one's duplicate, have no copies and no labels. Rows with one doc_id are
documents each; equal rows are not duplicates of each other (no id is smaller).
A null source and an empty one are the part ''. A label is given if any of a
document's label rows gives it; null labels give none. An empty table has no
parts and so no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import staged, texts_as_bytes

CONTINUED = bytes(range(0x80, 0xC0))
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = re.compile(rb"[#$%&*|]")


class Measures:
    """What filters ask of a text (UTF-8)."""

    def __init__(self, text: bytes):
        words = text.split()  # at x20 and x09 to x0D
        self.text, self.words, self.distinct = text, len(words), len(set(words))
        self.chars = len(text.translate(None, CONTINUED))
        self.capitals = len(text) - len(text.translate(None, CAPITALS))


Filter = Callable[[Measures], bool]

#: the filters of texts by letter, each True where the text fails; duplicates come after them
FILTERS: dict[str, Filter] = {
    "A": lambda m: m.words < 50,
    "B": lambda m: 100 * m.distinct < 65 * m.words,
    "C": lambda m: 100 * m.capitals > 5 * m.chars,
    "D": lambda m: MARKS.search(m.text) is not None,
}
DUPLICATE = "E"
FOUND = "doc_id long, part string, mask int, key long, text binary, ends boolean"


def _pass(filters: list[Filter]):
    """Sorted (key, text, doc_id, part) -> a row for each document; those still open have key and text, and rows with `ends` tell the first id of each text at the range's end."""
    repeated = 1 << len(filters)

    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())
        names = ("doc_id", "part", "mask", "key", "text", "ends")

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        head = key = text = first = None
        mask, last = 0, []  # of the current text; the texts of the current key with their first ids
        for batch in batches:
            rows = []
            for k, t, doc_id, part in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if k != key or t != text:
                    if k != key:
                        last = []
                    if head is None:
                        head = k
                    key, text, first = k, t, None
                    m = Measures(t)
                    mask = sum(1 << i for i, fails in enumerate(filters) if fails(m))
                if doc_id is not None and first is None:
                    first = doc_id
                    last.append((t, doc_id))
                open_ = doc_id is not None and doc_id == first and k == head
                again = doc_id is not None and doc_id > first
                rows.append((doc_id, part, mask | repeated * again, k if open_ else None, t if open_ else None, False))
            if rows:
                yield made(rows)
        if last:
            yield made([(doc_id, None, None, key, t, True) for t, doc_id in last])

    return run


def failures(docs: DataFrame, part: str = "source", filters: dict[str, Filter] | None = None) -> DataFrame:
    """(doc_id, part, mask) for every row of docs: bit i of mask is the i-th filter's failure, the last bit that of duplicates."""
    filters = list((FILTERS if filters is None else filters).values())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    given = given.select(F.xxhash64("text").alias("key"), "text", "doc_id", "part")
    ranged = given.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "text", "doc_id")
    found = staged(ranged.mapInArrow(_pass(filters), FOUND), "audit")
    before = found.where("ends").groupBy(F.col("key").alias("k"), F.col("text").alias("t")).agg(F.min("doc_id").alias("first"))
    open_ = found.where("not ends and key is not null")
    again = F.when(F.col("first") < F.col("doc_id"), 1 << len(filters)).otherwise(0)
    closed = open_.join(before, (F.col("key") == F.col("k")) & (F.col("text") == F.col("t")), "left")
    closed = closed.select("doc_id", "part", F.col("mask").bitwiseOR(again).alias("mask"))
    return found.where("not ends and key is null").select("doc_id", "part", "mask").unionByName(closed)


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): numbers of documents, and of those with a label; masks are read twice."""
    zero = F.lit(0).cast("long")
    every = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    given = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    given = given.agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    marked = masks.join(given, "doc_id").groupBy("part", "mask").agg(zero.alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return every.unionByName(marked).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def steps_of(letters: str) -> Iterable[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before it, its own bit) of every order of the filters."""
    for order in map("".join, permutations(letters)):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << letters.index(letter)
            yield order, step, before, own
            before |= own


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order and step from (part, mask, n, good, toxic); a part has 2^len(letters) cells at most."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = ", ".join(f"struct('{o}' as filter_order, {s} as step, {b} as before, {own} as own)" for o, s, b, own in steps_of(letters))
    orders = 1
    for i in range(2, len(letters) + 1):
        orders *= i

    def total(what: str, condition: str) -> Column:
        return F.expr(f"aggregate(cells, 0L, (s, c) -> s + if({condition}, {what}, 0L))")

    fails, passed = "c.mask & step.own <> 0", "c.mask & step.before = 0"
    # among the orders each filter that a document fails is the first of them equally often
    share = f"c.n * {orders} div bit_count(c.mask)"
    return parts.select("part", "cells", F.explode(F.expr(f"array({steps})")).alias("step")).select(
        "part",
        "step.filter_order",
        "step.step",
        total("c.n", f"c.mask & (step.before | step.own) = 0").alias("kept"),
        total("c.n", f"{fails} and {passed}").alias("removed"),
        total("c.n", f"{fails} and not ({passed})").alias("redundant"),
        total("c.n", "c.mask = step.own").alias("unique_fails"),
        total("c.good", f"{fails} and {passed}").alias("good_lost"),
        total("c.toxic", f"{fails} and {passed}").alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame, part: str = "source", filters: dict[str, Filter] | None = None) -> DataFrame:
    """What each filter removes, repeats and loses, by part, in every order of the filters and that of duplicates."""
    letters = "".join(FILTERS if filters is None else filters) + DUPLICATE
    return interactions(counters(failures(docs, part, filters), labels), letters)
