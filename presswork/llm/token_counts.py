"""Edit-aware token counts (operator 5).

`index` encodes every document once and keeps a segment tree over its
pre-tokens: leaves are runs of LEAF pre-tokens, a node holds the characters,
pre-tokens and tokens below it, and the root the document's count. `apply`
takes edits (replace `removed` characters from `start` by `inserted`), descends
the tree to the leaves that an edit touches, re-encodes from a leaf's start
before the edit until a boundary meets an old leaf's end after it, puts what it
found in the first of these leaves (the others become empty) and updates the
sums on the way to the root. A pre-token depends on what follows it by no more
than the next two pre-tokens, so re-encoding begins at least two pre-tokens
ahead of the edit.

Characters are code points. Edits of a document are applied in the order of
`edit_no`, each to the text that the one before it left; places beyond the text
are moved to its end. Equal edits are applied each. Null texts count as empty,
a null `inserted` as nothing, null numbers as 0. Rows without doc_id take no
part. Rows with one doc_id are documents of their own: each gets the edits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 32
CACHE = 500_000
TREE = "chars array<int>, pres array<int>, tokens array<int>"
CONTEXT = 2


class Counter(dict):
    """pre-token -> its number of tokens, remembered up to CACHE pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import base64

        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(pattern)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = n = len(self.encode(word))
        return n


class Tree:
    """Sums of characters, pre-tokens and tokens over leaves; row 1 is the root, leaves begin at row `width`."""

    def __init__(self, leaves):
        import numpy as np

        n = max(1, len(leaves))
        self.width = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        self.sums[self.width : self.width + len(leaves)] = leaves
        at = self.width
        while at > 1:
            half = at // 2
            self.sums[half:at] = self.sums[at : 2 * at : 2] + self.sums[at + 1 : 2 * at : 2]
            at = half

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at `place` (the last one with any, at the end), and where it starts."""
        node, start = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            if place - start < left or not self.sums[2 * node + 1, 0]:
                node = 2 * node
            else:
                node, start = 2 * node + 1, start + left
        return node - self.width, start

    def put(self, leaf: int, values) -> None:
        node = leaf + self.width
        gone = self.sums[node].copy()
        while node:
            self.sums[node] += values - gone
            node //= 2

    def leaves(self):
        return self.sums[self.width :]


def leaves_of(text: str, counter: Counter):
    """(characters, pre-tokens, tokens) of each run of LEAF pre-tokens."""
    import numpy as np

    words = counter.split.findall(text)
    if not words:
        return np.zeros((0, 3), np.int64)
    n = len(words)
    starts = np.arange(0, n, LEAF)
    chars = np.add.reduceat(np.fromiter(map(len, words), np.int64, n), starts)
    tokens = np.add.reduceat(np.fromiter(map(counter.__getitem__, words), np.int64, n), starts)
    return np.stack([chars, np.diff(np.append(starts, n)), tokens], axis=1)


def edited(text: str, tree: Tree, start: int, removed: int, inserted: str, counter: Counter) -> tuple[str, int]:
    """The text after an edit, and how many pre-tokens were encoded; the tree is brought up to date."""
    import numpy as np

    start = min(max(0, start), len(text))
    removed = min(max(0, removed), len(text) - start)
    after = text[:start] + inserted + text[start + removed :]
    moved = len(inserted) - removed
    first, begin = tree.leaf_at(start)
    before = 0
    while first and before < CONTEXT:  # whole leaves ahead of the edit, until they hold the context
        first -= 1
        begin -= int(tree.sums[tree.width + first, 0])
        before += int(tree.sums[tree.width + first, 1])
    last, at = tree.leaf_at(start + removed)
    end = at + int(tree.sums[tree.width + last, 0])  # in the old text; the first boundary to meet
    pres = tokens = 0
    place = begin
    for m in counter.split.finditer(after, begin):
        while end + moved < place and last + 1 < tree.width:
            last += 1
            end += int(tree.sums[tree.width + last, 0])
        if place == end + moved and end >= start + removed and place > begin:
            break
        pres, tokens, place = pres + 1, tokens + counter[m.group()], m.end()
    else:
        last = tree.width - 1
    tree.put(first, np.array([place - begin, pres, tokens]))
    for leaf in range(first + 1, last + 1):
        if tree.sums[tree.width + leaf, 0] or tree.sums[tree.width + leaf, 1]:
            tree.put(leaf, np.zeros(3, np.int64))
    return after, pres


def index(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text, chars, pres, tokens): each document with the leaves of its tree."""

    def build(batches):
        import pyarrow as pa

        counter = Counter(ranks_path, pattern)
        ints = pa.list_(pa.int32())
        for batch in batches:
            found = [leaves_of(t or "", counter).astype("int32") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[:, k] for x in found], ints) for k in range(3))], names=["doc_id", "text", "chars", "pres", "tokens"])

    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(build, f"doc_id long, text string, {TREE}")


def apply(indexed: DataFrame, edits: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, new_tokens, new_chars, encoded, text, chars, pres, tokens) after the edits of each document.

    indexed: as `index` gives, with a further column `edits`, an array of
    (edit_no, start, removed, inserted), or without it and edits as a table
    (doc_id, edit_no, start, removed, inserted).
    """
    if edits is not None:
        by_doc = edits.groupBy(F.col("doc_id").alias("edit_doc")).agg(F.collect_list(F.struct("edit_no", "start", "removed", "inserted")).alias("edits"))
        indexed = indexed.join(by_doc, F.col("doc_id") == F.col("edit_doc"), "left").drop("edit_doc")

    def change(batches):
        import numpy as np
        import pyarrow as pa

        counter = Counter(ranks_path, pattern)
        ints = pa.list_(pa.int32())
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            for doc_id, text, chars, pres, tokens, todo in zip(*(batch.column(i).to_pylist() for i in range(6))):
                tree = Tree(np.array([chars, pres, tokens], np.int64).T)
                was, encoded = int(tree.sums[1, 2]), 0
                for e in sorted(todo or [], key=lambda e: (e["edit_no"] or 0, e["start"] or 0, e["removed"] or 0, e["inserted"] or "")):
                    text, n = edited(text, tree, e["start"] or 0, e["removed"] or 0, e["inserted"] or "", counter)
                    encoded += n
                leaves = tree.leaves().astype("int32")
                for c, v in zip(rows, (doc_id, was, int(tree.sums[1, 2]), len(text), encoded, text, leaves[:, 0], leaves[:, 1], leaves[:, 2])):
                    c.append(v)
            kinds = (pa.int64(),) * 5 + (pa.string(),) + (ints,) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "n_tokens", "new_tokens", "new_chars", "encoded", "text", "chars", "pres", "tokens"])

    return indexed.select("doc_id", "text", "chars", "pres", "tokens", "edits").mapInArrow(change, f"doc_id long, n_tokens long, new_tokens long, new_chars long, encoded long, text string, {TREE}")
