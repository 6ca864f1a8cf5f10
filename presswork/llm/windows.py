"""Order-preserving packing by dynamic programming (operator 12).

The documents of an input partition, in the order of their ids, are one stream
of tokens, and windows are cut from it in order: nothing is moved and nothing
is shuffled. A cut costs nothing after a document, SENTENCE after a sentence
and MIDDLE elsewhere (only stretches without an end of a sentence for GAP
tokens have such places, every STEP tokens). A window costs its padding: none
where its length is a power of two, else what is left of the capacity. The cuts
of least total cost come from

    best(x) = cut(x) + min(best(x - 2^p), min over the last `capacity` tokens of best(y) + y + capacity - x)

whose second minimum a monotone queue keeps, so that a place costs a few steps
however many places the capacity spans.

A task holds SEGMENT tokens at a time (or one document, if that is longer): all
but the last windows of a segment are final, and the next segment goes on from
the last cut that is. Only the end of a partition ends a window for good.

Null texts count as empty (the end id alone); rows without doc_id take no
part; repeated rows are packed once each; an empty table gives no rows. Of
equal costs one and the same is chosen always, so equal partitions give equal rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Sequence

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import texts_as_bytes
from .packing import CHUNK_CACHE, ChunkIds, chunks_of

#: costs of a cut, in tokens of padding
SENTENCE, MIDDLE = 16, 32
GAP, STEP = 128, 64
#: the least power of two that is chosen for its length
SHORTEST = 64
SEGMENT = 1 << 20
#: windows at the end of a segment that are cut anew with the next
OPEN = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: a chunk that ends a sentence, closing quotes and brackets aside
ENDS = re.compile(rb"(?:[.!?]|\xe2\x80\xa6|\xe3\x80\x82)(?:[\"')\]]|\xe2\x80[\x99\x9d]|\xc2\xbb)*$")


class SentenceIds(ChunkIds):
    """Ids of documents, and the places in them at which a sentence ends."""

    def clear(self) -> None:
        super().clear()
        self.ends = array("b")

    def __missing__(self, chunk: bytes) -> int:
        n = super().__missing__(chunk)
        self.ends.append(ENDS.search(chunk) is not None)
        return n

    def encode(self, texts: list[list[bytes]]):
        """For each list of chunks its ids, as arrays of uint32, and the numbers of ids up to the ends of sentences."""
        import numpy as np

        if len(self) > CHUNK_CACHE:
            self.clear()
        coded = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]
        at, size, flat, ends = np.array(self.at), np.array(self.size), np.array(self.flat, np.uint32), np.array(self.ends, bool)
        for codes in coded:
            n = size[codes]
            total = np.cumsum(n)
            yield flat[np.repeat(at[codes] - total + n, n) + np.arange(total[-1] if len(total) else 0)], total[ends[codes]]


def cuts(places: Sequence[int], costs: Sequence[int], capacity: int, shortest: int = SHORTEST) -> list[int]:
    """The places at which windows end, the last one included, so that padding and cuts cost least.

    places rise, the first is after 0 and none is more than capacity after the
    one before; costs are those of a cut at each. A power of two below
    `shortest` saves no padding here.
    """
    powers = [1 << p for p in range(capacity.bit_length() - 1, -1, -1) if shortest <= 1 << p <= capacity]
    never = float("inf")
    best: list[float] = [never] * (capacity + places[-1] + 1)  # by place + capacity
    came: dict[int, int] = {}
    best[capacity] = 0
    queue = deque([(0, 0)])  # (best + place, place), rising in both
    first = queue[0]
    for x, cost in zip(places, costs):
        while first[1] < x - capacity:
            queue.popleft()
            first = queue[0]
        o = x + capacity
        least, source = first[0] + capacity - x, first[1]
        for p in powers:
            if best[o - p] < least:
                least, source = best[o - p], x - p
        least += cost
        best[o], came[x] = least, source
        least += x
        while queue and queue[-1][0] > least:
            queue.pop()
        queue.append((least, x))
        first = queue[0]
    out, x = [], places[-1]
    while x:
        out.append(x)
        x = came[x]
    return out[::-1]


def filled(places, costs, cost: int = MIDDLE, gap: int = GAP, step: int = STEP):
    """places and costs with a place every `step` tokens in stretches of more than `gap` without one."""
    import numpy as np

    before = np.append(0, places[:-1])
    wide = np.flatnonzero(places - before > gap)
    if not len(wide):
        return places, costs
    more = np.concatenate([np.arange(before[i] + step, places[i], step) for i in wide])
    at = np.searchsorted(places, more)
    return np.insert(places, at, more), np.insert(costs, at, cost)


class Stream:
    """Documents in order -> pieces. Tokens before the last final cut are dropped."""

    def __init__(self, capacity: int, first_sequence: int, sentence: int = SENTENCE, middle: int = MIDDLE):
        self.capacity, self.sequence, self.sentence, self.middle = capacity, first_sequence, sentence, middle
        self.docs: list[tuple[int, int, int]] = []  # id, place of its first token (below 0 if it is cut already), tokens
        self.ids: list = []
        self.places: list = []
        self.costs: list = []
        self.size = 0

    def add(self, doc_id: int, ids, ends) -> None:
        import numpy as np

        places = np.append(ends[ends < len(ids) - 1], len(ids)) + self.size
        places = places[np.flatnonzero(np.diff(places, prepend=self.size))]  # chunks without ids end where others do
        costs = np.full(len(places), self.sentence)
        costs[-1] = 0
        self.docs.append((doc_id, self.size, len(ids)))
        self.ids.append(ids)
        self.places.append(places)
        self.costs.append(costs)
        self.size += len(ids)

    def pieces(self, last: bool):
        """Columns of the pieces of the windows that are final."""
        import numpy as np

        if not self.docs:
            return None
        places, costs = np.concatenate(self.places), np.concatenate(self.costs)
        full = filled(places, costs, self.middle, min(GAP, self.capacity), min(STEP, self.capacity))
        ends = np.array(cuts(full[0].tolist(), full[1].tolist(), self.capacity))
        if not last:
            ends = ends[:-OPEN]
            if not len(ends):
                return None
        end = int(ends[-1])
        flat = np.concatenate(self.ids).astype("<u4")
        starts = np.array([d[1] for d in self.docs])
        first = np.append(0, ends[:-1])
        at = np.union1d(np.maximum(starts, 0), first)
        at = at[at < end]
        length = np.diff(np.append(at, end))
        doc, window = np.searchsorted(starts, at, "right") - 1, np.searchsorted(first, at, "right") - 1
        data = memoryview(flat).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
        out = [np.array([d[0] for d in self.docs])[doc], at - starts[doc], length, np.array(crc), np.array([d[2] for d in self.docs])[doc], self.sequence + window, at - first[window]]
        self.sequence += len(ends)
        left = [(i, a - end, n) for i, a, n in self.docs if a + n > end]
        keep = places > end
        self.docs, self.ids, self.size = left, [flat[end:].copy()], self.size - end
        self.places, self.costs = [places[keep] - end], [costs[keep]]
        return out


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, sentence: int = SENTENCE, middle: int = MIDDLE, segment: int = SEGMENT) -> DataFrame:
    """A row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = SentenceIds(tokenizer_path)
        stream = Stream(capacity, TaskContext.get().partitionId() << 40, sentence, middle)
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def made(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))
            for a in range(0, len(texts), 512):
                for doc_id, (ids, ends) in zip(doc_ids[a:], encoder.encode([chunks_of(t) for t in texts[a : a + 512]])):
                    stream.add(doc_id, np.append(ids, np.uint32(end_id)), ends)
                    if stream.size >= segment and (out := stream.pieces(False)):
                        yield made(out)
        if out := stream.pieces(True):
            yield made(out)

    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)
