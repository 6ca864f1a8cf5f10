"""Best-fit packing by sum of squares (operator 8).

`pieces` tokenizes whole documents in Arrow batches and cuts only documents
longer than the capacity. `packed` deals the pieces over shards of a bounded
number of pieces by a hash of the document, so that no task grows with the
input, and packs each shard by the sum-of-squares rule: a piece goes to the
residual gap (or to a new sequence) after which the sum over gaps of squared
counts of open sequences is smallest. At the end of a shard its least full
sequences are taken apart and their pieces put where they fit best, as long as
that saves sequences and there are more than the tokens need. A shard holds
PIECES_PER_SHARD pieces on average.

Null texts count as empty (the end id alone); rows without doc_id take no
part; repeated rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import staged, texts_as_bytes

PIECES_PER_SHARD = 16384
CHUNK_CACHE = 1_000_000
MARKS = b".,;:"
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


def chunks_of(text: bytes | None) -> list[bytes]:
    """Chunks between ASCII white space, lower-cased (as the tokenizer would) unless the text may spell a special token."""
    if not text:
        return []
    return (text if b"<|" in text else text.lower()).split()


class ChunkIds(dict):
    """Ids of documents by a vocabulary in which white space only separates.

    Each distinct chunk between ASCII white space is encoded once and
    remembered; a document's ids are gathered from a flat table.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        # how the byte-level step writes each byte of a UTF-8 sequence
        two = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: two.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x180)}
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.flat, self.at, self.size = array("I"), array("q"), array("q")

    def __missing__(self, chunk: bytes) -> int:
        if chunk.isalpha():  # ASCII letters
            ids = [t.id for t in self.tokenize(chunk.decode().lower())]
        elif chunk[-1] in MARKS and chunk[:-1].isalpha():
            ids = self.of(chunk[:-1]) + self.of(chunk[-1:])
        else:
            word = chunk.decode()
            if chunk[-1] in MARKS and self.latin(word[:-1]):
                ids = self.of(chunk[:-1]) + self.of(chunk[-1:])
            elif self.latin(word):
                ids = [t.id for t in self.tokenize(word.lower().translate(self.letters))]
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        self[chunk] = n = len(self.at)
        self.at.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        return n

    @staticmethod
    def latin(word: str) -> bool:
        """Words that go to the merges at once: no other step of the tokenizer changes them but for case."""
        return word.isalpha() and max(word) < "\u0180" and "\u0130" not in word

    def of(self, chunk: bytes) -> array:
        code = self[chunk]
        return self.flat[self.at[code] : self.at[code] + self.size[code]]

    def encode(self, texts: list[list[bytes]]):
        """For each list of chunks its ids, as arrays of uint32."""
        import numpy as np

        if len(self) > CHUNK_CACHE:
            self.clear()
        coded = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]
        at, size, flat = np.array(self.at), np.array(self.size), np.array(self.flat, np.uint32)
        for codes in coded:
            n = size[codes]
            ends = np.cumsum(n)
            yield flat[np.repeat(at[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        encoder = ChunkIds(tokenizer_path)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))
            for a in range(0, len(texts), 512):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[a:], encoder.encode([chunks_of(t) for t in texts[a : a + 512]])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE_SCHEMA)


def sum_of_squares(sizes, capacity: int):
    """Bin and offset of each size, in the given order, by the sum-of-squares rule; a tie goes to the smallest gap left."""
    import numpy as np

    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(map(int, sizes)):
        # by the gap left, 0 .. capacity - s: what the sum of squares grows by
        grown = 2 * count[: capacity - s + 1] + 1
        grown[0] = 0  # a full bin is not open
        grown[:-1] += 1 - 2 * count[s:capacity]
        grown[:-1][count[s:capacity] == 0] = capacity * len(sizes)
        left = int(grown.argmin())
        if left == capacity - s:
            b, made = made, made + 1
        else:
            b = open_bins[left + s].pop()
            count[left + s] -= 1
        bins[i], offsets[i] = b, capacity - left - s
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return bins, offsets


def fewer(sizes, bins, capacity: int):
    """bins after taking apart the least full ones: their pieces, the largest first, go to the smallest gap that holds them."""
    import bisect

    import numpy as np

    while True:
        fill = np.bincount(bins, sizes, minlength=1).astype(np.int64)
        used = np.flatnonzero(fill)
        spare = len(used) - -(-int(fill.sum()) // capacity)
        if spare <= 0:
            return bins
        apart = used[np.argsort(fill[used], kind="stable")][: 8 * spare + 16]
        loose = np.flatnonzero(np.isin(bins, apart))
        loose = loose[np.argsort(-sizes[loose], kind="stable")]
        fill[apart] = 0
        kept = used[~np.isin(used, apart) & (fill[used] < capacity)]
        gaps = sorted(zip((capacity - fill[kept]).tolist(), kept.tolist()))
        new, fresh = bins.copy(), apart.tolist()
        for i in loose.tolist():
            s = int(sizes[i])
            k = bisect.bisect_left(gaps, (s, -1))
            gap, b = gaps.pop(k) if k < len(gaps) else (capacity, fresh.pop()) if fresh else (0, -1)
            if b < 0:  # more sequences than before
                return bins
            new[i] = b
            if gap > s:
                bisect.insort(gaps, (gap - s, b))
        if not fresh:
            return bins
        bins = new


def offsets_of(sizes, bins):
    """Places one after another within each bin, in the given order."""
    import numpy as np

    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    out = np.empty(len(sizes), np.int64)
    out[order] = starts - np.repeat(starts[first], np.diff(np.append(first, len(order))))
    return out


def packed(parts: DataFrame, capacity: int = 2048, per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    shards = max(1, -(-parts.count() // per_shard))

    def pack(frame):
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = frame["length"].to_numpy()
        bins, _ = sum_of_squares(sizes, capacity)
        bins = fewer(sizes, bins, capacity)
        offsets = offsets_of(sizes, bins)
        shard = int(frame["shard"].iloc[0])
        return frame.drop(columns="shard").assign(sequence_id=bins * shards + shard, offset=offsets)

    shard = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(shards))
    return parts.withColumn("shard", shard).groupBy("shard").applyInPandas(pack, PACKED_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Every document in sequences of at most `capacity` tokens; the pieces are staged, being read twice."""
    return packed(staged(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
