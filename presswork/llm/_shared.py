"""Staged tables in the shared folder, and word helpers used inside tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

WORD_CACHE = 400_000
#: Spark's own setting: shuffle files of a query go when it ends, not when the driver next collects its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a folder of one's own is used on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="presswork-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and survives lost executors. The shuffles that led to the table go once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def measured(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, int, dict]:
    """df staged, its number of rows, and other aggregates of it, taken while it is written."""
    seen = Observation()
    out = staged(df.observe(seen, F.count(F.lit(1)).alias("n"), *measures), name)
    found = seen.get  # nothing where the plan turned out empty
    return out, found.get("n") or 0, found


def unstage(df: DataFrame | None) -> None:
    """Removes the table of a staged df that nothing reads any more."""
    path = vars(df).get("staged_path") if df is not None else None
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


class WordHashes(dict):
    """word -> unsigned 64-bit hash, remembered up to WORD_CACHE words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x):
    """splitmix64's finaliser over an array of uint64."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes, k: int = 5):
    """Hashes of the k-word shingles of a document, in order; with fewer words the whole sequence is one."""
    import numpy as np

    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - width + 1 + j]
    return mixed(out)


def word_hashes(words: list[bytes], cache: WordHashes):
    import numpy as np

    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def short_hashes(data: bytes, starts, size: int):
    """xxh64 of the words of `size` bytes, under 32 of them, that begin at `starts` of data, which goes on for 8 bytes after them."""
    import numpy as np

    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, n):
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def read(kind, width):  # little-endian numbers from any byte on
        return np.ndarray((len(data) - width + 1,), kind, data, strides=(1,))[at].astype(np.uint64)

    at, h = starts.copy(), np.full(len(starts), p5 + np.uint64(size))
    for _ in range(size // 8):
        h = turned(h ^ (turned(read("<u8", 8) * p2, 31) * p1), 27) * p1 + p4
        at += 8
    if size & 4:
        h = turned(h ^ (read("<u4", 4) * p1), 23) * p2 + p3
        at += 4
    for _ in range(size & 3):
        h = turned(h ^ (read("u1", 1) * p5), 11) * p1
        at += 1
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def hashes_of_texts(texts: list[bytes | None], cache: WordHashes):
    """`word_hashes` of the words of all texts in one array, and the number of words of each text: words of one length are hashed at once, those of 32 bytes or more by the cache."""
    import numpy as np

    data = b"\n".join([*(t or b"" for t in texts), b" " * 8]).lower()
    raw = np.frombuffer(data, np.uint8)
    inside = np.append(False, (raw != 32) & ((raw < 9) | (raw > 13)))  # bytes.split's white space
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    kinds = np.minimum(lengths, 32).astype(np.uint8)
    order = np.argsort(kinds, kind="stable")
    ends = np.searchsorted(kinds[order], np.arange(34))
    out = np.empty(len(starts), np.uint64)
    for size in range(1, 32):
        mine = order[ends[size] : ends[size + 1]]
        if len(mine):
            out[mine] = short_hashes(data, starts[mine], size)
    for i in order[ends[32] :].tolist():
        out[i] = cache[data[starts[i] : starts[i] + lengths[i]]]
    begins = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return out, np.diff(np.searchsorted(starts, begins))


def texts_as_bytes(column) -> list[bytes | None]:
    """An Arrow string column's values as UTF-8 bytes, without decoding them."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
