"""Ordinal quality classifier (operator 9): cumulative-link regression on graded ratings.

A document's features are hashed: each distinct word (A-Z lower-cased, outer
punctuation off) once, and the shares of words of each shape (capitals, marks
inside, repeats of the word before, ...). One weight vector is shared by all
grades; ordered thresholds t_1 < t_2 < ... give
P(grade >= k) = 1 / (1 + exp(t_k - w x)), hence the expected grade and the tail
probability by which documents are selected.

`fit` learns from at most max_rows labelled documents (a documented bound,
taken by a hash of the id), by rounds of local training and averaging: each
round every part of the staged features starts from the shared state and makes
one pass of FTRL-proximal, whose L1 term keeps the weights of words that tell
nothing at 0; the states are averaged, by rows, and only their mean (2^BITS
pairs of floats) reaches the driver, never documents. `scored`
covers every document.

Null texts are empty documents: their score is the model's for no features.
Labels without a document, and null ratings, take no part in fitting; repeated
labels of a document count by the smallest grade; without any labelled rows
every weight is 0. Rows without doc_id are not scored, but stay in `selected`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD_CACHE, staged, texts_as_bytes

BITS = 18
MAX_ROWS = 20_000
ROUNDS = 5
PARTS = 4
TAIL = 0.5
#: FTRL's step and penalties
ALPHA, L1, L2 = 0.3, 4.0, 1.0

#: Outer marks that are no part of a word, and what counts as its plain inside.
OUTER = b".,;:!?()\"'"


class Features(dict):
    """raw word -> (bucket << 3) | shape, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        core = word.strip(OUTER)
        text = core.decode()
        if not core:
            shape = 1
        elif not text.isalpha():
            shape = 2 if text.isalnum() else 3
        elif len(text) > 1 and text.isupper():
            shape = 4
        else:
            shape = 0
        if len(word) - len(core) > 1 and shape in (0, 4):
            shape = 5 if shape == 0 else 6
        self[word] = v = (xxhash.xxh64_intdigest(core.lower()) & ((1 << BITS) - 1)) << 3 | shape
        return v


#: shapes 1 .. 7 (7: repeats of the word before) and a constant follow the hashed words
SHAPES = 8


def features(text: bytes | None, cache: Features):
    """(indices, values): distinct words, damped in long documents; shares of shapes."""
    import numpy as np

    words = text.split() if text else []
    codes = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    buckets = np.unique(codes >> 3)
    n = max(1, len(codes))
    shares = np.bincount(codes & 7, minlength=SHAPES)[1:] / n
    shares[6] = np.count_nonzero(codes[1:] == codes[:-1]) / n
    values = np.concatenate([np.full(len(buckets), min(1.0, (50 / max(1, len(buckets))) ** 0.5)), 4 * np.sqrt(shares), [1.0]])
    return np.concatenate([buckets, (1 << BITS) + np.arange(SHAPES)]), values


class Model:
    """w: 2^BITS + SHAPES weights; t: ordered thresholds."""

    def __init__(self, w, t):
        self.w, self.t = w, t

    def tails(self, z):
        """P(grade >= k) for k = 1 .. as columns."""
        import numpy as np

        return 1 / (1 + np.exp(np.clip(self.t[None, :] - np.asarray(z)[:, None], -40, 40)))


def weights_of(z, n, idx=slice(None)):
    """FTRL's weights from its sums of gradients z and of their squares n; shapes and the constant bear no L1."""
    import numpy as np

    zi = z[idx]
    l1 = np.where(np.arange(len(z))[idx] < 1 << BITS, L1, 0.0)
    return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((1 + np.sqrt(n[idx])) / ALPHA + L2))


def _pass(rows, z, n, t, t_n, grades: int):
    """One pass over (indices, values, grade, weight) rows, in place."""
    import numpy as np

    sig = lambda x: 1 / (1 + np.exp(-min(40.0, max(-40.0, x))))
    for idx, val, y, weight in rows:
        w, ni = weights_of(z, n, idx), n[idx]
        s = float(w @ val)
        # P(y) = F(s - t_y) - F(s - t_{y+1}); the slopes of its log by s and by both thresholds
        up = sig(s - t[y - 1]) if y > 0 else 1.0
        down = sig(s - t[y]) if y < grades - 1 else 0.0
        g = -weight * (1 - up - down) * val
        z[idx] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
        n[idx] += g * g
        p = max(up - down, 1e-6)
        for k, d in ((y - 1, up * (1 - up) / p), (y, -down * (1 - down) / p)):
            if 0 <= k < grades - 1:
                d *= weight
                t_n[k] += d * d
                t[k] -= 0.1 * d / np.sqrt(t_n[k] + 1e-8)
        t.sort()


def fit(docs: DataFrame, ratings: DataFrame, grades: int, max_rows: int = MAX_ROWS, rounds: int = ROUNDS) -> Model:
    """ratings: (doc_id, grade int from 0)."""
    import numpy as np

    size = (1 << BITS) + SHAPES
    state = [np.zeros(size), np.zeros(size), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(1), np.zeros(grades - 1)]
    order = F.xxhash64(F.lit(9), "doc_id")
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    rated = rated.orderBy(order, "doc_id").limit(max_rows)

    def extract(batches):
        import numpy as np
        import pyarrow as pa

        cache = Features()
        for batch in batches:
            found = [features(x, cache) for x in texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))],
                names=["doc_id", "grade", "idx", "val"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(rated, "doc_id").select("doc_id", "text", "grade")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    rows = staged(rows.mapInArrow(extract, "doc_id long, grade int, idx array<int>, val array<float>").withColumn("part", part), "features")
    counts = dict(rows.groupBy("grade").count().collect())
    total = sum(counts.values())
    weights = {g: (total / (len(counts) * n)) ** 0.5 for g, n in counts.items()}

    def trainer(shared):
        def train(table):
            import pyarrow as pa

            state = [x.copy() for x in shared.value]
            table = table.sort_by("doc_id")
            flat, values = (table.column(c).combine_chunks() for c in ("idx", "val"))
            ends, idx, val = flat.offsets.to_numpy(), flat.values.to_numpy(), values.values.to_numpy().astype(float)
            grade = table.column("grade").to_pylist()
            _pass(((idx[a:b], val[a:b], y, weights[y]) for a, b, y in zip(ends, ends[1:], grade)), *state, grades)
            return pa.table({"n": [len(grade)], "state": [[x.tobytes() for x in state]]})

        return train

    def average(table):
        import numpy as np
        import pyarrow as pa

        sizes, states = table.column("n").to_pylist(), table.column("state")
        n = sum(sizes)
        mean = [sum(np.frombuffer(states[i][k].as_py()) * (size / n) for i, size in enumerate(sizes)) for k in range(4)]
        return pa.table({"n": [n], "state": [[x.tobytes() for x in mean]]})

    for _ in range(rounds if counts else 0):
        shared = docs.sparkSession.sparkContext.broadcast(state)
        trained = rows.groupBy("part").applyInArrow(trainer(shared), "n long, state array<binary>")
        # PARTS rows meet in one task, and the driver gets their mean alone
        mean = trained.withColumn("whole", F.lit(0)).groupBy("whole").applyInArrow(average, "n long, state array<binary>").first()
        state = [np.frombuffer(x) for x in mean.state]
        shared.destroy()
    return Model(weights_of(state[0], state[1]), np.sort(state[2]))


def scored(docs: DataFrame, model: Model, grades: int) -> DataFrame:
    """(doc_id, expected_grade, p_best): the tail probability is that of the highest grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import numpy as np
        import pyarrow as pa

        cache, model = Features(), shared.value
        for batch in batches:
            z = np.empty(batch.num_rows)
            for i, text in enumerate(texts_as_bytes(batch.column(1))):
                idx, val = features(text, cache)
                z[i] = model.w[idx] @ val
            tails = model.tails(z)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], names=["doc_id", "expected_grade", "p_best"])

    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(score, "doc_id long, expected_grade double, p_best double")


def grade_of(quality: Column, toxic: Column) -> Column:
    """Graded rating of a label: 0 low quality, 1 sound but toxic, 2 sound."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).when((quality == 1) & (toxic == 0), 2)


def selected(docs: DataFrame, model: Model, grades: int, tail: float = TAIL) -> DataFrame:
    """Documents whose tail probability reaches `tail`; rows without an id stay, and of a repeated id all rows go if any of them is below."""
    gone = scored(docs, model, grades).where(F.col("p_best") < tail).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
