"""Gated recurrent language model in numpy, and scores of whole documents (operator 10).

Tokens are words, A-Z lower-cased, and one end for each document. Counts of all
training tokens are grouped and summed by Spark. Words of a count of LEAST or
more, the MOST most frequent of them at most, are outputs of their own; all
others share outputs by a hash, one for every PER_BUCKET of them up to BUCKETS,
in which a word's probability is that of its count. Outputs are dealt by
frequency into about the square root of their number of classes, of equal size.
So P(token | history) = P(class | h) * P(output | class, h) * P(token | output),
the first two softmaxes, the last a share of counts, and it sums to one over the
training vocabulary and one unknown word for each shared output. Inputs have an
embedding for each output, so a rare word's hash reaches the state too.

Training is truncated backpropagation through time: the training documents of a
part are laid end to end and cut into at most LANES lanes of one length, windows of WINDOW
tokens follow each other with the state carried from one to the next, and Adam
takes a step for each. There is a part for every PART_TOKENS training tokens, so a task
holds about that many ids and the longest document, however long documents are.
The parts are dealt over ROUNDS rounds, and every training document is in
one of them. A part starts from the parameters of its round; its results are
averaged on executors, slice by slice of the parameters and in a tree, FAN of them at a
time, so that no task holds more of them and the driver gets
one set of them a round; the next round starts from there. The biases begin
at the logarithms of the counts, so the model begins as the unigram one.

Scores run every document whole: documents of a batch are laid end to end in lanes, the
state is carried across the windows of a document and starts anew with the next one.
Rare words' counts are joined from the table of counts; no vocabulary is ever
broadcast but the HEAD most frequent words of at most HEAD_BYTES bytes.

Null texts are empty: the end alone. Rows without doc_id take no part. Equal
rows are trained on and scored each. Without training documents all scores are
those of the unknown word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import staged, texts_as_bytes, words_of

#: SHORTLIST is the least number of places for words of their own, filled or not
SHORTLIST, LEAST, MOST = 1024, 20, 16_384
PER_BUCKET, BUCKETS = 64, 4096
HEAD, HEAD_BYTES = 100_000, 48
HIDDEN, LANES, WINDOW = 24, 256, 32
SCORE_LANES = 512
TRAIN_EVERY = 1
STEPS_AT_LEAST = 256
PART_TOKENS, ROUNDS, SLICE, FAN = 4_000_000, 2, 4096, 64
STEP, CLIP = 0.01, 5.0
END = b" "  # no word holds a space
COUNT_CACHE = 300_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0


def _words(text: bytes | None) -> list[bytes]:
    return [*words_of(text), END]


def counted(docs: DataFrame) -> DataFrame:
    """(word binary, c long) over all the documents, with partial sums ahead of the shuffle."""

    def count(batches):
        from collections import Counter

        schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

        def rows(sums):
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], schema=schema)

        sums: Counter = Counter()
        for batch in batches:
            for text in texts_as_bytes(batch.column(0)):
                sums.update(_words(text))
                if len(sums) > COUNT_CACHE:
                    yield rows(sums)
                    sums.clear()
        yield rows(sums)

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame) -> DataFrame:
    """At most HEAD words of at most HEAD_BYTES bytes, and the end: all whose count is over a bound.

    The bound is read off a histogram of counts in steps of two per cent (some
    thousand rows), so that tasks send the driver the chosen words alone and
    not a candidate list each.
    """
    step = F.floor(F.ln("c") * 50)
    sized = counts.where((F.length("word") <= HEAD_BYTES) & (F.col("word") != END))
    least, total = None, 0
    for s, n in sorted(sized.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        total += n
        if total >= HEAD:
            break
        least = s
    over = F.lit(False) if least is None else (F.length("word") <= HEAD_BYTES) & (step >= least)
    return counts.where(over | (F.col("word") == END))


class Ids(dict):
    """word -> output; words without one of their own share one of `buckets` from `size` on."""

    size, buckets = SHORTLIST, 1

    def __missing__(self, word: bytes) -> int:
        import zlib

        return self.size + zlib.crc32(word) % self.buckets


class Vocabulary:
    """Outputs of the frequent words and of the shared ones, counts of the head, and sums over the training tokens."""

    def __init__(self, head: list[tuple[bytes, int]], tokens: int, types: int):
        self.counts = dict(head)
        self.short = [w for i, (w, c) in enumerate(head) if i < SHORTLIST or (i < MOST and c >= LEAST)]
        if head and END not in self.short:
            self.short[-1] = END
        self.tokens, self.types = tokens, types
        self.ids = Ids({w: i for i, w in enumerate(self.short)})
        self.size = self.ids.size = max(SHORTLIST, len(self.short))
        rare = max(0, types - len(self.short))
        self.buckets = self.ids.buckets = max(1, min(BUCKETS, rare // PER_BUCKET))
        self.known = sum(self.counts[w] for w in self.short)
        self.masses = [(tokens - self.known + 0.1 * rare) / self.buckets + 0.1] * self.buckets

    def weigh(self, counts: DataFrame) -> None:
        """Masses of the shared outputs, each with one unknown word, from the table of counts (BUCKETS rows at most)."""
        import zlib

        tokens, types = [0] * self.buckets, [0] * self.buckets
        for b, n, v in counts.groupBy(F.crc32("word") % self.buckets).agg(F.sum("c"), F.count(F.lit(1))).collect():
            tokens[b], types[b] = n, v
        for w in self.short:
            b = zlib.crc32(w) % self.buckets
            tokens[b] -= self.counts[w]
            types[b] -= 1
        self.masses = [n + 0.1 * (v + 1) for n, v in zip(tokens, types)]


def _softmax(z, y, scale=None):
    """log of the share of y in each row of exp(z), and, given scales, each row's gradient of -scale * log share; z is overwritten."""
    import numpy as np

    rows = np.arange(len(y))
    if z.max() > 60:
        z -= z.max(1, keepdims=True)
    logs = z[rows, y]
    np.exp(z, out=z)
    total = z.sum(1)
    logs = logs - np.log(total)
    if scale is not None:
        z *= (scale / total)[:, None]
        z[rows, y] -= scale
    return logs, z


class Net:
    """Parameters by name. `first` is the id of the end, which also begins a document."""

    def __init__(self, vocabulary: Vocabulary | None = None, seed: int = 5):
        import numpy as np

        if vocabulary is None:
            return
        self.first = vocabulary.ids[END]
        rng, h, f = np.random.default_rng(seed), HIDDEN, np.float32
        total = vocabulary.size + vocabulary.buckets
        size = int(np.ceil(total**0.5))
        classes = -(-total // size)
        counts = np.full(classes * size, 1e-9)
        counts[: len(vocabulary.short)] = [vocabulary.counts[w] + 0.1 for w in vocabulary.short]
        counts[vocabulary.size : total] = vocabulary.masses
        counts = counts.reshape(classes, size)
        mass = counts.sum(1)
        self.p = {
            "e": rng.normal(0, 0.3, (total, h)).astype(f),
            "w": rng.normal(0, h**-0.5, (h, 3 * h)).astype(f),
            "u": rng.normal(0, h**-0.5, (h, 3 * h)).astype(f),
            "b": np.zeros(3 * h, f),
            "c": np.zeros((h, classes), f),
            "cb": np.log(mass / mass.sum()).astype(f),
            "o": np.zeros((classes, h, size), f),
            "ob": np.log(counts / counts.sum(1, keepdims=True)).astype(f),
        }

    def states(self, x, h):
        """Hidden states before each token (T + 1 of them) of lanes x (T, lanes) of ids, and the gates, for backpropagation."""
        import numpy as np

        p, n = self.p, HIDDEN
        g = p["e"][x] @ p["w"] + p["b"]
        hs = np.empty((len(x) + 1, *h.shape), np.float32)
        gates = np.empty((len(x), x.shape[1], 4 * n), np.float32)
        hs[0] = h
        keep = self.goes_on(x)
        for t in range(len(x)):
            prev = hs[t] * keep[t]
            hu = prev @ p["u"]
            zr = np.tanh(0.5 * (g[t, :, : 2 * n] + hu[:, : 2 * n])) * 0.5 + 0.5
            c = np.tanh(g[t, :, 2 * n :] + zr[:, n:] * hu[:, 2 * n :])
            hs[t + 1] = c + zr[:, :n] * (prev - c)
            gates[t, :, : 2 * n], gates[t, :, 2 * n : 3 * n], gates[t, :, 3 * n :] = zr, c, hu[:, 2 * n :]
        return hs, gates

    def goes_on(self, x):
        """0 where a document begins, whose state is the first one, else 1."""
        return (x != self.first)[..., None].astype("float32")

    def outputs(self, h, y, grads: dict | None = None, live=None):
        """log P(y | h) of rows; with grads, sets the gradients of its negative mean and returns that for h too."""
        import numpy as np

        p = self.p
        classes, size = p["ob"].shape
        cls = y // size
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(classes + 1)).tolist()
        hs, cls, ys = h[order], cls[order], y[order] % size
        scale = None if grads is None else (live / max(1, live.sum())).astype(np.float32)[order]
        logs, e = _softmax(hs @ p["c"] + p["cb"], cls, scale)
        dh = None
        if grads is not None:
            grads["c"] = hs.T @ e
            grads["cb"] = e.sum(0)
            grads["o"], grads["ob"] = np.zeros_like(p["o"]), np.zeros_like(p["ob"])
            dh = e @ p["c"].T
        for k in range(classes):
            a, b = ends[k], ends[k + 1]
            if a == b:
                continue
            mine = hs[a:b]
            part, e = _softmax(mine @ p["o"][k] + p["ob"][k], ys[a:b], None if scale is None else scale[a:b])
            logs[a:b] += part
            if grads is not None:
                np.matmul(mine.T, e, out=grads["o"][k])
                grads["ob"][k] = e.sum(0)
                dh[a:b] += e @ p["o"][k].T
        out = np.empty_like(logs)
        out[order] = logs
        if dh is not None:
            back = np.empty_like(dh)
            back[order] = dh
            dh = back
        return out, dh

    def window(self, x, y, h, live):
        """Gradients of the mean loss of one window (truncated there), those of the embeddings for the ids it reads, which come next, and the state after it."""
        import numpy as np

        p, n = self.p, HIDDEN
        hs, gates = self.states(x, h)
        grads = {k: np.zeros_like(p[k]) for k in ("u", "b", "w")}
        # y[t] follows the state after x[t]
        _, dh = self.outputs(hs[1:].reshape(-1, n), y.reshape(-1), grads, live.reshape(-1).astype(np.float32))
        dh = dh.reshape(len(x), -1, n)
        dg = np.empty((len(x), x.shape[1], 3 * n), np.float32)
        carry, keep = np.zeros_like(h), self.goes_on(x)
        for t in range(len(x) - 1, -1, -1):
            d = dh[t] + carry
            z, r, c, hu = (gates[t, :, i * n : (i + 1) * n] for i in range(4))
            dc = d * (1 - z) * (1 - c * c)
            prev = hs[t] * keep[t]
            dz = d * (prev - c) * z * (1 - z)
            dr = dc * hu * r * (1 - r)
            dhu = np.concatenate([dz, dr, dc * r], axis=1)
            dg[t] = np.concatenate([dz, dr, dc], axis=1)
            grads["u"] += prev.T @ dhu
            carry = (d * z + dhu @ p["u"].T) * keep[t]
        flat = dg.reshape(-1, 3 * n)
        grads["b"] += flat.sum(0)
        inputs = p["e"][x].reshape(-1, n)
        grads["w"] += inputs.T @ flat
        de = flat @ p["w"].T
        ids = x.reshape(-1)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        starts = np.flatnonzero(np.diff(ids, prepend=-1))
        grads["e"] = np.add.reduceat(de[order], starts)
        return grads, ids[starts], hs[-1]

    def train(self, documents: list, seed: int) -> int:
        """One pass over documents (arrays of ids, the end last; the list is emptied), laid in lanes; returns the number of tokens."""
        import numpy as np

        if not documents:
            return 0
        stream = np.concatenate([documents[i] for i in np.random.default_rng(seed).permutation(len(documents))]).astype(np.int32)
        documents.clear()
        # few tokens go in fewer lanes, for enough steps; a lane may begin within a document, with the state of a beginning
        lanes = max(1, min(LANES, len(stream) // (WINDOW * STEPS_AT_LEAST)))
        longest = -(-len(stream) // lanes)
        y = np.full(longest * lanes, -1, np.int32)
        y[: len(stream)] = stream
        x = np.concatenate([np.array([self.first], np.int32), y[:-1]]).reshape(lanes, longest).T
        y = y.reshape(lanes, longest).T
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        h = np.zeros((lanes, HIDDEN), np.float32)
        windows = range(0, longest, WINDOW)
        for step, t in enumerate(windows, 1):
            live = y[t : t + WINDOW] >= 0
            # embeddings that the window does not read keep still
            grads, ids, h = self.window(np.maximum(x[t : t + WINDOW], 0), np.maximum(y[t : t + WINDOW], 0), h, live)
            norm = sum(float(np.vdot(g, g)) for g in grads.values()) ** 0.5
            rate = STEP * min(1.0, step / 20) * (1 - 0.9 * step / (len(windows) + 1))
            rate, least = rate * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step), 1e-6 * (1 - 0.99**step) ** 0.5
            for k, g in grads.items():
                at = ids if k == "e" else ...
                g *= min(1.0, CLIP / (norm + 1e-9))
                mk, sk = m[k][at], s[k][at]
                mk *= 0.9
                mk += 0.1 * g
                sk *= 0.99
                g *= g
                g *= 0.01
                sk += g
                np.sqrt(sk, out=g)
                g += least
                np.divide(mk, g, out=g)
                g *= rate
                self.p[k][at] -= g
                if k == "e":
                    m[k][at], s[k][at] = mk, sk
        return len(stream)

    def score(self, documents: list):
        """log10 P of each document (arrays of ids, the end last): whole documents end to end in lanes of about the length of the longest, so that one long document does not run alone."""
        import heapq

        import numpy as np

        out = np.zeros(len(documents))
        if not documents:
            return out
        order = np.argsort([-len(d) for d in documents], kind="stable").tolist()
        lanes = max(1, min(SCORE_LANES, sum(map(len, documents)) // max(WINDOW, len(documents[order[0]]))))
        loads, begins = [(0, k) for k in range(lanes)], []
        for i in order:
            load, k = heapq.heappop(loads)
            begins.append((i, k, load))
            heapq.heappush(loads, (load + len(documents[i]), k))
        longest = max(load for load, _ in loads)
        y = np.full((lanes, longest), -1, np.int32)
        for i, k, at in begins:
            y[k, at : at + len(documents[i])] = documents[i]
        x = np.concatenate([np.full((lanes, 1), self.first, np.int32), np.maximum(y[:, :-1], 0)], axis=1).T
        y = np.ascontiguousarray(y.T)
        logs, h = np.zeros((longest, lanes)), np.zeros((lanes, HIDDEN), np.float32)
        wide = max(WINDOW, SCORE_LANES * WINDOW // lanes)
        for t in range(0, longest, wide):
            hs, _ = self.states(x[t : t + wide], h)
            live = y[t : t + wide] >= 0
            logs[t : t + wide][live] = self.outputs(hs[1:][live], y[t : t + wide][live])[0]
            h = hs[-1]
        logs = logs.T.copy()
        for i, k, at in begins:
            out[i] = logs[k, at : at + len(documents[i])].sum()
        return out / np.log(10)


def fit(docs: DataFrame, vocabulary: Vocabulary, train_every: int = TRAIN_EVERY, part_tokens: int = PART_TOKENS, rounds: int = ROUNDS) -> Net:
    """The net after one pass over the training documents in parts; each round's parts start from the mean, by tokens, of those of the round before."""
    import numpy as np

    spark = docs.sparkSession
    net = Net(vocabulary)
    net.trained = 0
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if train_every > 1:
        chosen = chosen.where(F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(train_every)) == 0)
    parts = max(1, -(-vocabulary.tokens // (train_every * part_tokens)))
    rounds = min(rounds, parts)
    names = list(net.p)
    # the text is hashed too: rows that share an id do not share a part
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("doc_id", "text", F.lit(2)), F.lit(parts)))

    def trains(shared):
        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zlib

            net, vocabulary = shared.value
            mine = Net()
            mine.p, mine.first = {k: v.copy() for k, v in net.p.items()}, net.first
            get, found = vocabulary.ids.__getitem__, []
            for batch in batches:
                part = batch.column("part")[0].as_py()
                for i, text in zip(batch.column("doc_id").to_pylist(), texts_as_bytes(batch.column("text"))):
                    ids = np.fromiter(map(get, _words(text)), np.int32)
                    found.append((i, zlib.crc32(ids), ids))
            found.sort(key=lambda x: x[:2])
            documents = [ids for _, _, ids in found]
            found.clear()
            tokens = mine.train(documents, part)
            state = np.concatenate([mine.p[k].ravel() for k in names])
            slices = [state[i : i + SLICE].tobytes() for i in range(0, len(state), SLICE)]
            yield pa.RecordBatch.from_pydict({"part": [part] * len(slices), "slice": list(range(len(slices))), "tokens": [tokens] * len(slices), "state": slices}, schema=STATES)

        return train

    for r in range(rounds):
        train = trains(spark.sparkContext.broadcast((net, vocabulary)))
        trained = chosen.where(F.col("part") % rounds == r).groupBy("part").applyInArrow(train, STATES_SQL)
        rows = sorted(staged(averaged(trained, parts), "net").collect(), key=lambda x: x.slice)
        if not rows:  # no document's hash is in the round's parts
            continue
        state, at = np.concatenate([np.frombuffer(x.state, np.float32) for x in rows]), 0
        for k in names:
            net.p[k] = state[at : at + net.p[k].size].reshape(net.p[k].shape).copy()
            at += net.p[k].size
        net.trained += rows[0].tokens
    return net


STATES = pa.schema([("part", pa.int64()), ("slice", pa.int32()), ("tokens", pa.int64()), ("state", pa.binary())])
STATES_SQL = "part long, slice int, tokens long, state binary"


def averaged(states: DataFrame, parts: int, fan: int = FAN) -> DataFrame:
    """Slices (part, slice, tokens, state) of parts 0 to parts - 1, averaged by tokens over the parts: a tree of at most `fan` at a time."""
    import numpy as np

    def average(table):
        table = table.sort_by("part")
        tokens = table.column("tokens").to_pylist()
        mean, total = 0.0, sum(tokens)
        for n, x in zip(tokens, table.column("state")):
            mean = mean + np.frombuffer(x.as_py(), np.float32) * (n / total)
        return pa.table({"part": [table.column("up")[0].as_py()], "slice": table.column("slice")[:1], "tokens": [total], "state": [mean.astype(np.float32).tobytes()]})

    while True:
        parts = -(-parts // fan)
        states = states.withColumn("up", F.floor(F.col("part") / fan)).groupBy("slice", "up").applyInArrow(average, STATES_SQL)
        if parts <= 1:
            return states


def scored(docs: DataFrame, net: Net, vocabulary: Vocabulary, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of whole documents with an id."""
    shared = docs.sparkSession.sparkContext.broadcast((net, vocabulary))

    def run(batches):
        import numpy as np

        net, v = shared.value
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_tokens", "head_known", "head_logs", "net_score", "tail"]
        codes = {w: i for i, w in enumerate(v.counts)}
        short, logs = (np.array(x) for x in zip(*[(v.ids[w], np.log10(c + 0.1)) for w, c in v.counts.items()])) if codes else (np.zeros(0, int), np.zeros(0))
        short, logs = np.append(short, v.size).astype(np.int32), np.append(logs, 0.0)  # the last: words beyond the head
        masses = np.log10(v.masses)
        beyond = len(codes)
        for batch in batches:
            rows: list[list] = [batch.column(0).to_pylist(), [], [], [], []]
            documents, ends, rest, times = [], [0], [], []
            for text in texts_as_bytes(batch.column(1)):
                words = _words(text)
                code = np.fromiter((codes.get(w, beyond) for w in words), np.int32, len(words))
                tail: dict[bytes, int] = {}
                k = short[code]
                for i in np.flatnonzero(code == beyond).tolist():
                    tail[words[i]] = tail.get(words[i], 0) + 1
                    k[i] = v.ids[words[i]]
                documents.append(k)
                rare, log = k >= v.size, logs[code]
                for c, x in zip(rows[1:], (len(words), len(words) - sum(tail.values()), float(log.sum()), float(log[rare].sum() - masses[k[rare] - v.size].sum()))):
                    c.append(x)
                rest += tail
                times += tail.values()
                ends.append(len(rest))
            rows[4] = list(net.score(documents) + np.array(rows[4]))
            pairs = pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])
            tails = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(rows, kinds)), tails], names=names)

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    raw = staged(given.mapInArrow(run, "doc_id long, n_tokens long, head_known long, head_logs double, net_score double, tail array<struct<word:binary,n:bigint>>"), "lm")
    raw = raw.withColumn("row", F.struct("_metadata.file_name", "_metadata.row_index"))
    found = raw.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    tails = found.groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"), F.sum(F.col("n") * F.log10(c + 0.1)).alias("tail_logs"))
    out = raw.join(tails, "row", "left")
    zero = F.lit(0.0)
    logs = F.col("head_logs") + F.coalesce("tail_logs", zero)
    base = logs - F.col("n_tokens") * float(_log10(vocabulary.tokens + 0.1 * (vocabulary.types + 1)))
    score = F.col("net_score") + F.coalesce("tail_logs", zero)
    return out.select("doc_id", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), base.alias("base_score"), score.alias("score"))


def _log10(x: float) -> float:
    import math

    return math.log10(x)


def language_model_scores(docs: DataFrame, train_every: int = TRAIN_EVERY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): learnt from the documents that are not held out."""
    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = given.where(~held_out(F.col("doc_id")))
    counts = staged(counted(training), "counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    head = sorted(((bytes(r.word), r.c) for r in most_frequent(counts).collect()), key=lambda x: (-x[1], x[0]))
    vocabulary = Vocabulary(head, sums.n, sums.v)
    vocabulary.weigh(counts)
    net = fit(training, vocabulary, train_every)
    out = scored(given, net, vocabulary, counts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(sums.n).cast("long").alias("train_tokens"), "base_score", "score")
