"""Operators that SQL cannot state, against plain versions; and the SQL of those that it can."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from presswork.llm import _shared, fingerprints, maxscore, mixing, near_dup, packing, passages, quality, queries, recurrent_lm, token_counts

from ..conftest import SMALL, same_rows


@pytest.fixture(scope="module")
def documents(warehouse):
    return dict(warehouse.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_are_those_of_the_sql(spark, warehouse, name):
    same_rows(queries.QUERIES[name](spark, SMALL), warehouse, queries.ORACLES[name])


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_maxscore_in_many_shards_is_brute_force(spark, warehouse):
    rows = warehouse.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows}
    v = maxscore.quantized(spark.read.parquet(f"{SMALL}/embeddings.parquet")).repartition(5)
    got = defaultdict(list)
    for r in maxscore.search(v, v.where("vec_id % 50 = 0"), 5, shard_rows=37, query_rows=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in [i for i in x if i % 50 == 0]:
        assert got[q] == [(c, -s) for s, c in sorted((-int(x[q] @ x[c]), c) for c in x if c != q)[:5]]


def test_hot_group_of_mostly_unlinked_copies(spark):
    """Many copies of one text with edits at many rates: every link is found, and through the rare shingles."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(140)]
    texts = {}
    for i in range(150):
        w = list(base)
        for k in rnd.sample(range(140), rnd.choice([0, 1, 1, 2, 3, 6, 10, 20])):
            w[k] = f"e{i}-{k}"
        texts[i] = " ".join(w)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(d, 85).collect()}
    s = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in range(i):
            if 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in texts}
    assert len(set(got.values())) > 20


def test_mixing_meets_its_targets(spark):
    out = queries.op3_mixing(spark, SMALL)
    names = [c[2:] for c in out.columns if c.startswith("p_")]
    sums = out.agg(*[F.sum(F.col("rate") * F.col("n_words") * F.col(f"p_{n}")).alias(n) for n in names], F.min("rate").alias("least")).first()
    total = sum(sums[n] for n in names)
    assert sums.least >= 0 and out.count() == 200
    for n in names:
        assert sums[n] / total == pytest.approx(queries.LANGUAGE_WEIGHTS[n], abs=0.01)


def test_mixing_drops_no_document(spark):
    """Soft members of other domains add tokens to the domain that sets the budget; its own documents stay all the same."""
    rows = [(i, i, 100, [1.0, 0.0] if i < 10 else [0.1, 0.9]) for i in range(20)]
    members = spark.createDataFrame(rows, "doc_id long, row_id long, n long, p array<double>")
    rates = mixing.rates(members, ["a", "b"], {"a": 0.5, "b": 0.5}).agg(F.min("rate"), F.max("rate")).first()
    assert rates[0] >= 1 and rates[1] > 1.1
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = mixing.mixed(docs, queries.languages(docs), queries.LANGUAGE_WEIGHTS)
    assert docs.join(out, "doc_id", "left_anti").count() == 0


def test_fingerprints(spark, documents):
    got = {r.doc_id: r for r in queries.op4_fingerprints(spark, SMALL).collect()}
    order = sorted(documents, reverse=True)
    assert sorted(got) == sorted(documents)
    errors = []
    for k, i in enumerate(order):
        text, after = documents[i] or "", documents[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.fingerprint) in (0, fingerprints.BINS * fingerprints.BITS // 4)
        errors += [r.near_edited - likeness(text, edited), r.near_next - likeness(text, after)]
    assert np.sqrt(np.mean(np.square(errors))) < 0.04 and abs(np.mean(errors)) < 0.01


def test_equal_texts_have_equal_fingerprints_and_ends_wrap(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (5, "a b c d e f"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.compared(d).collect()}
    assert got[1].fingerprint == got[5].fingerprint != "" == got[3].fingerprint and got[3].near_next == 0.0 and got[4].near_next == 1.0
    assert got[1].edited_sha256 == hashlib.sha256(b"a b c da b c").hexdigest()[:0] + hashlib.sha256(("a b c d e f"[:6] + "a b c d e f"[:5]).encode()).hexdigest()


def test_edits_recount_as_a_fresh_encoding_does(documents):
    counter = token_counts.Counter(queries.tokenizer_path("byte_bpe_50k.tiktoken"), queries.pretokens())
    rnd = random.Random(1)
    for text in [*list(documents.values())[:60], "", " ", "\n\n x", "don't  'll 's  "]:
        text = text or ""
        tree = token_counts.Tree(token_counts.leaves_of(text, counter))
        for _ in range(8):
            put = rnd.choice(["", " ", "  ", "l", "'", "'l", "don't", "é 12", "the quick brown fox " * rnd.randint(1, 30)])
            text, encoded = token_counts.edited(text, tree, rnd.randint(0, len(text)), rnd.choice([0, 1, 5, 40, 10**6]), put, counter)
            assert list(tree.sums[1, [0, 2]]) == [len(text), len(counter.encode(text))]


def test_token_counts_query_and_edit_tables(spark, documents):
    counter = token_counts.Counter(queries.tokenizer_path("byte_bpe_50k.tiktoken"), queries.pretokens())
    for r in queries.op5_token_counts(spark, SMALL).collect():
        assert r.n_tokens == len(counter.encode(documents[r.doc_id] or ""))
    ranks, pattern = queries.tokenizer_path("byte_bpe_50k.tiktoken"), queries.pretokens()
    d = spark.createDataFrame([(1, "one two three"), (2, "x")], "doc_id long, text string")
    e = spark.createDataFrame([(1, 1, 4, 3, "2"), (1, 2, 0, 0, ">"), (9, 1, 0, 0, "y")], "doc_id long, edit_no int, start long, removed long, inserted string")
    got = {r.doc_id: (r.text, r.new_tokens) for r in token_counts.apply(token_counts.index(d, ranks, pattern), e, ranks, pattern).collect()}
    assert got == {1: (">one 2 three", len(counter.encode(">one 2 three"))), 2: ("x", 1)}


def test_every_repeated_passage_of_fifty_words_is_found(spark, documents):
    rows = queries.op6_passages(spark, SMALL).collect()
    found = {r.doc_id for r in rows}
    seen = defaultdict(set)
    short = defaultdict(int)
    for i, t in documents.items():
        w = words(t)
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
        for k in range(len(w) - 14):
            short[tuple(w[k : k + 15])] += 1
    assert {i for s in seen.values() if len(s) > 1 for i in s} <= found
    for i in found:  # nothing is listed that repeats nothing
        w = words(documents[i])
        assert any(short[tuple(w[k : k + 15])] > 1 for k in range(len(w) - 14))


def test_planted_passages_are_cut_but_their_first(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    passage = text(60)
    texts = {i: text(80) for i in range(40)}
    for i in (3, 9, 27):
        texts[i] = text(33) + " " + passage + " " + text(21)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in passages.repeats(d).select("doc_id").distinct().collect()} == {3, 9, 27}
    cut = {r.doc_id: r for r in passages.without_repeats(d).collect()}
    assert all(cut[i].text == texts[i] for i in texts if i not in (9, 27))
    assert all(40 <= cut[i].words_removed <= 60 for i in (9, 27))


def test_passages_of_rows_with_one_id_are_their_own(spark):
    rnd = random.Random(9)
    text = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    passage = text(60)
    rows = [(1, text(30) + " " + passage), (5, passage + " " + text(40)), (5, text(150)), (7, text(90)), (7, text(90))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {(r.doc_id, r.text): r.words_removed for r in passages.without_repeats(d).collect()}
    assert all((i, t) in cut and cut[i, t] == 0 for i, t in rows if (i, t) != rows[1])
    assert sorted(cut.values())[:-1] == [0] * 4 and max(cut.values()) >= 30


def test_edited_passages_are_found(spark):
    """Passages of 60 words of which one is changed stand in pairs of documents: nine in ten pairs are found, and nothing else."""
    rnd = random.Random(11)
    text = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(40):
        passage = text(60)
        edited = list(passage)
        edited[rnd.randrange(60)] = "changed"
        rows += [(2 * i, " ".join(text(25) + passage + text(30))), (2 * i + 1, " ".join(text(40) + edited + text(9)))]
    rows += [(1000 + i, " ".join(text(120))) for i in range(20)]
    found = {r.doc_id for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").distinct().collect()}
    assert found <= set(range(80)) and sum(2 * i + 1 in found for i in range(40)) >= 36


def test_passage_rows_are_those_of_all_pairs(spark):
    """Every column of repeats against all pairs of paragraphs compared by their full shingle sets."""
    rnd = random.Random(13)
    text = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    shared = [text(70) for _ in range(3)]
    texts = {i: " ".join(text(rnd.randrange(20)) + rnd.choice(shared) + text(rnd.randrange(20)) + rnd.choice(shared)) for i in range(12)}
    places = []
    for i, t in texts.items():
        _, at, _, s, _ = passages.paragraphs([t.encode()], _shared.WordHashes())
        places += [((i, int(a)), set(x.tolist())) for a, x in zip(at, s)]
    root = list(range(len(places)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(places)):
        for b in range(a):
            x, y = places[a][1], places[b][1]
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)), key=lambda k: places[k][0])
                root[q] = p
    groups = defaultdict(list)
    for k, (p, _) in enumerate(places):
        groups[find(k)].append(p)
    wanted = set()
    for g in groups.values():
        (d0, s0), (d1, s1) = min(g), max(g)
        if d0 != d1 or s1 - s0 >= passages.WORDS:
            wanted |= {(d, s, d0, s0) for d, s in g}
    got = passages.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {(r.doc_id, r.start, r.first_doc_id, r.first_start) for r in got.collect()} == wanted and wanted


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts.items()}


def packs_whole(rows, ids):
    """Every document is there in pieces as told, sequences are gapless and full enough; returns the number of sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        cuts = [(k, s, x[s : s + 2048]) for k, s in enumerate(range(0, len(x), 2048))]
        assert sorted((p.piece, p.start, p.length, p.ids_crc32) for p in pieces[i]) == [(k, s, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, s, c in cuts]
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_packing(spark, documents):
    ids = encoded(documents)
    n = packs_whole(queries.op8_packing(spark, SMALL).collect(), ids)
    assert n <= 1.02 * math.ceil(sum(map(len, ids.values())) / 2048) + 2


def test_packing_texts_that_could_upset_the_tokenizer(spark):
    texts = {1: "<|endoftext|> A<|startoftext|>b", 2: "İstanbul ſa ﬁ a b", 3: "don't I'LL x's", 4: "中文 mixed12ab", 5: None, 6: "a" * 5000, 7: "... ,;: !?", 8: "\x00 \x1c\x85  "}
    rows = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), queries.tokenizer_path("word_bpe_49k.json")).collect()
    packs_whole(rows, encoded(texts))


def test_quality_on_held_out_ratings(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rated = queries.ratings(labels)
    model = quality.fit(docs, rated.where("doc_id % 5 <> 0"), 3)
    assert list(model.t) == sorted(model.t)
    out = quality.scored(docs, model, 3).join(rated.where("doc_id % 5 = 0"), "doc_id").toPandas()
    assert ((out.p_best >= 0.5) == (out.grade == 2)).mean() > 0.85
    assert out.expected_grade.between(0, 2).all()


def test_gradients_of_the_recurrent_net():
    head = [(b"w%d" % i, 1000 - i) for i in range(1000)] + [(b" ", 50)]
    v = recurrent_lm.Vocabulary(head, 600_000, 2000)
    net, rng = recurrent_lm.Net(v), np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k] + rng.normal(0, 0.1, net.p[k].shape)
    x, y = rng.integers(0, 1025, (7, 5)), rng.integers(0, 1025, (7, 5))
    x[3, 2] = net.first
    live, h = np.ones((7, 5), bool), rng.normal(size=(5, recurrent_lm.HIDDEN)).astype(np.float32)
    live[5:, 1] = False

    def loss():
        hs, _ = net.states(x, h)
        out, _ = net.outputs(hs[1:].reshape(-1, recurrent_lm.HIDDEN), y.reshape(-1))
        return -(out * live.reshape(-1)).sum() / live.sum()

    grads, ids, _ = net.window(x, y, h, live)
    assert ids.tolist() == sorted(set(x.ravel().tolist()))
    read, grads["e"] = grads["e"], np.zeros_like(net.p["e"])
    grads["e"][ids] = read
    for k in ("w", "u", "b", "c", "cb", "e"):
        i = tuple(rng.integers(0, n) for n in net.p[k].shape)
        i = (x[2, 2], i[1]) if k == "e" else i
        was, ups = net.p[k][i], []
        for step in (0.01, -0.01):
            net.p[k][i] = was + step
            ups.append(loss())
        net.p[k][i] = was
        assert (ups[0] - ups[1]) / 0.02 == pytest.approx(grads[k][i], abs=2e-4)


def test_scores_are_those_of_a_plain_forward_pass():
    """Each document alone, token by token, with explicit gates and both softmaxes over all their outputs."""
    head = [(b"w%d" % i, 1000 - i) for i in range(1000)] + [(b" ", 50)]
    v = recurrent_lm.Vocabulary(head, 600_000, 2000)
    net, rng = recurrent_lm.Net(v), np.random.default_rng(4)
    for k in net.p:
        net.p[k] = (net.p[k] + rng.normal(0, 0.2, net.p[k].shape)).astype(np.float32)
    end = v.ids[b" "]
    draw = lambda n: np.append(rng.choice([i for i in range(1040) if i != end], n), end)
    documents = [draw(n) for n in (0, 1, 40, 700, 3, 33, 90)]
    p = {k: x.astype(float) for k, x in net.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n, size = recurrent_lm.HIDDEN, p["ob"].shape[1]
    for d, got in zip(documents, net.score(documents)):
        h, last, total = np.zeros(n), end, 0.0
        for y in d:
            g, u = p["e"][last] @ p["w"] + p["b"], h @ p["u"]
            z, r = sigmoid(g[:n] + u[:n]), sigmoid(g[n : 2 * n] + u[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(g[2 * n :] + r * u[2 * n :])
            c, w = h @ p["c"] + p["cb"], h @ p["o"][y // size] + p["ob"][y // size]
            total += c[y // size] - np.log(np.exp(c).sum()) + w[y % size] - np.log(np.exp(w).sum())
            last = y
        assert got == pytest.approx(total / math.log(10), rel=1e-4)


def test_probabilities_sum_to_one():
    head = [(b"w%d" % i, 1000 - i) for i in range(1000)] + [(b" ", 50)]
    v = recurrent_lm.Vocabulary(head, sum(c for _, c in head) + 500, 1101)
    net = recurrent_lm.Net(v)
    h = np.random.default_rng(0).normal(size=(1, recurrent_lm.HIDDEN)).astype(np.float32)
    net.p["c"] += 0.1
    out, _ = net.outputs(np.repeat(h, recurrent_lm.SHORTLIST + 1, 0), np.arange(recurrent_lm.SHORTLIST + 1))
    assert np.exp(out).sum() == pytest.approx(1.0, abs=1e-4)


def test_language_model_query(spark, documents):
    counts = Counter()
    toks = lambda t: [*words(t), None]
    for i, t in documents.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(toks(t))
    n, v = sum(counts.values()), len(counts)
    rows = queries.op10_language_model(spark, SMALL).collect()
    assert len(rows) == len(documents)
    for r in rows:
        w = toks(documents[r.doc_id])
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), n, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_language_model_learns_what_follows_what(spark):
    """In texts that repeat a cycle the next word is all but certain to a model with a state."""
    cycle = [f"c{i}" for i in range(6)]
    d = spark.createDataFrame([(i, " ".join(cycle[(i + k) % 6] for k in range(400))) for i in range(120)], "doc_id long, text string")
    r = recurrent_lm.language_model_scores(d, 1).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count(F.lit(1))).first()
    assert r[2] > 0 and r[0] > 0.5 * r[1]


def test_near_dedup_stage_links_from_eighty_per_cent(spark):
    w = [f"w{i}" for i in range(104)]
    x, y = list(w), list(w)
    x[30], y[70] = "x", "y"  # each alone spoils five of a hundred shingles
    d = spark.createDataFrame([(1, " ".join(x)), (2, " ".join(y)), (3, "something else entirely is here")], "doc_id long, text string")
    assert 0.8 <= likeness(" ".join(x), " ".join(y)) < 0.85
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, d, SMALL).collect()) == [1, 3]


def test_vocabulary_follows_the_counts(spark):
    """Every word of a count of LEAST or more has an output of its own; rarer ones share several by a hash, whose masses are their counts'."""
    often = [b"w%d" % i for i in range(3000)]
    table = [(b" ", 900), *((w, recurrent_lm.LEAST + i % 7) for i, w in enumerate(often)), *((b"r%d" % i, 1 + i % 19) for i in range(2000))]
    head = sorted(table, key=lambda x: (-x[1], x[0]))
    v = recurrent_lm.Vocabulary(head, sum(c for _, c in head), len(head))
    v.weigh(spark.createDataFrame([(bytearray(w), c) for w, c in head], "word binary, c long"))
    assert sorted(v.ids[w] for w in [b" ", *often]) == list(range(3001))
    shared = defaultdict(float)
    for i in range(2000):
        shared[v.ids[b"r%d" % i]] += 1 + i % 19 + 0.1
    assert v.size <= min(shared) and len(shared) > 20
    assert v.masses == pytest.approx([shared[v.size + k] + 0.1 for k in range(v.buckets)])
    net = recurrent_lm.Net(v)
    net.p["c"] += 0.1
    n = v.size + v.buckets
    h = np.random.default_rng(0).normal(size=(1, recurrent_lm.HIDDEN)).astype(np.float32)
    assert np.exp(net.outputs(np.repeat(h, n, 0), np.arange(n))[0]).sum() == pytest.approx(1.0, abs=1e-3)


def test_every_training_document_is_stepped_on_and_rounds_go_on(spark):
    """Tokens of all steps are those of the counts, by default; a second round of parts starts from the mean of the first."""
    cycle = [f"c{i}" for i in range(6)]
    d = spark.createDataFrame([(i, " ".join(cycle[(i + k) % 6] for k in range(300))) for i in range(160)], "doc_id long, text string")
    training = d.where(~recurrent_lm.held_out(F.col("doc_id")))
    counts = recurrent_lm.counted(training)
    head = sorted(((bytes(r.word), r.c) for r in counts.collect()), key=lambda x: (-x[1], x[0]))
    v = recurrent_lm.Vocabulary(head, sum(c for _, c in head), len(head))
    test = [np.array([v.ids[w] for w in [*words(r.text), recurrent_lm.END]]) for r in d.where(recurrent_lm.held_out(F.col("doc_id"))).collect()]
    assert recurrent_lm.fit(training, v).trained == v.tokens
    nets = [recurrent_lm.fit(training, v, part_tokens=6000, rounds=n) for n in (1, 2)]
    assert [n.trained for n in nets] == [v.tokens] * 2
    once, twice = (n.score(test).sum() for n in nets)
    assert twice > once


def test_states_are_averaged_in_a_tree(spark):
    """Means of means by tokens are the mean of all parts, whatever the fan; missing parts do not count."""
    rng = np.random.default_rng(6)
    parts, width = [i for i in range(70) if i % 7], 5
    states = rng.normal(size=(len(parts), 3, width)).astype(np.float32)
    tokens = rng.integers(1, 1000, len(parts))
    rows = [(i, k, int(n), bytearray(states[j, k].tobytes())) for j, (i, n) in enumerate(zip(parts, tokens)) for k in range(3)]
    d = spark.createDataFrame(rows, recurrent_lm.STATES_SQL)
    want = (states * tokens[:, None, None]).sum(0) / tokens.sum()
    for fan in (2, 64, 100):
        got = sorted(recurrent_lm.averaged(d, 70, fan).collect(), key=lambda r: r.slice)
        assert [(r.slice, r.tokens) for r in got] == [(k, tokens.sum()) for k in range(3)]
        assert np.array([np.frombuffer(r.state, np.float32) for r in got]) == pytest.approx(want, abs=1e-5)


def test_pipeline_is_its_stages_and_keeps_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        before = docs
        docs = _shared.staged(out, "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "MinHash near-dedup":
            assert near_dup.near_duplicates(docs).where("not kept").count() == 0
    rest = before.select("doc_id", "text").collect()
    ids = encoded({r.doc_id: r.text for r in rest})
    got = Counter(docs.select("doc_id", "piece", "length", "ids_crc32").collect())
    copies = Counter(r.doc_id for r in rest)
    assert sum(got.values()) == sum(math.ceil(len(ids[i]) / 2048) * n for i, n in copies.items())
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter(whole.select("doc_id", "piece", "length", "ids_crc32").collect()) == got


def test_words_of_one_length_are_hashed_as_each_alone():
    import random

    draw = random.Random(4)
    texts = [bytes(draw.choice(b"aZ \x0b\xff\x1c\t") for _ in range(draw.randrange(200))) for _ in range(300)]
    texts += [None, b"", b" ", b"x" * 500, bytes(range(1, 256)), b"a" * 31 + b" " + b"b" * 32]
    found, sizes = _shared.hashes_of_texts(texts, _shared.WordHashes())
    each = [_shared.word_hashes(_shared.words_of(t), _shared.WordHashes()) for t in texts]
    assert sizes.tolist() == [len(h) for h in each] and found.tolist() == [x for h in each for x in h.tolist()]
