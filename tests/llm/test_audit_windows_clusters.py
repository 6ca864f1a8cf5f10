"""Filter audit, windows and clusters against plain versions, and their edges."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import filter_audit, queries, windows, yinyang

from ..conftest import SMALL

TOKENS = queries.tokenizer_path("word_bpe_49k.json")


# filter audit ---------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """Rows (doc_id, part, text) and (doc_id, quality, toxic) -> what the operator gives, one order after another."""
    def fails(doc_id, text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        out["E"] = doc_id is not None and any(i is not None and i < doc_id for i in ids[text])
        return out

    docs = [(i, p or "", t or "") for i, p, t in docs]
    ids = {}
    for i, _, t in docs:
        ids.setdefault(t, []).append(i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    failed = [(i, p, fails(i, t)) for i, p, t in docs]
    out = {}
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in failed if p == part]
        removed_ever = Counter()
        rows = {}
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[letter]]
                left = [(i, f) for i, f in left if not f[letter]]
                removed_ever[letter] += len(gone)
                failing = [f for _, f in mine if f[letter]]
                rows[order, step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(f.values()) == 1 for f in failing), sum(i in good for i, _ in gone if i is not None), sum(i in toxic for i, _ in gone if i is not None)]
        for (order, step), r in rows.items():
            out[part, order, step] = (*r, removed_ever[order[step - 1]])
    return out


def found_audit(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_filter_audit_with_hot_copies_is_brute_force(spark, parts):
    """One text in a third of all rows, dealt over many ranges; nulls, ties and repeated rows."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["ALL", "CAPS", "a#b", "x|y"]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([3, 49, 50, 51, 90]))) for _ in range(60)] + ["", "\x0b\x0c\r\n\t ", "Été   \U0001f600 A", "same " * 60]
    docs = [(i, rnd.choice(["s", "t", None, ""]), rnd.choice(texts)) for i in range(400)] + [(i, "s", "hot text of many copies") for i in range(1000, 1300)]
    docs += [(1000, "t", "hot text of many copies"), (5, "t", texts[0]), (5, "t", texts[0]), (None, "s", texts[0]), (None, "s", "hot text of many copies"), (700, "s", None)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 1300, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    rnd.shuffle(docs)
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({c: F.lit("x") for c in ("part", "mask", "key", "n", "cells")}).repartition(parts)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(3 * parts))
        got = found_audit(filter_audit.audited(d, lab))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain_audit(docs, labels)


def test_filter_audit_of_colliding_fingerprints(spark, monkeypatch):
    """Texts are compared, not only their keys."""
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    docs = [(i, "s", f"text {i % 5}") for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3)
    masks = {r.doc_id: r["mask"] for r in filter_audit.failures(d, filters={}).collect()}
    assert masks == {i: int(i >= 5) for i in range(40)}


def test_filter_audit_of_an_empty_table_and_of_other_filters(spark):
    d = spark.createDataFrame([], "doc_id long, source string, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(d, lab).count() == 0
    d = spark.createDataFrame([(1, "s", "short"), (2, "s", "short"), (3, "s", "x" * 100_000)], "doc_id long, source string, text string")
    rows = filter_audit.audited(d, lab, filters={"L": lambda m: m.chars > 10}).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in rows} == {("LE", 1): (2, 1, 2), ("LE", 2): (1, 1, 2), ("EL", 1): (2, 1, 2), ("EL", 2): (1, 1, 2)}


# windows --------------------------------------------------------------------------------------


def cost_of(ends, costs, capacity, shortest):
    total, before = 0, 0
    for x in ends:
        n = x - before
        assert 0 < n <= capacity
        total += costs[x] + (0 if n & (n - 1) == 0 and n >= shortest else capacity - n)
        before = x
    return total


def test_cuts_cost_least():
    rnd = random.Random(2)
    for capacity, shortest in ((8, 1), (16, 4), (10, 2), (64, 8)):
        for _ in range(60):
            places, x = [], 0
            for _ in range(rnd.randint(1, 40)):
                x += rnd.randint(1, capacity if rnd.random() < 0.2 else max(1, capacity // 4))
                places.append(x)
            costs = {p: rnd.choice([0, 1, 3, 9]) for p in places}
            best = {0: 0}
            for p in places:
                best[p] = costs[p] + min(best[q] + (0 if (n := p - q) & (n - 1) == 0 and n >= shortest else capacity - n) for q in best if p - q <= capacity)
            ends = windows.cuts(places, [costs[p] for p in places], capacity, shortest)
            assert ends[-1] == places[-1] and cost_of(ends, costs, capacity, shortest) == best[places[-1]]


def check_windows(rows, ids, capacity):
    """Each id in one piece, checksums, order, gapless offsets."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, whole in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(whole[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(whole)
    for group in by_sequence.values():
        at, last = 0, None
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at and (last is None or (last.doc_id < r.doc_id and last.start + last.length == last.doc_tokens and r.start == 0))
            at, last = at + r.length, r
        assert at <= capacity
    return [sum(r.length for r in g) for g in by_sequence.values()]


def encoded(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENS)
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, end] for i, x in texts.items()}


def test_windows_of_the_documents(spark, warehouse):
    texts = dict(warehouse.execute("SELECT doc_id, text FROM documents").fetchall())
    lengths = check_windows(queries.op12_windows(spark, SMALL).collect(), encoded(texts, 1), 2048)
    padding = sum(2048 - n for n in lengths if n & (n - 1))
    assert padding < 0.02 * sum(lengths)


@pytest.mark.parametrize("segment", [1, 300, 1 << 20])
def test_windows_go_on_over_segments(spark, monkeypatch, segment):
    rnd = random.Random(segment)
    texts = {i: " ".join(rnd.choice(["one", "two.", "drei", "(four.)", "5!", "é", "x" * 30]) for _ in range(rnd.choice([0, 1, 5, 40, 400]))) for i in range(40)}
    texts |= {50: None, 51: "", 52: " \n\t", 53: "word " * 3000, 54: "\u0000 ​. end."}
    docs = spark.createDataFrame([*texts.items(), (None, "no id")], "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("offset", F.lit(1))
    rows = windows.packed(docs.repartition(3), TOKENS, 64, 7, segment=segment).collect()
    check_windows(rows, encoded(texts, 7), 64)


def test_windows_of_equal_rows_and_of_none(spark):
    docs = spark.createDataFrame([(1, "a b. c"), (1, "a b. c"), (2, None)], "doc_id long, text string").coalesce(1)
    rows = windows.packed(docs, TOKENS, 2048).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * rows[0].doc_tokens and len({r.sequence_id for r in rows}) == 1
    assert windows.packed(docs.limit(0), TOKENS).count() == 0


def test_sentence_ends():
    e = windows.SentenceIds(TOKENS)
    ids, ends = next(iter(e.encode([b"a b. (c!) d\xe2\x80\xa6 e?\xe2\x80\x9d 1.5 f".split()])))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENS)
    n = [len(t.encode(x, add_special_tokens=False).ids) for x in ("a b.", "a b. (c!)", "a b. (c!) d…", "a b. (c!) d… e?”")]
    assert ends.tolist() == n and ids.tolist() == t.encode("a b. (c!) d… e?” 1.5 f", add_special_tokens=False).ids


# clusters -------------------------------------------------------------------------------------


def lloyd(vectors, k, rounds, salt="1:"):
    """(vec_id, v) rows -> sorted (vec_id, cluster, distance), inertias by cluster, centroids; Python's integers."""
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in vectors]

    for _ in range(rounds):
        of = [j for _, j in assign()]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(vectors, of) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    final = assign()
    inertia = Counter()
    for d, j in final:
        inertia[j] += d
    return sorted((i, j, d) for (i, _), (d, j) in zip(vectors, final)), inertia, c


@pytest.mark.parametrize("spread,k,groups,rows", [(3, 16, None, 7), (40, 9, 3, 1000), (40, 9, 1, 50), (40, 5, 5, 20), (2**27, 6, 2, 11), (1, 40, None, 64)])
def test_clusters_are_those_of_plain_k_means(spark, spread, k, groups, rows):
    """Small spreads make ties, large ones pass the doubles; more rounds than in the query, for bounds that have moved often."""
    rnd = np.random.default_rng(k * spread % 1000)
    middle = rnd.integers(-spread, spread + 1, (5, 4))
    x = np.clip(middle[rnd.integers(0, 5, 300)] + rnd.integers(-1 - spread // 8, 2 + spread // 8, (300, 4)), -(2**27), 2**27)
    vectors = [(i, [int(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in vectors], "vec_id long, v array<double>").repartition(3)
    for rounds in (0, 1, 6):
        found = yinyang.clustered(df, k, rounds, n_groups=groups, block_rows=rows).collect()
        plain, inertia, c = lloyd(vectors, k, rounds)
        assert sorted((r.vec_id, r.cluster, r.distance) for r in found) == plain
        digests = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
        most = 2**63 - 1
        assert all((r.cluster_inertia, r.inertia, r.centroid_sha256) == (min(most, inertia[r.cluster]), min(most, sum(inertia.values())), digests[r.cluster]) for r in found)


def test_bounds_spare_distances():
    """After the first round few distances are taken where clusters lie apart."""
    rnd = np.random.default_rng(1)
    middle = rnd.integers(-4000, 4000, (24, 8))
    x = middle[rnd.integers(0, 24, 4000)] + rnd.integers(-40, 41, (4000, 8))
    c = [middle[i].tolist() for i in range(24)]
    group = yinyang.groups_of(c, 6)
    cluster, upper, lower, taken = yinyang.State(c, None, group).assigned(x, None, None, None)
    assert taken == 24 * 4000
    moved = [[v + 3 for v in m] for m in c]
    again, _, _, taken = yinyang.State(moved, c, group).assigned(x, cluster, upper, lower)
    assert taken < 0.1 * 24 * 4000 and (again == yinyang.squares(x, np.array(moved)).argmin(axis=1)).all()


def test_clusters_of_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [nan, 1.0]), (3, None), (4, [None, 1.0]), (5, [1.0]), (6, []), (7, [-inf, 0.0]), (None, [1.0, 1.0]), (8, [1e30, -1e30]), (9, [-0.01, 0.0])]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("v", F.lit(1))
    v = yinyang.quantized(given, dims=2)
    assert sorted((r.vec_id, r.v) for r in v.collect()) == [(1, [6.0, 12.0]), (1, [6.0, 12.0]), (8, [2.0**27, -(2.0**27)]), (9, [-1.0, 0.0])]
    found = yinyang.clustered(v, 16, 3).collect()
    assert sorted(r.vec_id for r in found) == [1, 1, 8, 9] and {r.distance for r in found} == {0} and len({r.cluster for r in found}) == 3
    assert yinyang.clustered(v.limit(0)).count() == 0
