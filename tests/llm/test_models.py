"""The mixing and quality operators against plain numpy."""

import math
import random
import re
import warnings
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import mixing, quality


def plain_words(text):
    return [w for w in re.split(r"[ \t\n\x0B\f\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def plain_members(texts, labels, bucket):
    """doc_id -> text, doc_id -> domain, word -> bucket: naive Bayes posteriors of all documents, and the domains."""
    domains = sorted(set(labels.values()))
    counts, sizes = defaultdict(Counter), Counter(labels.values())
    for i, d in labels.items():
        for w in set(plain_words(texts[i])):
            counts[d][bucket[w]] += 1
    tokens = {d: sum(counts[d].values()) for d in domains}
    score = lambda d, b: float(np.float32(math.log((counts[d][b] + 0.5) / (tokens[d] + 0.5 * mixing.BUCKETS))))
    out = {}
    for i, text in texts.items():
        w = plain_words(text)
        kinds = set(w)
        damp = math.sqrt(min(1.0, 400 / max(1, len(kinds))))
        z = np.array([damp * sum(score(d, bucket[x]) for x in kinds) + math.log(sizes[d] / sum(sizes.values())) for d in domains])
        e = np.exp(z - z.max())
        out[i] = (len(w), e / e.sum())
    return out, domains


def plain_rates(members, domains, targets, budget):
    n = np.array([members[i][0] for i in members], float)
    p = np.array([members[i][1] for i in members])
    have = (n[:, None] * p).sum(axis=0)
    share = {d: v for d, v in targets.items() if d in domains and have[domains.index(d)] > 0}
    scale = sum(share.values())
    least = 0.0 if budget else 1.0
    budget = budget or max(have[domains.index(d)] * scale / v for d, v in share.items())
    bounds = (n[:, None, None] * p[:, :, None] * p[:, None, :]).sum(axis=(0, 2))
    goal = np.array([budget * share[d] / scale if d in share else have[i] for i, d in enumerate(domains)])
    r, now, before = np.ones(len(n)), have, np.full(len(domains), np.inf)
    near = lambda a, b: np.abs(a - b).max() <= mixing.TOLERANCE * max(budget, 1)
    steps = 0
    while not near(now, goal) and not near(now, before) and steps < mixing.STEPS:
        r = np.maximum(least, r - p @ ((now - goal) / bounds))
        now, before, steps = (r * n) @ p, now, steps + 1
    return dict(zip(members, r)), now, goal


def corpus(seed, n=70):
    rnd = random.Random(seed)
    words = {d: [f"{d}{i}" for i in range(30)] for d in ("de", "en", "fr")} | {"all": [f"x{i}" for i in range(40)]}
    texts, labels = {}, {}
    for i in range(n):
        d = rnd.choice(["de", "en", "en", "fr"])
        k = rnd.choice([0, 1, 5, 40, 900])
        texts[i] = " ".join(rnd.choices(words[d], k=k) + rnd.choices(words["all"], k=k)) or rnd.choice([None, "", " \n"])
        if i % 3:
            labels[i] = d
    return texts, labels


@pytest.mark.parametrize("targets,budget", [({"de": 0.5, "en": 0.25, "fr": 0.25}, None), ({"de": 1, "en": 1, "fr": 2}, 9000.0), ({"en": 0.9, "fr": 0.1}, None)])
def test_posteriors_and_rates_are_those_of_plain_numpy(spark, targets, budget):
    texts, labels = corpus(5)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labelled = spark.createDataFrame(list(labels.items()), "doc_id long, domain string")
    vocabulary = sorted({w for t in texts.values() for w in plain_words(t)})
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", mixing._bucket(F.col("w")).alias("b")).collect()}
    members, domains = plain_members(texts, labels, bucket)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found, names = mixing.mixing_rates(docs, labelled, targets, budget)
    assert names == domains
    rates, now, goal = plain_rates(members, domains, targets, budget)
    got = {r.doc_id: r for r in found.collect()}
    assert got.keys() == texts.keys()
    for i, (n, p) in members.items():
        assert got[i].n == n and got[i].p == pytest.approx(p.tolist(), abs=1e-6) and got[i].rate == pytest.approx(rates[i], rel=1e-4, abs=1e-4)
    if budget:
        assert now == pytest.approx(goal, rel=1e-3)


def test_slopes_of_the_cumulative_link():
    """The step's gradients are those of the log likelihood, by differences."""
    t, grades = np.array([-0.7, 0.4]), 3
    sig = lambda x: 1 / (1 + math.exp(-x))

    def loss(s, t, y):
        up = sig(s - t[y - 1]) if y else 1.0
        down = sig(s - t[y]) if y < grades - 1 else 0.0
        return -math.log(up - down)

    for y in range(grades):
        size = (1 << quality.BITS) + quality.SHAPES
        z, n, t1, t_n = np.zeros(size), np.zeros(size), t.copy(), np.zeros(2)
        at = (1 << quality.BITS) + 1  # bears no L1
        n[at] = 4.0
        z[at] = -0.8
        s = float(quality.weights_of(z, n, np.array([at]))[0]) * 2.0
        quality._pass([(np.array([at]), np.array([2.0]), y, 1.5)], z, n, t1, t_n, grades)
        h = 1e-6
        slope = (loss(s + h, t, y) - loss(s - h, t, y)) / (2 * h) * 1.5 * 2.0
        assert n[at] - 4.0 == pytest.approx(slope**2, rel=1e-5)
        moved = slope - (math.sqrt(4 + slope**2) - 2) / quality.ALPHA * s / 2.0
        assert z[at] + 0.8 == pytest.approx(moved, rel=1e-5)
        for k in range(2):
            a, b = t.copy(), t.copy()
            a[k], b[k] = a[k] + h, b[k] - h
            d = (loss(s, a, y) - loss(s, b, y)) / (2 * h) * 1.5
            assert t_n[k] == pytest.approx(d * d, rel=1e-4, abs=1e-9)
            if d:
                assert t1[k] - t[k] == pytest.approx(-0.1 * np.sign(d), rel=1e-3)


def plain_fit(rows, parts, grades, rounds):
    """Rows doc_id -> (indices, values, grade), doc_id -> part: states of each part averaged by its size, round after round; dictionaries of floats."""
    counts = Counter(y for _, _, y in rows.values())
    weight = {g: (len(rows) / (len(counts) * c)) ** 0.5 for g, c in counts.items()}
    z, n, t, t_n = {}, {}, [-1.0, 1.0] if grades == 3 else [0.0], [0.0] * (grades - 1)
    sig = lambda x: 1 / (1 + math.exp(-min(40.0, max(-40.0, x))))

    def w_of(z, n, i):
        l1 = quality.L1 if i < 1 << quality.BITS else 0.0
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((1 + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(rounds):
        states = []
        for part in sorted(set(parts.values())):
            mine = sorted(i for i in rows if parts[i] == part)
            z1, n1, t1, tn1 = dict(z), dict(n), list(t), list(t_n)
            for i in mine:
                idx, val, y = rows[i]
                w = {j: w_of(z1, n1, j) for j in idx}
                s = sum(w[j] * v for j, v in zip(idx, val))
                up = sig(s - t1[y - 1]) if y else 1.0
                down = sig(s - t1[y]) if y < grades - 1 else 0.0
                for j, v in zip(idx, val):
                    g = -weight[y] * (1 - up - down) * v
                    z1[j] = z1.get(j, 0.0) + g - (math.sqrt(n1.get(j, 0.0) + g * g) - math.sqrt(n1.get(j, 0.0))) / quality.ALPHA * w[j]
                    n1[j] = n1.get(j, 0.0) + g * g
                p = max(up - down, 1e-6)
                for k, d in ((y - 1, up * (1 - up) / p), (y, -down * (1 - down) / p)):
                    if 0 <= k < grades - 1:
                        d *= weight[y]
                        tn1[k] += d * d
                        t1[k] -= 0.1 * d / math.sqrt(tn1[k] + 1e-8)
                t1.sort()
            states.append((len(mine), z1, n1, t1, tn1))
        total = sum(s[0] for s in states)
        mean = lambda k: {j: sum(s[0] / total * s[k].get(j, 0.0) for s in states) for j in {j for s in states for j in s[k]}}
        z, n = mean(1), mean(2)
        t, t_n = ([sum(s[0] / total * s[k][j] for s in states) for j in range(grades - 1)] for k in (3, 4))
    return {j: w_of(z, n, j) for j in z}, sorted(t)


def test_the_fit_and_its_scores_are_those_of_plain_python(spark):
    rnd = random.Random(8)
    good, bad = [f"good{i}" for i in range(20)], [f"BAD{i}!!" for i in range(20)]
    texts, grades = {}, {}
    for i in range(90):
        y = rnd.choice([0, 1, 2])
        texts[i] = " ".join(rnd.choices(bad, k=6 * (2 - y)) + rnd.choices(good, k=6 * y) + rnd.choices(["a", "b", "c"], k=5))
        if i % 4:
            grades[i] = y
    texts |= {90: None, 91: ""}
    grades[91] = 0
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    model = quality.fit(docs, spark.createDataFrame(list(grades.items()), "doc_id long, grade int"), 3, rounds=2)
    parts = {r.i: r.p for r in spark.createDataFrame([(i,) for i in grades], "i long").select("i", F.pmod(F.xxhash64("i"), F.lit(quality.PARTS)).alias("p")).collect()}
    cache = quality.Features()
    found = {i: quality.features((texts[i] or "").encode(), cache) for i in texts}
    rows = {i: (found[i][0].tolist(), np.float32(found[i][1]).astype(float).tolist(), y) for i, y in grades.items()}
    w, t = plain_fit(rows, parts, 3, 2)
    assert list(model.t) == pytest.approx(t, rel=1e-9)
    got = {r.doc_id: r for r in quality.scored(docs, model, 3).collect()}
    assert got.keys() == texts.keys()
    for i in texts:
        s = sum(w.get(j, 0.0) * v for j, v in zip(*(x.tolist() for x in found[i])))
        tails = [1 / (1 + math.exp(k - s)) for k in t]
        assert got[i].expected_grade == pytest.approx(sum(tails), abs=1e-9) and got[i].p_best == pytest.approx(tails[-1], abs=1e-9)
