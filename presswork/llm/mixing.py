"""Soft-membership mixing to target weights (operator 3), in DataFrame functions only.

1. `classifier`: a labelled table (doc_id, domain) and the documents give a
   naive Bayes model over hashed words. It is fitted on at most max_rows
   labelled documents (a documented bound); BUCKETS rows whatever the input.
2. `memberships`: for every document its number of words and its posterior of
   each domain, from all its words.
3. `rates`: document rates r >= 1 (r >= 0 for a given budget) by projected gradient on
   the squared distances of sum_i r_i n_i p_i from T, the targets times the
   budget of tokens. A step needs only the K sums over all documents of r n p:
   one small aggregate. A document's rate is a fold over the K residuals of
   each step so far, so nothing but the memberships is ever stored. The
   gradient is taken in the metric 1 / n_i (rates of long documents would
   otherwise move alone), and a domain's squares weigh by the inverse of its
   column sum D_k of G = sum_i n_i p_i p_i': as diag(D) - G is positive
   semidefinite, a step of 1 never overshoots.
4. `mixed` repeats each document floor(rate) times, and once more with the
   remainder as probability, decided by a hash of its id.

Null and empty texts have no words: their posterior is the prior, and their rate
follows from it as any other. Rows without doc_id take no part in rates; `mixed` passes
them once. Equal rows count once in the fit and are repeated each. A domain with a target but no labelled
documents has posterior 0 everywhere and is left out of the fit. Without
labels every rate is 1.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import staged

BUCKETS = 1 << 14
MAX_ROWS = 20_000
STEPS = 40
#: of the budget: totals that move or miss by no more are at rest
TOLERANCE = 1e-5
P = "__mix_"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; an empty array for none."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lower, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def classifier(docs: DataFrame, labelled: DataFrame, max_rows: int = MAX_ROWS, smooth: float = 0.5) -> tuple[DataFrame, dict[str, float]]:
    """(bucket, scores array<float>) with a log probability for each domain, and the domains' priors, in order."""
    picked = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = picked.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", "text").join(picked, "doc_id").select("domain", F.array_distinct(words(F.col("text"))).alias("w"))
    found = staged(found.select("domain", F.explode_outer("w").alias("w")).groupBy("domain", F.when(F.col("w").isNotNull(), _bucket(F.col("w"))).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "counts")
    tokens = {r.domain: r.n for r in found.groupBy("domain").agg(F.sum(F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0)).alias("n")).collect()}
    domains = sorted(tokens)
    sizes = dict(docs.select("doc_id").join(picked, "doc_id").groupBy("domain").count().collect())
    total = sum(sizes.values())
    priors = {d: sizes[d] / total for d in domains}
    each = [F.ln((F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)) + smooth) / (tokens[d] + smooth * BUCKETS)).cast("float") for d in domains]
    model = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(found.where("bucket is not null"), "bucket", "left")
    return model.groupBy("bucket").agg(F.array(*each).alias("scores") if domains else F.array().cast("array<float>").alias("scores")), priors


def memberships(docs: DataFrame, model: DataFrame, priors: dict[str, float]) -> DataFrame:
    """(doc_id, row_id, n, p array<double>) of every document with an id."""
    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_id"), words(F.col("text")).alias("w"))
    counted = given.select("doc_id", "row_id", F.size("w").cast("long").alias("n"), F.explode_outer(F.array_distinct("w")).alias("w"))
    # BUCKETS rows of a few floats, whatever the input
    scored = counted.withColumn("bucket", F.when(F.col("w").isNotNull(), _bucket(F.col("w")))).join(F.broadcast(model), "bucket", "left")
    sums = [F.sum(F.coalesce(F.col("scores")[k].cast("double"), F.lit(0.0))).alias(f"s{k}") for k in range(len(priors))]
    logs = scored.groupBy("doc_id", "row_id", "n").agg(F.count(F.lit(1)).alias("words"), *sums)
    # a word's evidence is shared with its neighbours': the sum is damped so that long texts stay soft
    damp = F.sqrt(F.least(F.lit(1.0), 400.0 / F.col("words")))
    z = F.array(*[F.col(f"s{k}") * damp + math.log(v) for k, v in enumerate(priors.values())])
    soft = logs.withColumn("z", z).withColumn("m", F.array_max("z")).withColumn("e", F.expr("transform(z, x -> exp(x - m))"))
    return soft.select("doc_id", "row_id", "n", F.expr("transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y))").alias("p"))


def _rate(steps: list[list[float]], least: float) -> Column:
    """The rate after steps projected onto r >= least: each row is step size times residual by domain."""
    if not steps:
        return F.lit(1.0)
    done = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    dot = lambda s: F.aggregate(F.zip_with("p", s, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(done, F.lit(1.0), lambda r, s: F.greatest(F.lit(least), r - dot(s)))


def rates(members: DataFrame, domains: list[str], targets: dict[str, float], budget: float | None = None, steps: int = STEPS) -> DataFrame:
    """Adds rate to members (n, p): rates whose expected domain tokens meet targets times the budget.

    targets need not sum to 1; domains without one keep what they have. budget
    is in tokens; by default the smallest for which no domain has to shrink, and
    no rate is less than 1. With a budget rates may fall to 0.
    """
    if not domains:
        return members.withColumn("rate", F.lit(1.0))
    k = len(domains)
    sums = lambda rate: [F.coalesce(F.sum(rate * F.col("n") * F.col("p")[i]), F.lit(0.0)) for i in range(k)]
    grams = [F.coalesce(F.sum(F.col("n") * F.col("p")[i] * F.col("p")[j]), F.lit(0.0)) for i in range(k) for j in range(k)]
    first = list(members.agg(*sums(F.lit(1.0)), *grams).first())
    have, gram = first[:k], first[k:]
    share = {d: v for d, v in targets.items() if d in domains and have[domains.index(d)] > 0}
    scale = sum(share.values()) or 1.0
    least = 1.0 if budget is None else 0.0
    if budget is None:
        budget = max([have[domains.index(d)] * scale / v for d, v in share.items() if v > 0], default=0.0)
    goal = [budget * share[d] / scale if d in share else have[i] for i, d in enumerate(domains)]
    bounds = [sum(gram[i * k : i * k + k]) for i in range(k)]
    done: list[list[float]] = []
    now, before = have, [math.inf] * k
    near = lambda x, y: max(abs(a - b) for a, b in zip(x, y)) <= TOLERANCE * max(budget, 1.0)
    while not near(now, goal) and not near(now, before):  # where the bound on rates keeps the goal out of reach, the totals come to rest before it
        if len(done) == steps:
            warnings.warn(f"the rates did not come to rest in {steps} steps: domain tokens {now}, goal {goal}")
            break
        done.append([(x - g) / b if b > 0 else 0.0 for x, g, b in zip(now, goal, bounds)])
        now, before = list(members.agg(*sums(_rate(done, least))).first()), now
    return members.withColumn("rate", _rate(done, least))


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None) -> tuple[DataFrame, list[str]]:
    """(doc_id, row_id, n, p, rate), and the domains in the order of p."""
    model, priors = classifier(docs, labelled)
    members = staged(memberships(docs, staged(model, "model"), priors), "members")
    return rates(members, list(priors), targets, budget), list(priors)


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None) -> DataFrame:
    """The documents, each as often as its rate says."""
    found, _ = mixing_rates(docs, labelled, targets, budget)
    part = F.pmod(F.xxhash64(F.lit(33), "doc_id", "row_id"), F.lit(1 << 20)) / float(1 << 20)
    times = found.select(F.col("doc_id").alias(P + "doc_id"), F.col("row_id").alias(P + "row_id"), (F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias(P + "times")).dropDuplicates([P + "doc_id", P + "row_id"])
    joined = docs.join(times, (F.col("doc_id") == F.col(P + "doc_id")) & (F.xxhash64("text") == F.col(P + "row_id")), "left")
    times_ = F.coalesce(F.col(P + "times"), F.lit(1))
    return joined.where(times_ > 0).withColumn(P + "copy", F.explode(F.array_repeat(F.lit(0), times_))).select(docs.columns)
