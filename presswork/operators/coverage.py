"""Coverage metrics of stories from their articles: spectrum, blindspot, velocity, impact, controversy, trending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..enums import BIASES, FACTUALITY, LEFT, OWNERSHIP, RIGHT
from ..functions.basics import dealt, half_up, hours_between, lookup, ordinal, percent


def spectrum(articles: DataFrame, key: str = "story_id") -> DataFrame:
    """(key, bias, n, percentage): share of each bias with any article; null biases count in no bucket."""
    counted = articles.where("bias is not null").groupBy(key, "bias").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(key))
    return counted.withColumn("percentage", percent(F.col("n"), whole))


def _bias_counts() -> list[Column]:
    return [F.count_if(F.col("bias") == b).alias(f"n{i}") for i, b in enumerate(BIASES)]


def _spectrum() -> Column:
    whole = sum((F.col(f"n{i}") for i in range(1, len(BIASES))), F.col("n0"))
    parts = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(b).alias("bias"), percent(F.col(f"n{i}"), whole).alias("percentage"), F.col(f"n{i}").alias("n")) for i, b in enumerate(BIASES)])
    return F.filter(parts, lambda s: s["n"] > 0)


def spectrum_arrays(articles: DataFrame, key: str = "story_id") -> DataFrame:
    """(key, spectrum): array of (ordinal, bias, percentage) from far left to far right, from one grouped pass."""
    return articles.groupBy(key).agg(*_bias_counts()).select(key, _spectrum().alias("spectrum"))


def side(spectrum_: Column, biases: list[str]) -> Column:
    """Percentage of some biases in an array of (bias, percentage)."""
    return F.aggregate(F.filter(spectrum_, lambda s: s["bias"].isin(biases)), F.lit(0), lambda a, s: a + s["percentage"])


def blindspot(spectrum_: Column, n_sources: Column) -> Column:
    """Four fifths of the coverage on one side, unless there is one source only."""
    return (n_sources > 1) & ((side(spectrum_, LEFT) >= 80) | (side(spectrum_, RIGHT) >= 80))


def diversity_factor(spectrum_: Column) -> Column:
    """0.5 to 1 by the entropy of the spectrum; 0.5 for none or one bucket."""
    kept = F.filter(F.coalesce(spectrum_, F.array().cast("array<struct<ordinal:int,bias:string,percentage:int,n:bigint>>")), lambda s: s["percentage"] > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda a, s: a + s["percentage"])
    entropy = F.aggregate(kept, F.lit(0.0), lambda a, s: a - s["percentage"] / total * F.ln(s["percentage"] / total))
    return F.when(F.size(kept) > 1, 0.5 + 0.5 * entropy / F.ln(F.size(kept).cast("double"))).otherwise(0.5)


def _measures(as_of: Column) -> list[Column]:
    age = hours_between(F.col("published_at"), as_of)
    return [
        F.count(F.lit(1)).alias("n_articles"),
        F.count_if("_first").alias("n_sources"),
        F.bit_count(F.bit_or("_kinds")).cast("long").alias("source_diversity"),
        F.count_if(age <= 24).alias("articles_24h"),
        F.count_if(age <= 48).alias("articles_48h"),
        F.count_if(age <= 168).alias("articles_7d"),
        F.min("published_at").alias("first_article"),
        F.max("published_at").alias("last_article"),
    ]


def _by_key(articles: DataFrame, key: str, *columns: str) -> DataFrame:
    """Narrow rows (key, published_at, columns, _first, _kinds), those of a key together: _first marks one article of each source, _kinds has a bit for its kind of ownership.

    Ownership is a closed vocabulary; what is not of it counts as one kind. A
    distinct count would hold every source of every key with all other sums.
    """
    kind = F.when(F.col("ownership").isNull(), 0).otherwise(F.coalesce(lookup(F.col("ownership"), {v: 2 << i for i, v in enumerate(OWNERSHIP)}), F.lit(1)))
    rows = dealt(articles.select(key, "source_id", "published_at", *columns, kind.alias("_kinds")), key)
    first = F.row_number().over(Window.partitionBy(key, "source_id").orderBy("source_id"))
    return rows.withColumn("_first", (first == 1) & F.col("source_id").isNotNull())


def _measured(base: DataFrame) -> DataFrame:
    hours = F.when(F.col("n_articles") < 2, 0.0).otherwise(hours_between(F.col("first_article"), F.col("last_article")))
    out = base.withColumn("coverage_hours", hours)
    return out.withColumn("impact_score", impact(F.col("n_sources"), F.col("articles_24h"), F.col("coverage_hours"), F.col("source_diversity")))


def metrics(articles: DataFrame, as_of: Column, key: str = "story_id") -> DataFrame:
    """One grouped pass: counts, velocity, diversity of owners, duration, and impact with what it is made of."""
    return _measured(_by_key(articles, key).groupBy(key).agg(*_measures(as_of)))


def facts(articles: DataFrame, as_of: Column, key: str = "story_id") -> DataFrame:
    """metrics and spectrum_arrays of each key from the same pass."""
    place = ordinal(F.col("bias"), BIASES).cast("byte")
    counts = [F.count_if(F.col("_bias") == i).alias(f"n{i}") for i in range(len(BIASES))]
    base = _by_key(articles.withColumn("_bias", place), key, "_bias").groupBy(key).agg(*_measures(as_of), *counts)
    return _measured(base.withColumn("spectrum", _spectrum()).drop(*[f"n{i}" for i in range(len(BIASES))]))


def impact(sources: Column, articles_24h: Column, hours: Column, diversity: Column) -> Column:
    one = F.lit(1.0)
    return half_up(100 * (0.3 * F.least(sources / 20, one) + 0.3 * F.least(articles_24h / 10, one) + 0.2 * F.least(hours / 168, one) + 0.2 * F.least(diversity / 6, one)))


def phase(articles_24h: Column, articles_7d: Column, story_age_hours: Column) -> Column:
    """Narrative phase, first match in this order."""
    breaking = (articles_24h >= 3) & (story_age_hours < 24)
    developing = (articles_24h >= 1) & (story_age_hours < 168)
    return F.when(breaking, "breaking").when(developing, "developing").when((articles_24h == 0) & (articles_7d >= 2), "analysis").otherwise("aftermath")


def words_of_framing(text: Column) -> Column:
    """Distinct words of more than two characters, other characters deleted."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9\\s]", ""), "\\s+"), lambda w: F.length(w) > 2))


def controversy(left: Column, right: Column) -> Column:
    """Symmetric difference over union of both sides' words, two decimals; 0 for no words."""
    union = F.size(F.array_union(left, right))
    apart = F.size(F.array_except(left, right)) + F.size(F.array_except(right, left))
    return F.when(union > 0, half_up(F.least(apart / union, F.lit(1.0)), 2)).otherwise(0.0)


def trending(impact_: Column, articles_24h: Column, factor: Column, age: Column, viewers: Column) -> Column:
    """Impact by velocity, diversity, decay and engagement; 0 without impact."""
    score = impact_ * (1 + F.log10(F.greatest(articles_24h, F.lit(1)).cast("double"))) * factor * F.pow(F.greatest(age, F.lit(0.0)) + 2, F.lit(-1.5)) * (1 + F.log10(1.0 + viewers))
    return F.when(impact_ <= 0, 0.0).otherwise(score)


def dominant(rows: DataFrame, key: str, value: str, values: list[str]) -> DataFrame:
    """(key, value, n): the most frequent value, ties to the first in the vocabulary's order."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(key).agg(F.max(F.struct("n", (-ordinal(F.col(value), values)).alias("o"), value)).alias("best"))
    return best.select(key, F.col(f"best.{value}").alias(value), F.col("best.n").alias("n"))


def dominant_or_null(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n, total): the most frequent value, null where the first place is shared."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return first_or_null(counted.where(F.col(key).isNotNull()), key, value, "n").select(key, value, F.col("top").alias("n"), "total")


def first_or_null(votes: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, value, top, total) of votes (key, value, weight), each value of a key once: the value of the largest weight, null where the first place is shared."""
    # the last and the first value of the largest weight are the same one, or there are several
    best = votes.groupBy(key).agg(F.max(F.struct(weight, value)).alias("hi"), F.min(F.struct((-F.col(weight)).alias("w"), value)).alias("lo"), F.sum(weight).alias("total"))
    return best.select(key, F.when(F.col(f"hi.{value}") == F.col(f"lo.{value}"), F.col(f"hi.{value}")).alias(value), F.col(f"hi.{weight}").alias("top"), "total")


def lanes(spectrum_: Column) -> Column:
    """(left, center, right, dominant): shares of three lanes; ties go to the center, then to the right."""
    l, c, r = side(spectrum_, LEFT), side(spectrum_, ["center"]), side(spectrum_, RIGHT)
    top = F.greatest(l, c, r)
    return F.struct(l.alias("left"), c.alias("center"), r.alias("right"), F.when(c == top, "center").when(r == top, "right").otherwise("left").alias("dominant"))


def buckets(biases: Column) -> Column:
    """How many of left, center and right an array of biases touches."""
    has = lambda values: F.arrays_overlap(biases, F.array(*map(F.lit, values))).cast("int")
    return has(LEFT) + has(["center"]) + has(RIGHT)


def largest_remainder(rows: DataFrame, key: str, n: str, order: str) -> DataFrame:
    """Adds `share`: whole percents that sum to 100 per key, what is missing going to the largest remainders, then by `order`."""
    whole = F.sum(n).over(Window.partitionBy(key))
    exact = 100.0 * F.col(n) / whole
    out = rows.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    missing = 100 - F.sum("_floor").over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_rest"), order))
    return out.withColumn("share", (F.col("_floor") + (rank <= missing).cast("int")).cast("int")).drop("_floor", "_rest")


#: rows of a key in one batch from which they go on as their sums
COMBINED = 8
SUMS = "_w double, _v array<double>, _sums binary"


def _summed(codes, n: int, weights, vectors):
    """(n, 5, length) sums over the rows of each code and place: rows, weight, weighted value, value, values that are not null."""
    import numpy as np

    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten()
    length = int(sizes.max(initial=0))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = codes[row] * length + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    good = np.asarray(flat.is_valid())
    x = flat.fill_null(0).to_numpy(zero_copy_only=False)
    w = weights[row]
    total = lambda v=None: np.bincount(at, v, n * length).reshape(n, length)
    return np.stack([total(), total(w), total(w * x), total(x), total(good.astype(float))], axis=1)


def _added(a, b):
    import numpy as np

    out = np.zeros((5, max(a.shape[1], b.shape[1])))
    out[:, : a.shape[1]] += a
    out[:, : b.shape[1]] += b
    return out


def _combine(batches):
    """Rows (key, weight, vector) -> (key, SUMS): keys that a batch has often as one row of sums, others as they are."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        named = batch.column(0).dictionary_encode("encode")
        codes, n = named.indices.to_numpy(), len(named.dictionary)
        often = np.bincount(codes, minlength=n) >= COMBINED
        single = pa.array(np.flatnonzero(~often[codes]))
        raw = batch.take(single)
        yield pa.RecordBatch.from_arrays([raw.column(0), raw.column(1), raw.column(2), pa.nulls(len(single), pa.binary())], names=[batch.schema.names[0], "_w", "_v", "_sums"])
        if often.any():
            part = batch.take(pa.array(np.flatnonzero(often[codes])))
            place = np.cumsum(often) - 1
            sums = _summed(place[codes[often[codes]]], int(often.sum()), part.column(1).to_numpy(), part.column(2))
            k = len(sums)
            yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(np.flatnonzero(often))), pa.nulls(k, pa.float64()), pa.nulls(k, raw.column(2).type), pa.array([s.tobytes() for s in sums], pa.binary())], names=[batch.schema.names[0], "_w", "_v", "_sums"])


def _centroids(batches):
    """Rows (key, SUMS[, place]) with those of a key together -> (key, centroid); of a key no more than its sums are held. Where rows are numbered, a key that does not begin with its first is an error."""
    import numpy as np
    import pyarrow as pa

    def shown(keys, sums):
        kept = [i for i, s in enumerate(sums) if (s[0] > 0).any()]
        cut = [sums[i][:, : np.flatnonzero(sums[i][0] > 0)[-1] + 1] for i in kept]
        flat = np.concatenate([*cut, np.zeros((5, 0))], axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.where(flat[1] > 0, flat[2] / flat[1], flat[3] / flat[4])
        values = pa.array(x, mask=flat[4] == 0)
        offsets = pa.array(np.concatenate([[0], np.cumsum([c.shape[1] for c in cut])]).astype(np.int32))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(kept, pa.int64())), pa.ListArray.from_arrays(offsets, values)], names=["key", "centroid"])

    held = None
    for batch in batches:
        named = batch.column(0).dictionary_encode("encode")
        codes, keys = named.indices.to_numpy(), named.dictionary
        if not len(codes):
            continue
        if batch.num_columns > 4:
            begins = np.flatnonzero(np.diff(codes, prepend=-1))
            goes_on = held is not None and held[0][0].as_py() == keys[0].as_py()
            if (batch.column(4).to_numpy()[begins[int(goes_on) :]] != 1).any():
                raise ValueError("the rows of a key are not together")
        plain = np.asarray(batch.column(3).is_null())
        raw = batch.take(pa.array(np.flatnonzero(plain)))
        sums = list(_summed(codes[plain], len(keys), raw.column(1).to_numpy(zero_copy_only=False), raw.column(2)))
        for i in np.flatnonzero(~plain):
            sums[codes[i]] = _added(sums[codes[i]], np.frombuffer(batch.column(3)[int(i)].as_py()).reshape(5, -1))
        if held is not None:
            if held[0][0].as_py() == keys[0].as_py():
                sums[0] = _added(held[1], sums[0])
            else:
                yield shown(held[0], [held[1]])
        if len(keys) > 1:
            yield shown(keys[:-1], sums[:-1])
        held = keys[-1:], sums[-1]
    if held is not None:
        yield shown(*held[:1], [held[1]])


def weighted_centroid(rows: DataFrame, key: str, vector: str, weight: str, vectors: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """(key, centroid): element-wise weighted mean; where all weights are 0 the plain one.

    Rows of a key that come together are summed ahead of the shuffle; after it
    sums are made in the order of the key, and no element is a row of its own.
    If rows have only the id (`by`) of their vector, `vectors` (by, vector) is a
    table small enough for every executor, one vector to an id, which meets them
    after the shuffle.
    """
    kind = rows.schema[key].dataType.simpleString()
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("_w")
    v = F.col(vector).cast("array<double>").alias("_v")
    if vectors is None:
        given = rows.where(F.col(vector).isNotNull()).select(key, w, v).mapInArrow(_combine, f"`{key}` {kind}, {SUMS}")
        ordered = given.repartition(F.col(key)).sortWithinPartitions(key)
    else:
        place = F.row_number().over(Window.partitionBy(key).orderBy(by, weight)).alias("_place")
        named = F.broadcast(vectors.where(F.col(by).isNotNull() & F.col(vector).isNotNull()).select(by, vector))
        ordered = rows.select(key, by, w, place).join(named, by, "left").select(key, "_w", v, F.lit(None).cast("binary").alias("_sums"), "_place")
    return ordered.mapInArrow(_centroids, f"`{key}` {kind}, centroid array<double>")


def factuality_weight(level: Column) -> Column:
    from ..enums import FACTUALITY_WEIGHTS
    from ..functions.basics import lookup

    return lookup(level, FACTUALITY_WEIGHTS)


def article_weight(level: Column, published_at: Column, as_of: Column, half_life_hours: float = 24.0) -> Column:
    """Factuality by age with a half-life; articles of the future count as new."""
    return factuality_weight(level) * F.exp(-F.ln(F.lit(2.0)) * F.greatest(hours_between(published_at, as_of), F.lit(0.0)) / half_life_hours)


def assembly_path(n_sources: Column, n_buckets: Column, min_sources: int = 3, min_buckets: int = 2, mode: str = "auto") -> Column:
    """single, rich or thin; a mode overrides."""
    if mode == "deterministic":
        return F.lit("thin")
    if mode == "model":
        return F.when(n_sources == 1, "single").otherwise("rich")
    return F.when(n_sources == 1, "single").when((n_sources >= min_sources) & (n_buckets >= min_buckets), "rich").otherwise("thin")


def publication(fallback: Column, anomaly: Column) -> Column:
    """(status, review_status, reasons, confidence) by the two reasons that call for review."""
    reasons = F.filter(F.array(F.when(fallback, "ai_fallback"), F.when(anomaly, "processing_anomaly")), lambda r: r.isNotNull())
    n = F.size(reasons)
    return F.struct(
        F.when(n > 0, "needs_review").otherwise("published").alias("status"),
        F.when(n > 0, "pending").otherwise("approved").alias("review_status"),
        reasons.alias("reasons"),
        half_up(0.9 - 0.25 * n, 2).alias("confidence"),
    )
