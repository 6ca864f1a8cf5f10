"""Ratings of sources by outside providers: their vocabularies, lookup by domain, consensus, sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..enums import BIASES, FACTUALITY
from ..functions import text as tx
from ..functions.basics import half_up, lookup, ordinal, pick

# The providers' names of our levels. Names that are not listed have no level.
PROVIDER_BIASES = {
    "mbfc": {
        "extreme-left": "far-left",
        "left": "left",
        "left-center": "lean-left",
        "center": "center",
        "pro-science": "center",
        "right-center": "lean-right",
        "right": "right",
        "extreme-right": "far-right",
    },
    "allsides": {"left": "left", "lean-left": "lean-left", "center": "center", "lean-right": "lean-right", "right": "right"},
}
PROVIDER_FACTUALITY = {"mbfc": {"very-high": "very-high", "high": "high", "mostly-factual": "high", "mixed": "mixed", "low": "low", "very-low": "very-low"}}
#: An entry of these kinds counts as no entry.
SKIPPED = {"mbfc": ["questionable", "satire", "conspiracy-pseudoscience"]}
#: Providers whose entries count only with a bias that has a level.
BIAS_REQUIRED = ["allsides"]


def _level(maps: dict[str, dict[str, str]], column: str) -> Column:
    out = F.lit(None).cast("string")
    for provider, names in maps.items():
        out = F.when(F.col("provider") == provider, lookup(F.col(column), names)).otherwise(out)
    return out


def rated(entries: DataFrame) -> DataFrame:
    """(provider, domain, bias, factuality) in our levels, from entries (provider, position, url, bias, factuality): the last of a domain counts."""
    last = entries.withColumn("domain", tx.domain(F.col("url"))).where("domain <> ''").groupBy("provider", "domain").agg(F.max_by(F.struct("bias", "factuality"), "position").alias("r"))
    skipped = F.lit(False)
    for provider, kinds in SKIPPED.items():
        skipped = skipped | ((F.col("provider") == provider) & F.coalesce(F.col("bias").isin(kinds), F.lit(False)))
    ours = last.select("provider", "domain", "r.*").where(~skipped)
    ours = ours.select("provider", "domain", _level(PROVIDER_BIASES, "bias").alias("bias"), _level(PROVIDER_FACTUALITY, "factuality").alias("factuality"))
    return ours.where(~F.col("provider").isin(BIAS_REQUIRED) | F.col("bias").isNotNull())


def consensus(level: str, scale: list[str]) -> Column:
    """Aggregate: the median of the levels on their scale, half up; null where there are none."""
    at = F.when(ordinal(F.col(level), scale) >= 0, ordinal(F.col(level), scale))
    return F.when(F.count(at) > 0, pick(scale, half_up(F.median(at))))  # Spark takes a median for never null


def synced(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """(source_id, outcome, n_ratings, bias, factuality) for sources (source_id, url, bias, factuality, bias_override).

    Sources without a URL are skipped, those with an override keep their
    levels, those that no provider rates are unmatched; the others take the
    consensus where there is one.
    """
    asked = sources.where("url <> ''").select("source_id", tx.domain(F.col("url")).alias("domain"))
    found = asked.join(rated(entries), "domain").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), consensus("bias", BIASES).alias("_bias"), consensus("factuality", FACTUALITY).alias("_factuality"))
    fixed = F.coalesce("bias_override", F.lit(False))
    outcome = F.when(F.coalesce("url", F.lit("")) == "", "skipped").when(fixed, "overridden").when(F.col("n").isNull(), "unmatched").otherwise("updated")
    taken = lambda c: F.when(fixed, F.col(c)).otherwise(F.coalesce(f"_{c}", c)).alias(c)
    return sources.join(found, "source_id", "left").select("source_id", outcome.alias("outcome"), F.coalesce("n", F.lit(0)).alias("n_ratings"), taken("bias"), taken("factuality"))
