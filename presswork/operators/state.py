"""State of sources, queue items and the pipeline as column transitions, with `as_of` given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import hours_between

BUDGETS = {"embed": 5, "cluster": 5, "assemble": 3}


def cooldown_minutes(failures: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), F.least(failures, F.lit(8))), F.lit(240.0)).cast("int")


def auto_disabled(failures: Column, successes: Column) -> Column:
    return (failures >= 10) & (successes < 20)


def reactivated(sources: DataFrame, ids: DataFrame) -> DataFrame:
    """sources (source_id, failures, cooldown_until, disabled_at) with these cleared for the ids that are in cooldown or disabled; `cleared` tells which."""
    chosen = ids.select("source_id", F.lit(True).alias("_chosen")).distinct()
    out = sources.join(chosen, "source_id", "left")
    cleared = F.coalesce("_chosen", F.lit(False)) & ((F.col("failures") > 0) | F.col("cooldown_until").isNotNull() | F.col("disabled_at").isNotNull())
    out = out.withColumn("cleared", cleared).drop("_chosen")
    return out.withColumn("failures", F.when(F.col("cleared"), 0).otherwise(F.col("failures"))).withColumn("cooldown_until", F.when(~F.col("cleared"), F.col("cooldown_until"))).withColumn("disabled_at", F.when(~F.col("cleared"), F.col("disabled_at")))


def runs(rows: DataFrame, status: str | None, limit: int) -> DataFrame:
    """The newest runs (run_id, started_at, status), of one status if given."""
    if status:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def eligible(active: Column, disabled: Column, cooldown_until: Column, as_of: Column) -> Column:
    return active & ~disabled & (cooldown_until.isNull() | (cooldown_until <= as_of))


def backoff_seconds(retries: Column, jitter: Column | None = None, base: float = 60.0, most: float = 3600.0) -> Column:
    """base * 2^n, at most an hour, within a quarter either way by jitter from -1 to 1 (none by default)."""
    plain = F.least(base * F.pow(F.lit(2.0), retries), F.lit(most))
    return plain if jitter is None else plain * (1 + 0.25 * jitter)


def after_failure(rows: DataFrame, stage: str, as_of: Column, *more: str) -> DataFrame:
    """Items (id, retries) after a failure: next attempt, or to the dead letters when the stage's budget is spent; `more` are columns that stay."""
    n = F.col("retries") + 1
    dead = n >= BUDGETS[stage]
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff_seconds(n).cast("decimal(18,6)"))
    return rows.select("id", n.alias("retries"), F.when(dead, "dead_letter").otherwise("retry").alias("state"), F.when(~dead, as_of + wait).alias("next_attempt_at"), *more)


def claimable(rows: DataFrame, as_of: Column, ttl_minutes: int, n: int) -> DataFrame:
    """The n oldest items whose lease is free or past its time and whose next attempt is due."""
    lease = F.col("claimed_at").isNull() | (hours_between(F.col("claimed_at"), as_of) * 60 > ttl_minutes)
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= as_of)
    return rows.where(lease & due).orderBy("created_at", "id").limit(n)


def requeued(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare and set: rows (id, version, state) go back to pending with the next version where expected (id, version) still holds."""
    e = expected.select("id", F.col("version").alias("_v"))
    same = F.col("version") == F.col("_v")
    j = rows.join(e, "id", "left")
    return j.select("id", F.when(same, F.col("version") + 1).otherwise(F.col("version")).alias("version"), F.when(same, "pending").otherwise(F.col("state")).alias("state"))


def ema(durations: Column, alpha: float = 0.4) -> Column:
    """Exponential mean of an array from the oldest on; null for none."""
    return F.when(F.size(durations) > 0, F.aggregate(F.slice(durations, 2, 1_000_000), durations[0].cast("double"), lambda a, x: alpha * x + (1 - alpha) * a))


def recommended_batch(mean: Column, previous: Column, target: float, least: int, most: int) -> Column:
    """(batch, reason): shrinks by target over mean, grows by a quarter when the mean is 60 % of the target or less; what stays is under budget from 60 % on, else at its ceiling."""
    grown = F.least(F.lit(most), F.ceil(previous * 1.25).cast("int"))
    shrunk = F.greatest(F.lit(least), F.floor(previous * target / mean).cast("int"))
    batch = F.when(mean.isNull(), previous).when(mean > target, shrunk).when((mean <= target * 0.6) & (previous < most), grown).otherwise(previous)
    reason = F.when(mean.isNull(), "no_history").when(mean > target, "over_budget").when((mean <= target * 0.6) & (previous < most), F.when(grown >= most, "at_ceiling").otherwise("under_budget")).when(mean >= target * 0.6, "under_budget").otherwise("at_ceiling")
    return F.struct(batch.cast("int").alias("batch"), reason.alias("reason"))


def quota(count: Column, reset_date: Column, today: Column, limit: int) -> Column:
    """(count, allowed) of a daily counter that starts anew with the day."""
    used = F.when(reset_date == today, count).otherwise(0)
    return F.struct(F.when(used < limit, used + 1).otherwise(used).alias("count"), (used < limit).alias("allowed"))


def backlog(rows: DataFrame, as_of: Column, time: str = "created_at") -> DataFrame:
    """One pass of gauges over (embedded, clustered, assembled, reviewed flags, time)."""
    old = F.when(~F.col("assembled"), hours_between(F.col(time), as_of) * 60)
    return rows.agg(
        F.count_if(~F.col("embedded")).alias("unembedded"),
        F.count_if(F.col("embedded") & ~F.col("clustered")).alias("unclustered"),
        F.count_if(F.col("clustered") & ~F.col("assembled")).alias("unassembled"),
        F.count_if(F.col("assembled") & ~F.col("reviewed")).alias("review_queue"),
        F.greatest(F.max(old), F.lit(0.0)).alias("oldest_minutes"),
    )


def audited(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, changed, n, example): for each field how many rows (key, field, stored_<field>) differ from what is stored, null-safe; example is the smallest key that does."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), (~F.col(f).eqNullSafe(F.col(f"stored_{f}"))).alias("c")) for f in fields])
    flat = rows.select(key, F.inline(each))
    return flat.groupBy("field").agg(F.count_if("c").alias("changed"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("c"), F.col(key))).alias("example"))


def legacy_state(review_status: Column, headline: Column, has_summary: Column) -> Column:
    """(assembly_status, publication_status, review_status, review_reasons) of a story from before it had them."""

    def state(assembly: str, publication: str, review: str, *reasons: str) -> Column:
        listed = F.array(*map(F.lit, reasons)).cast("array<string>")
        return F.struct(F.lit(assembly).alias("assembly_status"), F.lit(publication).alias("publication_status"), F.lit(review).alias("review_status"), listed.alias("review_reasons"))

    return (
        F.when(review_status == "approved", state("completed", "published", "approved"))
        .when(review_status == "rejected", state("completed", "rejected", "rejected"))
        .when(headline == "Pending headline generation", state("pending", "draft", "pending"))
        .when(~F.coalesce(has_summary, F.lit(False)), state("completed", "needs_review", "pending", "legacy_data_repair"))
        .otherwise(state("completed", "needs_review", "pending", "legacy_pending_review"))
    )
