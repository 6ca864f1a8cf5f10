"""Logs of runs and steps, and snapshots of the backlog: append-only tables that a repeated append leaves as they are."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ["debug", "info", "warn", "error"]
STAGES = ["ingest", "embed", "cluster", "assemble", "recluster"]
STEP_KEYS = ["run_id", "step"]


def steps(rows: DataFrame) -> DataFrame:
    """Step events (run_id, step, stage, level, payload as JSON, ...) with the payload as a variant; what is no JSON becomes null, an unknown stage or level takes the row out."""
    return rows.where(F.col("stage").isin(STAGES) & F.col("level").isin(LEVELS)).withColumn("payload", F.try_parse_json(F.coalesce("payload", F.lit("{}"))))


def logged(spark: SparkSession, folder: str) -> DataFrame | None:
    """What a log holds, None before the first append."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append_new(rows: DataFrame, folder: str, keys: list[str]) -> None:
    """Appends the rows whose keys the log does not have yet, one for each key. One writer a log, as a log has one pipeline."""
    old = logged(rows.sparkSession, folder)
    new = rows.dropDuplicates(keys)
    if old is not None:
        new = new.join(old.select(keys), keys, "left_anti").select(rows.columns)
    new.write.mode("append").parquet(folder)


def snapshot(gauges: DataFrame, captured_at: Column, folder: str) -> None:
    """Appends a row of gauges (see state.backlog) as of a time; of one time there is one row."""
    append_new(gauges.select(captured_at.alias("captured_at"), *gauges.columns), folder, ["captured_at"])


def number_at(payload: Column, path: str) -> Column:
    """The number at a path of a variant; null for what is missing or no number, texts of digits included."""
    kind = F.schema_of_variant(F.try_variant_get(payload, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(payload, path, "double"))


def ingest_rate(summary: Column) -> Column:
    return F.coalesce(number_at(summary, "$.ingest.ingestedPerMinute"), number_at(summary, "$.ingestedPerMinute"))


def stage_rate(summary: Column, stage: str) -> Column:
    return number_at(summary, f"$.{stage}.processedPerMinute")


def latest_rates(runs: DataFrame, key: str) -> DataFrame:
    """(key, ingest, embed, cluster, assemble) from runs (key, started_at, run_id, summary variant): of each the newest that any run tells."""
    rates = {"ingest": ingest_rate(F.col("summary"))} | {s: stage_rate(F.col("summary"), s) for s in STAGES[1:4]}
    r = runs.select(key, F.struct("started_at", "run_id").alias("at"), *[v.alias(s) for s, v in rates.items()])
    return r.groupBy(key).agg(*[F.max_by(s, F.when(F.col(s).isNotNull(), F.col("at"))).alias(s) for s in rates])


def step_widths(rows: DataFrame, run: str, duration: str) -> DataFrame:
    """Adds `width`: a step's duration as percent of the longest of its run, 2 at least."""
    longest = rows.groupBy(run).agg(F.max(duration).alias("_longest"))
    width = F.when(F.col("_longest") > 0, F.greatest(100.0 * F.coalesce(duration, F.lit(0)) / F.col("_longest"), F.lit(2.0))).otherwise(2.0)
    return rows.join(longest, run).withColumn("width", width).drop("_longest")
