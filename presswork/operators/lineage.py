"""Cutting the lineage of a loop's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Spark's own setting: shuffle files of a query go when it ends, not when the driver next collects its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shared_folder(df: DataFrame) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on a local master without one, a folder of one's own."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="presswork-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    _shared_folder(df)
    return df.checkpoint()


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, packed and read by columns; the shuffles that led to it go once it is written."""
    spark = df.sparkSession
    path = f"{_shared_folder(df)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
