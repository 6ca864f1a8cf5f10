"""Latest-per-key, caps, interleaving: ranks over a complete order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; `order` from the first column on, all descending, nulls last."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return rows.withColumn("_k", rank).where("_k = 1").drop("_k")


def first_n(rows: DataFrame, keys: list[str], order: list, n: int, name: str = "k") -> DataFrame:
    """The first n rows of each key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, rank).where(F.col(name) <= n)


def newest_n(rows: DataFrame, key: str, time: str, ties: list[str], n: int = 30) -> DataFrame:
    """At most n newest rows of each key, rows without a time last."""
    return first_n(rows, [key], [F.desc_nulls_last(time), *ties], n, "_k").drop("_k")


def interleaved(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds (round, turn): the k-th row of every key comes before any key's next, keys in the order of their first row."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = F.min(F.struct(*order)).over(Window.partitionBy(key))
    return rows.withColumn("round", rank).withColumn("turn", first)


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keeps the first row of each key in a stated order, unlike dropDuplicates."""
    return first_n(rows, keys, order, 1, "_k").drop("_k")
