"""Pages with their exact total, and lists of ids that order and filter."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

ASC, DESC = "ascending", "descending"


def paged(rows: DataFrame, order: list[tuple[str, str]], page: int, limit: int) -> DataFrame:
    """The rows of a page by `order` (columns with ASC or DESC, nulls last) with the number of all rows as `total`, from one pass.

    Each partition keeps its first page * limit rows and counts the rest; one
    task merges these. A page past the end has no rows, and so no total.
    """
    kept = page * limit
    names = rows.columns
    with_counts = StructType([*rows.schema.fields, StructField("total", LongType())])

    def first(batches, count_column: bool):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, n = None, 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t.cast(pa.schema([f.with_nullable(True) for f in t.schema]))
            if count_column:
                n += pc.sum(t["total"]).as_py() or 0
                t = t.filter(pc.is_null(t["total"])).drop_columns(["total"])
            else:
                n += t.num_rows
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows > kept:
                held = held.take(pc.sort_indices(held, sort_keys=order, null_placement="at_end")[:kept])
        return held, n

    def counted(held, n):
        """The kept rows, and a row with the count alone."""
        import pyarrow as pa

        rows_ = held.append_column("total", pa.nulls(held.num_rows, pa.int64()))
        alone = pa.table({f.name: pa.nulls(1, f.type) for f in held.schema} | {"total": pa.array([n], pa.int64())})
        return pa.concat_tables([rows_, alone.select(rows_.column_names).cast(rows_.schema)]).combine_chunks().to_batches()

    def each(batches):
        held, n = first(batches, False)
        if held is not None:
            yield from counted(held, n)

    def merged(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, n = first(batches, True)
        if held is not None:
            held = held.take(pc.sort_indices(held, sort_keys=order, null_placement="at_end")).slice(kept - limit, limit)
            if held.num_rows:
                yield from held.append_column("total", pa.array([n] * held.num_rows, pa.int64())).combine_chunks().to_batches()

    nullable = StructType([StructField(f.name, f.dataType, True) for f in with_counts.fields])
    partial = rows.select(names).mapInArrow(each, nullable)
    return partial.repartition(1).mapInArrow(merged, nullable)  # partitions * kept rows at most


def id_list(spark: SparkSession, ids: Iterable[int] | DataFrame, key: str = "story_id") -> DataFrame:
    """(key, position) of a list of ids, or of a table of such rows: each id at its first place."""
    if not isinstance(ids, DataFrame):
        ids = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{key} long, position long")
    return ids.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("position").alias("position"))


def among(rows: DataFrame, ids: DataFrame, key: str = "story_id") -> DataFrame:
    """rows whose key is on a list, with its position: a join, so a long list is data and no part of the plan."""
    return rows.join(ids.select(key, "position"), key)


def intersected(a: DataFrame, b: DataFrame, key: str = "story_id") -> DataFrame:
    """Ids on both lists, in the first one's order."""
    return a.join(b.select(key), key, "left_semi")


def excluded(a: DataFrame, b: DataFrame, key: str = "story_id") -> DataFrame:
    """Ids on the first list alone."""
    return a.join(b.select(key), key, "left_anti")


def united(a: DataFrame, b: DataFrame, key: str = "story_id") -> DataFrame:
    """Ids on either list: the first one's, then what the second one adds."""
    added = excluded(b, a, key).select(key, (F.col("position") + 2**40).alias("position"))
    return a.select(key, "position").unionByName(added)
