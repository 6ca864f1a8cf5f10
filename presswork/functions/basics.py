"""Rounding, time and lookup helpers whose SQL form is the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x + 0.5) at `digits` decimals, also for negative numbers."""
    scale = 10**digits
    r = F.floor(x * scale + 0.5)
    return r.cast("int") if digits == 0 else r / float(scale)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, each rounded on its own, so that shares may not sum to 100."""
    return half_up(F.when(whole > 0, 100.0 * part / whole).otherwise(0.0))


def pick(values: list[str], index: Column) -> Column:
    """The value at a 0-based index."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def ordinal(column: Column, values: list[str]) -> Column:
    """0-based place of a value in an ordered vocabulary; -1 for others."""
    return F.array_position(F.array(*map(F.lit, values)), column).cast("int") - 1


def lookup(column: Column, values: dict) -> Column:
    """The value of a small fixed map, null for other keys."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(since: Column, until: Column) -> Column:
    return (micros(until) - micros(since)) / 3.6e9


def age_hours(since: Column, as_of: Column) -> Column:
    """Hours since, not below 0."""
    return F.greatest(hours_between(since, as_of), F.lit(0.0))


def effective_time(published: Column, fetched: Column) -> Column:
    """When an article counts as published: where no time was given, when it was fetched."""
    return F.coalesce(published, fetched)


def within(published: Column, fetched: Column, since: Column) -> Column:
    """Published since, or without a time and fetched since."""
    return (published >= since) | (published.isNull() & (fetched >= since))


def instant(text: str) -> Column:
    """A time without zone, as the tables have them."""
    return F.lit(text).cast("timestamp_ntz")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, in all the parts that the session shuffles into: Spark does not merge these into few large ones, so what follows by the keys holds little in a task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
