"""Sources, queue items and leases as keyed state with event-time timers.

An event waits in the key's state until the watermark has passed it, and is
then applied in the order of time and id: events may come late (within the
watermark) and in any order, over any number of batches, and give the rows that
the batch transitions give. What falls due by itself (the end of a cooldown, the
next attempt, the end of a lease) is a timer too; at one instant what is due
comes before events. Items that are done are forgotten after `keep`, by timer.

The state store must be RocksDB's, which keyed state of this kind needs:
`ready` sets it on a session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import BUDGETS

LATE = "1 hour"
MINUTE = 60_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Ordered(StatefulProcessor):
    """Applies the rows (ms, event_id, what) of a key in order once they are past the watermark.

    Subclasses hold their state as a tuple: `start` is a new key's, `apply`
    takes a state and an event and returns the next state and what to tell,
    `due` the instant at which something falls due (None: nothing), `fall` what
    happens then. Times are milliseconds.
    """

    state_schema = "x long"
    schema = "key long"  #: of what it tells, the key first
    start: tuple = (0,)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, event_id long", "what string")
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.ms, r.event_id), (r.what,))
            self.handle.registerTimer(r.ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()  # not only the timer's own instant: what it brings about may be past too
        state = tuple(self.state.get()) if self.state.exists() else self.start
        past = sorted((*k, v[0]) for k, v in self.waiting.iterator() if k[0] <= now)
        out = []
        for ms, event_id, what in [*past, (now, None, None)]:
            while (at := self.due(state)) is not None and at <= ms:
                state, told = self.fall(state, at)
                out += told
            if event_id is not None:
                self.waiting.removeKey((ms, event_id))
                state, told = self.apply(state, ms, event_id, what)
                out += told
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            if (at := self.due(state)) is not None:
                self.handle.registerTimer(at)
        names = [c.split()[0] for c in self.schema.split(", ")]
        return iter([Row(**dict(zip(names, (key[0], *row)))) for row in out])

    def close(self) -> None:
        pass


HEALTH = "source_id long, ms long, event_id long, failures int, successes long, auto_disabled boolean, cooldown_until long, told string"


class SourceHealth(Ordered):
    """(failures in a row, successes, off, end of the cooldown or 0)."""

    schema = HEALTH
    state_schema = "failures int, successes long, off boolean, cooldown long"
    start = (0, 0, False, 0)

    def apply(self, state, ms, event_id, what):
        failures, successes, off, _ = state
        if what == "failed":
            failures += 1
            off = off or (failures >= 10 and successes < 20)
            cooldown = ms + MINUTE * min(2 ** min(failures, 8), 240)
        else:
            failures, successes, cooldown = 0, successes + 1, 0
        return (failures, successes, off, cooldown), [(ms, event_id, failures, successes, off, cooldown or None, what)]

    def due(self, state):
        return state[3] or None

    def fall(self, state, at):
        failures, successes, off, _ = state
        return (failures, successes, off, 0), [] if off else [(at, None, failures, successes, off, None, "eligible")]


ITEMS = "id long, ms long, event_id long, retries int, state string, next_attempt long"


class Retries(Ordered):
    """(retries, state, next attempt or 0, end of its memory or 0)."""

    schema = ITEMS
    state_schema = "retries int, state string, next_attempt long, forget long"
    start = (0, "pending", 0, 0)

    def __init__(self, budget: int, keep: int):
        self.budget, self.keep = budget, keep

    def apply(self, state, ms, event_id, what):
        retries, now, _, forget = state or self.start
        if now in ("done", "dead_letter"):
            return state, []
        if what == "ok":
            now, after, forget = "done", 0, ms + self.keep
        else:
            retries += 1
            dead = retries >= self.budget
            now, after = ("dead_letter", 0) if dead else ("retry", ms + min(60_000 * 2**retries, 3_600_000))
            forget = ms + self.keep if dead else 0
        return (retries, now, after, forget), [(ms, event_id, retries, now, after or None)]

    def due(self, state):
        return state and (state[2] or state[3]) or None

    def fall(self, state, at):
        retries, now, after, _ = state
        if after:
            return (retries, "due", 0, 0), [(at, None, retries, "due", None)]
        return None, []


LEASES = "id long, ms long, event_id long, owner string, told string"


class Leases(Ordered):
    """(owner, end of the lease or 0): one owner at a time; what is claimed while another holds it is refused."""

    schema = LEASES
    state_schema = "owner string, until long"
    start = (None, 0)

    def __init__(self, ttl: int):
        self.ttl = ttl

    def apply(self, state, ms, event_id, what):
        action, _, owner = what.partition(":")
        holder, until = state
        if action == "claim":
            if holder is None or holder == owner:
                return (owner, ms + self.ttl), [(ms, event_id, owner, "granted")]
            return state, [(ms, event_id, owner, "refused")]
        if holder == owner:
            return (None, 0), [(ms, event_id, owner, "released")]
        return state, [(ms, event_id, owner, "not_held")]

    def due(self, state):
        return state[1] or None

    def fall(self, state, at):
        return (None, 0), [(at, None, state[0], "expired")]


def keyed(events: DataFrame, key: str, what: Column, processor: Ordered, late: str = LATE) -> DataFrame:
    """A processor over a stream of events (key, ts, event_id, ...); `what` says what an event is. Rows of the processor's schema, in append mode."""
    rows = events.withWatermark("ts", late).select(F.col(key).cast("long").alias("key"), "ts", F.unix_millis("ts").alias("ms"), F.col("event_id").cast("long").alias("event_id"), what.alias("what"))
    return rows.groupBy("key").transformWithState(processor, processor.schema, "append", "EventTime")


def source_health(fetches: DataFrame, late: str = LATE) -> DataFrame:
    """Every fetch (source_id, ts, event_id, failed) with its source's health after it, and the ends of cooldowns."""
    return keyed(fetches, "source_id", F.when(F.col("failed"), "failed").otherwise("ok"), SourceHealth(), late)


def retried(attempts: DataFrame, stage: str = "embed", keep: int = 24 * 60 * MINUTE, late: str = LATE) -> DataFrame:
    """Every attempt (id, ts, event_id, ok) with its item's state after it, and the instants at which retries fall due."""
    return keyed(attempts, "id", F.when(F.col("ok"), "ok").otherwise("failed"), Retries(BUDGETS[stage], keep), late)


def leased(claims: DataFrame, ttl_minutes: int = 30, late: str = LATE) -> DataFrame:
    """Every claim or release (id, ts, event_id, action, owner) with what became of it, and the ends of leases."""
    return keyed(claims, "id", F.concat_ws(":", "action", "owner"), Leases(ttl_minutes * MINUTE), late)


def health_after(fetches: DataFrame) -> DataFrame:
    """What `source_health` tells of fetches and cooldowns, from a batch, in window functions: runs of failures are those with the same number of successes before."""
    order = Window.partitionBy("source_id").orderBy("ms", "event_id")
    f = fetches.select(F.col("source_id").cast("long").alias("source_id"), F.unix_millis("ts").alias("ms"), F.col("event_id").cast("long").alias("event_id"), F.coalesce("failed", F.lit(False)).alias("failed"))
    f = f.withColumn("successes", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("source_id", "successes").orderBy("ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("failures", F.sum(F.col("failed").cast("int")).over(run).cast("int"))
    off = F.max((F.col("failures") >= 10) & (F.col("successes") < 20)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    until = F.when(F.col("failed"), F.col("ms") + MINUTE * F.least(F.pow(F.lit(2.0), F.least("failures", F.lit(8))), F.lit(240.0)).cast("long"))
    f = f.withColumns({"auto_disabled": off, "cooldown_until": until, "next": F.lead("ms").over(order)})
    ends = f.where("cooldown_until is not null and not auto_disabled and (next is null or next >= cooldown_until)")
    none = F.lit(None).cast("long")
    ended = ends.select("source_id", F.col("cooldown_until").alias("ms"), none.alias("event_id"), "failures", "successes", "auto_disabled", none.alias("cooldown_until"), F.lit("eligible").alias("told"))
    told = F.when(F.col("failed"), "failed").otherwise("ok").alias("told")
    return f.select("source_id", "ms", "event_id", "failures", "successes", "auto_disabled", "cooldown_until", told).unionByName(ended)
