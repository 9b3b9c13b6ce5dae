"""Stateful streams: controllers that fold their events as they come, and leased attempts that settle once, as sessions.

Both keep their state in Spark's state store (RocksDB), so a stopped query goes on from its checkpoint, and both give what the
batch operators give over the same rows, in whatever order and however often the rows come.  ``start`` writes each
micro-batch to a folder of its number, which a batch that is run again overwrites, so that each result is there once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.lineage import ship
from ..operators import chains
from ..operators.controller import AFTER_EXPIRY

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = 4096  # events of one controller that a task takes up before it puts them into the state
CONTROLLER = "controller string, state string, applied bigint, last_event_id string, refused bigint, fault string"


class Fold(StatefulProcessor):
    """Applies a controller's events in the order of their sequence; those that come early wait, for the missing ones only.

    An event of a sequence already applied is a repetition if its id is the one applied last, else it is ignored, as its
    place has been taken; two ids that wait for one place are a fork.  After the first fault nothing is applied or kept.
    """

    def __init__(self, created_at, expires_at):
        self.created_at, self.expires_at = created_at, expires_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getValueState("own", "state int, applied bigint, last_event_id string, last_at bigint, refused bigint, fault string, held bigint")
        self.waiting = handle.getMapState("waiting", "sequence bigint", "event_id string, predecessor string, at bigint, fact string, result string, torn boolean")
        self.table = chains.table()

    def _fault(self, event, at, last) -> str | None:
        late = event[3] in AFTER_EXPIRY
        if event[5]:
            return "fork"
        if event[1] != last:
            return "splice"
        if at is not None and event[2] < at:
            return "time-regression"
        if event[2] < self.created_at:
            return "before-creation"
        if event[2] >= self.expires_at and not late:
            return "after-expiry"
        return "before-expiry" if event[2] < self.expires_at and event[3] == "protocol-expiry-observed" else None

    def _after(self, state: int, fact, result) -> int:
        if fact not in chains.FACTS:
            return -1
        place = chains.RESULTS.index(result) if result in chains.RESULTS else len(chains.RESULTS)
        return self.table[(chains.FACTS.index(fact) * (len(chains.RESULTS) + 1) + place) * len(chains.STATES) + state]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, applied, last, at, refused, fault, held = self.own.get() if self.own.exists() else (0, 0, None, None, None, None, 0)
        changed = not self.own.exists()
        fresh: dict = {}
        for r in rows:
            if refused is not None or r["sequence"] <= applied:
                continue
            there = fresh.get(r["sequence"])
            fresh[r["sequence"]] = (r["event_id"], r["predecessor"], r["at"], r["fact"], r["result"], False) if there is None else self._met(there, r["event_id"])
            if len(fresh) >= HELD:
                held += self._wait(fresh, held)
                fresh.clear()
        while refused is None:
            event = fresh.pop(applied + 1, None)
            if held and self.waiting.containsKey((applied + 1,)):
                there = self.waiting.getValue((applied + 1,))
                self.waiting.removeKey((applied + 1,))
                held -= 1
                event = there if event is None else self._met(there, event[0], event[5])
            if event is None:
                break
            fault = self._fault(event, at, last)
            after = -1 if fault else self._after(state, event[3], event[4])
            changed = True
            if after < 0:
                refused, fault = applied + 1, fault or "transition"
                fresh.clear()
                if held:
                    self.waiting.clear()
                    held = 0
            else:
                state, applied, last, at = after, applied + 1, event[0], event[2]
        held += self._wait(fresh, held)
        self.own.update((state, applied, last, at, refused, fault, held))
        if changed:
            yield Row(controller=key[0], state=chains.STATES[state], applied=applied, last_event_id=last, refused=refused, fault=fault)

    @staticmethod
    def _met(there, event_id, torn=False):
        """The event that waits for a place, torn where another id comes for it."""
        return (*there[:5], there[5] or torn or there[0] != event_id)

    def _wait(self, fresh: dict, held: int) -> int:
        """Puts events into the state until the missing ones come, and gives the number of places that are new there."""
        new = 0
        for sequence, event in fresh.items():
            if held and self.waiting.containsKey((sequence,)):
                event = self._met(self.waiting.getValue((sequence,)), event[0], event[5])
            else:
                new += 1
            self.waiting.updateValue((sequence,), event)
        return new

    def close(self) -> None:
        pass


def controllers(events: DataFrame, created_at: int, expires_at: int) -> DataFrame:
    """A row for every controller that a micro-batch changes; of each controller the row that has applied most, or has refused, holds.

    ``events``: controller, sequence, predecessor, event_id, at (a number), fact, result.
    """
    rows = events.select("controller", F.col("sequence").cast("bigint").alias("sequence"), "predecessor", "event_id", F.col("at").cast("bigint").alias("at"), "fact", "result")
    return rows.groupBy("controller").transformWithState(Fold(created_at, expires_at), CONTROLLER, "update", "none")


def _first() -> tuple:
    """The first acceptance, and the first end, of an attempt's rows."""
    at, accepted = F.unix_millis("at"), F.col("kind") == "accepted"
    return (
        F.min(F.when(accepted, F.struct(at.alias("at"), F.col("lease_ms").cast("bigint").alias("lease")))).alias("a"),
        F.min(F.when(~accepted, F.struct(at.alias("at"), "kind", F.coalesce("category", F.lit("")).alias("category")))).alias("e"),
    )


def _outcome(rows: DataFrame, most: int) -> DataFrame:
    """What became of accepted attempts, from their first acceptance and end."""
    rows = rows.where("a IS NOT NULL")
    lease = F.col("a.at") + F.col("a.lease")
    inside = F.coalesce((F.col("e.at") >= F.col("a.at")) & (F.col("e.at") < lease), F.lit(False))
    again = inside & (F.col("e.kind") == "not_sent") & F.col("e.category").isin("transport", "timeout") & (F.col("attempt") < most)
    return rows.select("execution", "attempt", F.when(inside, F.col("e.kind")).otherwise("sent_unknown").alias("outcome"), F.when(inside, F.col("e.at")).otherwise(lease).alias("at_ms"), again.alias("again"))


def settle(journal: DataFrame, most: int, delay: str = "10 minutes", early: str = "1 minute") -> DataFrame:
    """(execution, attempt, outcome, at_ms, again), one row for each accepted attempt, from a stream of journal rows.

    ``journal``: execution, attempt, kind (accepted, completed, failed, not_sent), at (a timestamp), lease_ms (of accepted), category.
    An attempt is a session that its acceptance keeps open for twice the lease, so that what comes again after the lease is known
    for a repetition, and its end for ``early``, by which an end may be stamped before its acceptance.  It is said when the
    watermark has passed the session.  Repeated acceptances count once, the first holds.  Rows later than ``delay`` may be lost, as
    with any watermark.
    """
    ms = F.col("lease_ms").cast("bigint")
    gap = F.when(F.col("kind") == "accepted", F.concat((F.greatest(ms, F.lit(0)) * 2 + 1).cast("string"), F.lit(" milliseconds"))).otherwise(early)
    sessions = journal.withWatermark("at", delay).groupBy("execution", F.col("attempt").cast("int").alias("attempt"), F.session_window("at", gap))
    return _outcome(sessions.agg(*_first()), most)


def settled(journal: DataFrame, most: int) -> DataFrame:
    """The batch form of ``settle`` over a whole journal: what the stream has said when its watermark has passed every lease."""
    return _outcome(journal.groupBy("execution", F.col("attempt").cast("int").alias("attempt")).agg(*_first()), most)


def start(results: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Runs over all that is there now and writes each micro-batch to ``path``/batch=n, over what an earlier try has left there."""
    spark = results.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
