"""Chains of controller events: verified in parallel, replayed by composing segments, resumed from a pinned anchor.

Every event is a function from state to state, and functions compose.  A segment of a chain is folded once for every state
that it may begin in, which needs no other segment; segments are then composed a fan at a time until one is left for each
controller.  A row never holds more than ``segment`` events or ``fan`` functions, however long the chain is.  The events go
through one shuffle, by controller and segment, in which the last event of a segment also comes to the next one, so that what an
event owes its predecessor (id, time, no gap) is found within a segment.  Only functions leave it, which carry the id
and time of the last event and the code of the refused one.  The events are read twice, once for their segments' numbers only.

Events have controller, study, protocol, sequence (from 1), predecessor, event_id, occurred_at, fact, result.  ``genesis`` has
controller, study, protocol, created_at, expires_at, one row each.  Exact repetitions count once; events of controllers
without a genesis, and events without a sequence, are left out.  The first event of a chain that is at fault is ``refused``; it and what follows change nothing.

Codes, the first that holds: gap, conflicting-duplicate, fork, foreign, splice, identity, time-regression, before-creation,
after-expiry, before-expiry, and transition where the state does not allow the fact.  What comes after a missing event is a gap,
whatever else is wrong with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import cut
from .controller import AFTER_EXPIRY, TRANSITIONS

SEGMENT, FAN = 256, 64
STATES = ["DRAFT", "REGISTERED", "COLLECTING", "DEV_READY", "NOMINATED", "SHADOW_ASSESSING", "HOLDOUT_CONFIRMED", "PROMOTION_RECOMMENDED", "MONITORING", "HOLD", "STALE", "ROLLBACK_RECOMMENDED", "RETIRED"]
FACTS = list(dict.fromkeys(fact for fact, *_ in TRANSITIONS))
RESULTS = ["NOMINATED", "PASS", "STALE", "HOLD"]  # those that a transition asks for; all others are alike


def table() -> list[int]:
    """The state (its place in STATES, or -1) after fact f with result r from state s, at ((f * (results + 1)) + r) * states + s."""
    out = []
    for fact in FACTS:
        for result in [*RESULTS, None]:
            for state in STATES:
                fits = (after or state for f, states, wanted, after in TRANSITIONS if f == fact and wanted in (None, result) and (state != "RETIRED" if states == ["*"] else state in states))
                after = next(fits, None)
                out.append(STATES.index(after) if after else -1)
    return out


def _place(value: Column, names: list[str]) -> Column:
    """The place of ``value`` in ``names`` from 0, or -1."""
    return (F.array_position(F.array(*map(F.lit, names)), F.coalesce(value, F.lit(""))) - 1).cast("int")


def _segment(sequence: Column, segment: int) -> Column:
    """The segment of a sequence, from 0."""
    return F.greatest(F.floor((sequence - 1) / segment), F.lit(0)).cast("bigint")


def _started(genesis: DataFrame, anchors: DataFrame | None, at) -> DataFrame:
    """The genesis with begin, base, base_id and base_at: the state, sequence, id and time that a replay starts from."""
    if anchors is None:
        return genesis.withColumns({"begin": F.lit(0), "base": F.lit(0).cast("bigint"), "base_id": F.lit(None).cast("string"), "base_at": F.lit(None).cast(at)})
    named = anchors.select("controller", _place(F.col("state"), STATES).alias("begin"), F.col("sequence").alias("base"), F.col("event_id").alias("base_id"), F.col("occurred_at").alias("base_at"))
    return genesis.join(named, "controller", "left").withColumns({"begin": F.coalesce("begin", F.lit(0)), "base": F.coalesce("base", F.lit(0))})


def checked(events: DataFrame, start: DataFrame, identity: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per controller and sequence, with place (its segment), event_id, occurred_at, fact, result and ``fault``, the first code that holds.

    ``start`` has a row for each controller and place: what ``_started`` gives.  Its base stands for all events up to it, which are
    left out, but for another event in the base's own place; so are those after its ``upto``, where it has one.  ``identity``
    is what an event's id should be, over the events' columns.
    """
    own, following = _segment(F.col("sequence"), segment), _segment(F.col("sequence") + 1, segment)
    row = F.struct("event_id", "study", "protocol", "predecessor", "occurred_at", "fact", "result", (F.lit(True) if identity is None else F.coalesce(identity == F.col("event_id"), F.lit(False))).alias("own_id"))
    spread = events.where("sequence IS NOT NULL").select("controller", "sequence", row.alias("row"), F.explode(F.when(own == following, F.array(own)).otherwise(F.array(own, following))).alias("place"))
    placed = spread.repartition("controller", "place").groupBy("controller", "place", "sequence").agg(F.min("row").alias("e"), F.max("row").alias("f"), F.min("row.event_id").alias("low"), F.max("row.event_id").alias("top"))
    before = F.lag(F.struct("sequence", "e.event_id", "e.occurred_at")).over(Window.partitionBy("controller", "place").orderBy("sequence"))  # a segment
    rows = placed.select("controller", "place", "sequence", "e", "low", "top", (~F.col("e").eqNullSafe(F.col("f"))).alias("differ"), before.alias("before"))
    named = start.withColumnsRenamed({"study": "own_study", "protocol": "own_protocol"})
    rows = rows.join(named, ["controller", "place"]).where(F.col("place") == own)
    # another event in the base's own place stays, and counts as the event after it
    other = (F.col("sequence") == F.col("base")) & (F.col("base") > 0) & (~F.col("low").eqNullSafe(F.col("base_id")) | ~F.col("top").eqNullSafe(F.col("base_id")))
    rows = rows.withColumn("other", other).where((F.col("sequence") > F.col("base")) | F.col("other") | (F.col("sequence") < 1))
    if "upto" in start.columns:
        rows = rows.where("sequence <= upto")
    follows = F.col("before.sequence") == F.col("sequence") - 1
    first = F.col("sequence") == F.col("base") + 1
    before_id = F.when(follows, F.col("before.event_id"))
    previous = F.when(first, F.col("base_id")).otherwise(before_id)
    previous_at = F.when(first, F.col("base_at")).when(follows, F.col("before.occurred_at"))
    at, late_fact = F.col("e.occurred_at"), F.coalesce(F.col("e.fact").isin(*AFTER_EXPIRY), F.lit(False))
    fault = (
        F.when(~first & ~F.col("other") & before_id.isNull(), "gap")
        .when(F.col("differ") & F.col("low").eqNullSafe(F.col("top")), "conflicting-duplicate")
        .when((F.col("low") != F.col("top")) | F.col("other"), "fork")
        .when(~F.col("e.study").eqNullSafe(F.col("own_study")) | ~F.col("e.protocol").eqNullSafe(F.col("own_protocol")), "foreign")
        .when(~F.col("e.predecessor").eqNullSafe(previous), "splice")
        .when(~F.col("e.own_id"), "identity")
        .when(at < previous_at, "time-regression")
        .when(at < F.col("created_at"), "before-creation")
        .when((at >= F.col("expires_at")) & ~late_fact, "after-expiry")
        .when((at < F.col("expires_at")) & (F.col("e.fact") == "protocol-expiry-observed"), "before-expiry")
    )
    return rows.select("controller", "place", F.col("sequence").cast("bigint").alias("sequence"), "e.event_id", "e.occurred_at", "e.fact", "e.result", fault.alias("fault"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _end(state: Column, last: list[Column], refused: Column, fault: Column) -> Column:
    """Where events lead: ``last`` is the sequence, id and time of the last that is applied."""
    return F.struct(state.cast("int").alias("state"), *[c.alias(n) for c, n in zip(last, ("applied", "id", "at"))], refused.alias("refused"), fault.alias("fault"))


def segments(rows: DataFrame) -> DataFrame:
    """(controller, place, ends): each segment's function; ``ends`` has for every state in STATES where the segment leads from there."""
    after = F.array(*[F.lit(to if to >= 0 else None).cast("int") for to in table()])
    n = len(STATES)
    code = (_place(F.col("fact"), FACTS) * (len(RESULTS) + 1) + F.coalesce(F.nullif(_place(F.col("result"), RESULTS), F.lit(-1)), F.lit(len(RESULTS)))) * n
    sound = F.col("fault").isNull() & (_place(F.col("fact"), FACTS) >= 0)
    steps = rows.select("controller", "place", F.struct("sequence", F.when(sound, code).cast("int").alias("code"), "event_id", "occurred_at", "fault").alias("step"))
    steps = steps.groupBy("controller", "place").agg(F.sort_array(F.collect_list("step")).alias("steps"))

    def follow(v: Column, x: Column) -> Column:
        """``v`` is the number of events applied, times n, and the state; once an event is refused, what it was, negative."""
        return F.when(v < 0, v).otherwise(F.coalesce(F.get(after, x["code"] + v % n) - v % n + v + n, -v - 1))

    def end(v: Column) -> Column:
        held = F.when(v < 0, -v - 1).otherwise(v)
        count = F.floor(held / n).cast("int")
        last, bad = F.get("steps", count - 1), F.get("steps", F.when(v < 0, count))
        return _end(held % n, [last["sequence"], last["event_id"], last["occurred_at"]], bad["sequence"], F.when(v < 0, F.coalesce(bad["fault"], F.lit("transition"))))

    every = F.sequence(F.lit(0), F.lit(n - 1))
    return steps.select("controller", "place", F.transform(F.transform(every, lambda s: F.aggregate("steps", s, follow)), end).alias("ends"))


def compose(functions: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """One function for each controller, of functions (controller, place, ends) with places under ``most``."""
    kinds = functions.schema["ends"].dataType.elementType
    none = lambda name: F.lit(None).cast(kinds[name].dataType)
    same = F.transform(F.sequence(F.lit(0), F.lit(len(STATES) - 1)), lambda s: _end(s, [none("applied"), none("id"), none("at")], none("refused"), none("fault")))

    def then(ends: Column, part: Column) -> Column:
        def step(e: Column) -> Column:
            of = lambda x, name: F.when(x["applied"].isNull(), e[name]).otherwise(x[name])
            return F.when(e["refused"].isNotNull(), e).otherwise(_let(F.get(part["ends"], e["state"]), lambda x: _end(x["state"], [of(x, "applied"), of(x, "id"), of(x, "at")], x["refused"], x["fault"])))

        return F.transform(ends, step)

    while most > 1:
        parts = functions.groupBy("controller", F.floor(F.col("place") / fan).cast("bigint").alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "ends"))).alias("parts"))
        functions = parts.select("controller", "place", F.aggregate("parts", same, then).alias("ends"))
        most = -(-most // fan)
    return functions.select("controller", "ends")


def replay(events: DataFrame, genesis: DataFrame, anchors: DataFrame | None = None, identity: Column | None = None, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """(controller, state, applied, last_event_id, last_event_at, refused, fault) for every controller of ``genesis``.

    ``anchors`` (controller, sequence, event_id, occurred_at, state) stand for all events up to theirs.  The numbers of segments are
    written once, to bring the genesis to each of them; the largest is asked for, to know how many rounds of composing it takes.
    """
    start = _started(genesis, anchors, events.schema["occurred_at"].dataType)
    places = events.where("sequence IS NOT NULL").select("controller", _segment(F.col("sequence"), segment).alias("place")).distinct()
    places = cut(places.join(genesis.select("controller"), "controller", "left_semi"))
    most = places.agg(F.max("place") + 1).first()[0] or 0
    whole = compose(segments(checked(events, start.drop("begin").join(places, "controller"), identity, segment)), most, fan)
    ends = start.select("controller", "begin", "base", "base_id", "base_at").join(whole, "controller", "left").withColumn("end", F.get("ends", F.col("begin")))
    state = F.element_at(F.array(*map(F.lit, STATES)), F.coalesce("end.state", "begin") + 1)
    return ends.select("controller", state.alias("state"), F.coalesce("end.applied", "base").alias("applied"), F.coalesce("end.id", "base_id").alias("last_event_id"), F.coalesce("end.at", "base_at").alias("last_event_at"), "end.refused", "end.fault")


def verify_checkpoints(checkpoints: DataFrame, events: DataFrame, genesis: DataFrame, pins: DataFrame, **how) -> DataFrame:
    """The checkpoints with ``verdict``: pinned, replayed, or what is wrong: pin-mismatch, prefix-refused, prefix-mismatch, unknown-controller.

    Checkpoints have controller, protocol, sequence, event_id, occurred_at, state, snapshot_digest, one for each controller.  One
    that has a pin (controller, protocol, sequence, event_id, snapshot_digest) must equal it; of others the whole prefix is replayed.
    """
    pinned = pins.select("controller", F.struct("protocol", "sequence", "event_id", "snapshot_digest").alias("pin"))
    rows = checkpoints.join(pinned, "controller", "left")
    open_ = rows.where("pin IS NULL").select("controller", F.col("sequence").alias("upto"))
    prefix = events.where(F.col("sequence") <= F.lit(open_.agg(F.max("upto")).first()[0]))
    got = replay(prefix, genesis.join(open_, "controller"), **how).select("controller", F.struct("state", "applied", "last_event_id", "last_event_at", "refused").alias("got"))
    rows = rows.join(got, "controller", "left")
    equals = lambda pairs: F.forall(F.array(*[F.col(a).eqNullSafe(F.col(b)) for a, b in pairs]), lambda x: x)
    same_pin = equals([(c, f"pin.{c}") for c in ("protocol", "sequence", "event_id", "snapshot_digest")])
    same = equals([("state", "got.state"), ("sequence", "got.applied"), ("event_id", "got.last_event_id"), ("occurred_at", "got.last_event_at")])
    verdict = (
        F.when(F.col("pin").isNotNull(), F.when(same_pin, "pinned").otherwise("pin-mismatch"))
        .when(F.col("got").isNull(), "unknown-controller")
        .when(F.col("got.refused").isNotNull(), "prefix-refused")
        .when(same, "replayed")
        .otherwise("prefix-mismatch")
    )
    return rows.select(*[rows[c] for c in checkpoints.columns], verdict.alias("verdict"))


def follow(verified: DataFrame, events: DataFrame, genesis: DataFrame, **how) -> DataFrame:
    """Replays what follows each of the checkpoints with their verdicts; controllers whose checkpoint is not verified are left out."""
    sound = cut(verified.where(F.col("verdict").isin("pinned", "replayed")))
    return replay(events, genesis.join(sound.select("controller"), "controller", "left_semi"), sound.select("controller", "sequence", "event_id", "occurred_at", "state"), **how)


def resume(checkpoints: DataFrame, events: DataFrame, genesis: DataFrame, pins: DataFrame, **how) -> DataFrame:
    """Verifies the checkpoints and replays what follows each one that is sound."""
    return follow(verify_checkpoints(checkpoints, events, genesis, pins, **how), events, genesis, **how)
