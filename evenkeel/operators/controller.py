"""The controller: a fold of recorded facts into a state, for many controllers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MOST_EVENTS = 10_000  # of one controller, by contract

# Fixed values: (fact, states it is allowed from, result that it takes, state after it); the first row that fits holds.
# ["*"] is any state but RETIRED, a result of None is any, a state after it of None is unchanged.
TRANSITIONS = [
    ("protocol-registered", ["DRAFT"], None, "REGISTERED"),
    ("collection-started", ["REGISTERED"], None, "COLLECTING"),
    ("development-evidence-ready", ["COLLECTING"], None, "DEV_READY"),
    ("development-assessment-recorded", ["DEV_READY"], "NOMINATED", "NOMINATED"),
    ("development-assessment-recorded", ["DEV_READY"], "STALE", "STALE"),
    ("development-assessment-recorded", ["DEV_READY"], None, "HOLD"),
    ("shadow-assessment-started", ["NOMINATED"], None, "SHADOW_ASSESSING"),
    ("holdout-assessment-recorded", ["SHADOW_ASSESSING"], "PASS", "HOLDOUT_CONFIRMED"),
    ("holdout-assessment-recorded", ["SHADOW_ASSESSING"], "STALE", "STALE"),
    ("holdout-assessment-recorded", ["SHADOW_ASSESSING"], None, "HOLD"),
    ("window-manifest-recorded", ["PROMOTION_RECOMMENDED"], None, "HOLDOUT_CONFIRMED"),
    ("window-manifest-recorded", ["SHADOW_ASSESSING", "HOLDOUT_CONFIRMED", "MONITORING"], None, None),
    ("window-assessment-recorded", ["HOLDOUT_CONFIRMED"], "PASS", "PROMOTION_RECOMMENDED"),
    ("window-assessment-recorded", ["MONITORING"], "PASS", None),
    ("window-assessment-recorded", ["HOLDOUT_CONFIRMED", "MONITORING"], "STALE", "STALE"),
    ("window-assessment-recorded", ["MONITORING"], "HOLD", "ROLLBACK_RECOMMENDED"),
    ("window-assessment-recorded", ["HOLDOUT_CONFIRMED", "MONITORING"], None, "HOLD"),
    ("deployment-observed", ["PROMOTION_RECOMMENDED"], None, "MONITORING"),
    ("identity-drift-recorded", ["*"], None, "STALE"),
    ("protocol-expiry-observed", ["*"], None, "STALE"),
    ("controller-retired", ["*"], None, "RETIRED"),
]


#: Facts that are legal at and after the protocol's expiry; expiry itself is legal from then on only.
AFTER_EXPIRY = ["identity-drift-recorded", "protocol-expiry-observed", "controller-retired"]


def next_state(state: Column, fact: Column, result: Column, expired: Column) -> Column:
    """The state after a fact; null where the fact is not allowed."""
    rule = F.when(F.when(expired, ~fact.isin(*AFTER_EXPIRY)).otherwise(fact == "protocol-expiry-observed"), F.lit(None).cast("string"))
    for name, states, wanted, after in TRANSITIONS:
        fits = (fact == name) & ((state != "RETIRED") if states == ["*"] else state.isin(*states))
        if wanted:
            fits = fits & (F.coalesce(result, F.lit("")) == wanted)
        rule = rule.when(fits, F.lit(after) if after else state)
    return rule


def reduce_facts(facts: DataFrame, key: str) -> DataFrame:
    """(key, state, applied, refused) from rows (key, place, fact, result, expired).

    Places count from 1.  Exact repetitions of a fact count once.  The first place that is missing, holds two different
    facts, is beyond ``MOST_EVENTS`` or has a fact not allowed is ``refused``; it and what follows change nothing.
    Nothing beyond the contract's number of events is gathered, so a controller's array is bounded.
    """
    kept = facts.where(F.col("place").between(1, MOST_EVENTS + 1))
    row = F.struct(F.col("place").cast("bigint").alias("place"), "fact", "result", F.coalesce("expired", F.lit(False)).alias("expired"))
    places = kept.groupBy(key, "place").agg(F.first(row).alias("row"), F.count_distinct(row).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("row.place"), F.col("row.fact"), F.col("row.result"), F.col("row.expired"), (F.col("n") > 1).alias("torn"))))

    def step(acc: Column, x: Column) -> Column:
        after = next_state(acc["state"], x["fact"], x["result"], x["expired"])
        bad = x["torn"] | (x["place"] != acc["applied"] + 1) | (x["place"] > MOST_EVENTS) | after.isNull()
        stop = acc["refused"].isNotNull()
        return F.struct(
            F.when(stop | bad, acc["state"]).otherwise(after).alias("state"),
            F.when(stop | bad, acc["applied"]).otherwise(x["place"]).alias("applied"),
            F.when(stop, acc["refused"]).when(bad, acc["applied"] + 1).alias("refused"),
        )

    start = F.struct(F.lit("DRAFT").alias("state"), F.lit(0).cast("bigint").alias("applied"), F.lit(None).cast("bigint").alias("refused"))
    done = places.groupBy(key).agg(ordered.alias("facts")).select(key, F.aggregate("facts", start, step).alias("end"))
    return done.select(key, "end.state", "end.applied", "end.refused")
