"""Joining executions with independently produced scores, with a full account of what does not join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def dedup_conflicts(rows: DataFrame, key: list[str], digest: str) -> DataFrame:
    """(key, rows, digests, status): `unique`, `duplicate` (equal rows: one stays) or `conflict` (none stays)."""
    counted = rows.groupBy(*key).agg(F.count("*").alias("n_rows"), F.countDistinct(digest).alias("n_digests"))
    return counted.withColumn("status", F.when(F.col("n_digests") > 1, "conflict").when(F.col("n_rows") > 1, "duplicate").otherwise("unique"))


def outcomes(executions: DataFrame, evidence: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join on the whole identity; the first rule that holds names each execution's outcome.

    ambiguous > failure (zero) > scored > abstained > invalid (evidence older than the completion) > missing; evidence
    without an execution is an orphan.
    """
    e, v = executions.alias("e"), evidence.alias("v")
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"v.{k}")) for k in key]
    both = e.join(v, on, "full_outer")
    old = F.col("v.produced_at") < F.col("e.completed_at")
    rule = (
        F.when(F.col("e.status").isNull(), "orphan")
        .when(F.col("e.dispatch") == "sent_unknown", "ambiguous")
        .when(F.col("e.status") != "success", "failure")
        .when(F.col("v.kind").isNull(), "missing")
        .when(old, "invalid")
        .when(F.col("v.kind") == "scored", "scored")
        .otherwise("abstained")
    )
    score = F.when(rule == "failure", F.lit(0.0)).when(rule == "scored", F.col("v.score"))
    return both.select(*[F.coalesce(F.col(f"e.{k}"), F.col(f"v.{k}")).alias(k) for k in key], rule.alias("outcome"), score.alias("score"))


def orphan_reasons(executions: DataFrame, evidence: DataFrame, key: list[str], partial: list[str]) -> DataFrame:
    """Evidence without an execution of its whole key, and why, by the executions of its partial key."""
    orphans = evidence.join(executions, key, "left_anti")
    near = executions.groupBy(*partial).agg(F.max(F.col("status") != "success").alias("failed"))
    reason = F.when(F.col("failed"), "evidence-for-failed-execution").when(F.col("failed").isNotNull(), "terminal-output-mismatch").otherwise("no-matching-trace")
    return orphans.join(near, partial, "left").withColumn("reason", reason).drop("failed")


def pair_completeness(executions: DataFrame, key: list[str], required: list[str], profile: str = "profile") -> DataFrame:
    """(key, missing): the required profiles that a pair lacks, sorted."""
    have = executions.groupBy(*key).agg(F.collect_set(profile).alias("have"))
    return have.select(*key, F.array_sort(F.array_except(F.array(*map(F.lit, required)), "have")).alias("missing"))


def inconsistent(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys whose rows differ in a column that must be one, with the columns' names."""
    counted = rows.groupBy(*key).agg(*[F.count_distinct(F.struct(c)).alias(f"_{c}") for c in columns])
    named = F.array_compact(F.array(*[F.when(F.col(f"_{c}") > 1, c) for c in sorted(columns)]))
    return counted.select(*key, named.alias("differ")).where(F.size("differ") > 0)


def matrix_gaps(rows: DataFrame, case: str, profile: str, profiles: list[str]) -> DataFrame:
    """Cases that lack a profile, have an unknown one, or unequal numbers of replicates."""
    counts = rows.groupBy(case, profile).agg(F.count("*").alias("n"))
    known = F.col(profile).isin(*profiles)
    per = counts.groupBy(case).agg(F.sum(known.cast("int")).alias("have"), F.max(~known).alias("unknown"), F.count_distinct("n").alias("sizes"))
    problem = F.when(F.col("unknown"), "unknown-profile").when(F.col("have") < len(profiles), "missing-profile").when(F.col("sizes") > 1, "unequal-replicates")
    return per.select(case, problem.alias("problem")).where("problem IS NOT NULL")


def leakage(development: DataFrame, holdout: DataFrame, group: str) -> DataFrame:
    return development.select(group).distinct().join(holdout.select(group).distinct(), group, "left_semi")


def trust_status(evidence: DataFrame, keys: DataFrame, as_of: str, max_age_s: int, skew_s: int) -> DataFrame:
    """The first rule that fails, in order, for each row of evidence; ``keys`` has key_id, valid_from, valid_to, revoked_at, purpose."""
    rows = evidence.join(F.broadcast(keys), "key_id", "left")  # as many as signing keys
    now = F.to_timestamp_ntz(F.lit(as_of))
    age = F.timestamp_diff("SECOND", F.col("produced_at"), now)
    status = (
        F.when(F.col("valid_from").isNull(), "unknown-key")
        .when(~F.col("signature_ok"), "invalid-signature")
        .when(F.col("revoked_at") <= now, "revoked")
        .when(age < -skew_s, "future-dated")
        .when(age > max_age_s, "stale")
        .when(F.col("produced_at") < F.col("valid_from"), "key-not-yet-valid")
        .when(F.col("produced_at") >= F.col("valid_to"), "key-expired")
        .when(F.col("purpose") != F.col("kind"), "unauthorized-evidence")
        .otherwise("trusted")
    )
    return rows.withColumn("trust", status)


def set_digest(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """SHA-256 over the sorted list of members, one row per key."""
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(member)), ","), 256).alias("digest"), F.count("*").alias("members"))


def chain_breaks(events: DataFrame, chain: str, order: list[str], identity: str, parent: str) -> DataFrame:
    """Events whose parent is not the event before them in their chain."""
    before = F.lag(identity).over(Window.partitionBy(chain).orderBy(*order))
    return events.withColumn("expected", before).where(~F.col(parent).eqNullSafe(F.col("expected")))


def counterbalanced(cases: DataFrame, profiles: list[str], seed: str, case: str = "case_id", replicate: str = "replicate") -> DataFrame:
    """The order in which a replicate runs the profiles: blocks of as many replicates as profiles, ranked by digest, rotate the list."""
    n = len(profiles)
    digest = F.sha2(F.concat_ws("/", F.lit(seed), F.col(case).cast("string"), F.col(replicate).cast("string")), 256)
    block = F.floor((F.col(replicate) - 1) / n)
    rank = F.row_number().over(Window.partitionBy(case, block).orderBy(digest, replicate)) - 1
    base = F.array(*map(F.lit, profiles))
    return cases.withColumn("turn", rank).withColumn("profiles", F.concat(F.slice(base, F.col("turn") + 1, n), F.slice(base, F.lit(1), F.col("turn"))))
