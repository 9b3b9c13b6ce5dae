"""Sealed decisions: an assessment with digests of its evidence and candidates, and its revalidation against them.

A decision is one row: phase, protocol, evidence (a digest of the set of executions), status, selected, candidates (the
digests of the assessed bundles, sorted), stale (reasons) and decision_digest, the domain digest of the canonical JSON of all
others.  Bundles are few; the evidence is of any size, and is digested by prefixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import canonical_rows

DOMAIN = "evenkeel/decision/1"
BODY = ["phase", "protocol", "evidence", "status", "selected", "candidates", "stale"]


def evidence_digest(rows: DataFrame, columns: list[str]) -> str:
    """One digest of a table's rows in any order, repeated ones counted; of an empty table that of nothing."""
    kind = T.StructType([rows.schema[c] for c in columns])
    said = rows.select(F.lit(0).alias("k"), canonical_rows.text(F.struct(*columns), kind).alias("member"))
    found = canonical_rows.tree_digest(said, ["k"], "member").first()
    return "sha256:" + found["digest"] if found else "sha256:none"


def candidates(assessed: DataFrame) -> DataFrame:
    """The assessed bundles, each with the digest of all its columns."""
    return canonical_rows.row_digest(assessed, f"{DOMAIN}/candidate")


def own_digest(decisions: DataFrame):
    """What the digest of each decision should be."""
    kind = T.StructType([decisions.schema[c] for c in BODY])
    return canonical_rows.digest(DOMAIN, F.struct(*BODY), kind)


def seal(assessed: DataFrame, phase: str, protocol: str, evidence: str, stale: list[str] | tuple = ()) -> DataFrame:
    """The decision on the assessed bundles (policy, selected, decision, ...).  With reasons it is STALE and selects nothing."""
    stale = sorted(set(stale))
    rows = candidates(assessed)
    chosen = F.max(F.when(F.col("selected"), F.col("policy")))
    out = rows.agg(F.max("decision").alias("status"), chosen.alias("selected"), F.array_sort(F.collect_list("digest")).alias("candidates"))
    if stale:
        out = out.withColumn("status", F.lit("STALE")).withColumn("selected", F.lit(None).cast("string"))
    out = out.select(F.lit(phase).alias("phase"), F.lit(protocol).alias("protocol"), F.lit(evidence).alias("evidence"), "status", "selected", "candidates", F.array(*map(F.lit, stale)).cast("array<string>").alias("stale"))
    return out.withColumn("decision_digest", own_digest(out))


def revalidate(persisted: DataFrame, fresh: DataFrame) -> DataFrame:
    """The persisted decisions with ``verdict``, against the one that the evidence gives now (``fresh``, from ``seal``).

    not-a-nomination, self-digest (the row is not what its digest says), protocol, evidence or candidates (what differs first),
    recomputed (all of these agree and yet the decision differs), or verified.
    """
    now = fresh.select(F.struct(*BODY, "decision_digest").alias("now"))
    rows = persisted.join(F.broadcast(now), F.lit(True), "left")  # one row
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"now.{c}"))
    verdict = (
        F.when((F.col("phase") != "development") | (F.col("status") != "NOMINATED") | F.col("selected").isNull(), "not-a-nomination")
        .when(~F.col("decision_digest").eqNullSafe(own_digest(persisted)), "self-digest")
        .when(differs("protocol"), "protocol")
        .when(differs("evidence"), "evidence")
        .when(differs("candidates"), "candidates")
        .when(differs("decision_digest"), "recomputed")
        .otherwise("verified")
    )
    return rows.withColumn("verdict", verdict).drop("now")
