"""Sealed decisions and their revalidation; outcomes without a score in the assessment."""

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import assessment, decisions

BUNDLES = "policy string, status string, decision string, selected boolean, score double, groups bigint"
ROWS = [("a", "PASS", "NOMINATED", True, 0.1 + 0.2, 3), ("b", "HOLD", "NOMINATED", False, None, 2)]


def test_sealed_and_revalidated(spark):
    seal = lambda rows, evidence="e", stale=(): decisions.seal(spark.createDataFrame(rows, BUNDLES), "development", "p", evidence, stale)
    kept = seal(ROWS)
    row = kept.first()
    assert (row.status, row.selected, len(row.candidates)) == ("NOMINATED", "a", 2) and seal(ROWS[::-1]).first() == row
    said = lambda persisted, fresh: decisions.revalidate(persisted, fresh).first().verdict
    assert said(kept, kept) == "verified"
    assert said(kept.withColumn("selected", F.lit("b")), kept) == "self-digest"
    assert said(kept, seal([ROWS[0], (*ROWS[1][:4], 1e-9, 2)])) == "candidates"
    assert said(kept, seal(ROWS, "other")) == "evidence"
    assert said(kept, seal(ROWS[:0])) == "candidates"
    old = seal(ROWS, stale=["late-evidence", "late-evidence", "drift"])
    assert (old.first().status, old.first().selected, old.first().stale) == ("STALE", None, ["drift", "late-evidence"])
    assert said(old, kept) == "not-a-nomination"


def test_evidence_digest_is_of_the_set(spark):
    rows = spark.range(500).select("id", F.col("id").cast("string").alias("s"), (F.col("id") / 7).alias("x"))
    one = decisions.evidence_digest(rows, ["id", "s", "x"])
    assert decisions.evidence_digest(rows.orderBy(F.col("id").desc()).repartition(5), ["x", "s", "id"]) == one
    assert decisions.evidence_digest(rows.withColumn("x", F.when(F.col("id") == 77, 1e-300).otherwise(F.col("x"))), ["id", "s", "x"]) != one
    assert decisions.evidence_digest(rows.unionByName(rows.where("id = 3")), ["id", "s", "x"]) != one
    assert decisions.evidence_digest(rows.limit(0), ["id", "s", "x"]) == "sha256:none"


def test_conflicting_evidence_is_insufficient(spark):
    protocol = assessment.Protocol("expert", ["small"], [("less-than", 0.3)], -1.0, 0.0, 1.0, 1e6, 1e6, 1e6, 0.0, 1, 0)
    kind = "case_id int, replicate int, profile string, group_id int, weight double, slices array<string>, status string, outcome string, score double, signal double, ttft double, e2e double, cost double, ttft_class int, cost_class int"

    def status(outcome):
        rows = [(c, 1, p, c, 1.0, ["s"], "success", "scored", 0.5, 0.5 if p == "small" else None, 1.0, 2.0, 1.0, 0, 0) for c in range(1, 6) for p in ("small", "expert")]
        rows[0] = (*rows[0][:7], outcome, None if outcome != "scored" else 0.5, *rows[0][9:])
        got = assessment.assess(spark.createDataFrame(rows, kind), protocol, assessment.enumerate_bundles(protocol), "development", 100).where("kind = 'fast-only'").first()
        return got.status, got.reasons

    assert status("scored") == ("PASS", [])
    assert status("conflicting") == ("INSUFFICIENT_EVIDENCE", ["conflicting-evidence"])
    with pytest.raises(Exception, match="unknown outcome: odd"):
        status("odd")
