"""The whole evidence join: executions and evaluator evidence to one outcome per execution, with everything that doesn't join.

Executions: ``key`` (case_id, replicate, profile, output), trace_id, digest, lineage columns, status, dispatch, completed_at.
Evidence: ``key``, digest, the same lineage columns, verification, pinned, drifted, context, kind, score, produced_at.

Rules, in order.  Equal executions (one digest) count once; different ones of one identity, or of one profile and replicate
under two trace ids, are conflicts and none stays.  Evidence that isn't verified, not pinned or drifted is rejected; where
what is left has several verification contexts, all of it is.  Equal evidence counts once; different evidence of one key is
a conflict and none stays.  What is left is an orphan, or its lineage differs (conflict), or it is older than the execution
(invalid), or it holds.  An execution's outcome is the first that applies of: ambiguous, failure (score 0), what its evidence
says, rejected (the least digest's reason), conflicting, missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

KEY = ["case_id", "replicate", "profile", "output"]
CASE = ["case_id", "replicate", "profile"]


def admit_evidence(evidence: DataFrame) -> DataFrame:
    """``evidence`` with ``rejected``: why a row is not accepted, null where it is."""
    rejected = F.when(F.col("verification") != "trusted", F.concat(F.lit("verification-"), F.col("verification"))).when(~F.col("pinned"), "evaluator-key-not-pinned").when(F.col("drifted"), "evaluator-identity-drift")
    rows = evidence.withColumn("rejected", rejected)
    contexts = rows.where("rejected is null").agg((F.min("context") < F.max("context")).alias("several"))  # one row
    rows = rows.crossJoin(F.broadcast(contexts))
    return rows.withColumn("rejected", F.coalesce("rejected", F.when(F.col("several"), "verification-context-drift"))).drop("several")


def identities(executions: DataFrame, evidence: DataFrame, lineage: list[str]) -> DataFrame:
    """One row per key of either table: the execution ``e`` with n_rows and ``fault`` (null, duplicate-traces or conflicting-traces), accepted evidence ``v`` with its rows v_rows and its different digests n, why evidence was refused, and whether an execution of the key's case, replicate and profile failed.

    Both tables go through one shuffle, by case and replicate, and one sort; all that is counted after them is read off in
    passes over the sorted rows, so rows of one key may be any number.  Executions without a whole case, replicate and
    profile have no identity.
    """
    c = F.col
    said, told = ["trace_id", "status", "dispatch", "completed_at"], ["rejected", "kind", "score", "produced_at"]
    ex = executions.where(" and ".join(f"{k} is not null" for k in CASE)).select(*KEY, "digest", *lineage, *said, F.lit(True).alias("ran"), F.lit(False).alias("taken"))
    ev = admit_evidence(evidence).select(*KEY, "digest", *lineage, *told, F.lit(False).alias("ran"), c("rejected").isNull().alias("taken"))
    rows = ex.unionByName(ev, allowMissingColumns=True).repartition("case_id", "replicate")
    before = Window.partitionBy(*KEY).orderBy("taken", "digest")
    same = F.coalesce(F.lag("taken").over(before), F.lit(False)) & F.lag("digest").over(before).eqNullSafe(c("digest"))
    rows = rows.withColumn("new", c("taken") & ~same)
    once = rows.groupBy(*KEY).agg(
        F.min(F.when(c("ran"), F.struct("digest", *said, *lineage))).alias("e"), F.count_if("ran").alias("n_rows"), F.max(F.when(c("ran"), c("digest"))).alias("last"),
        F.min(F.when(c("ran"), c("digest"))).alias("first"), F.min("trace_id").alias("low"), F.max("trace_id").alias("high"),
        F.min(F.when(c("taken"), F.struct(*lineage, "kind", "score", "produced_at"))).alias("v"), F.count_if("taken").alias("v_rows"), F.nullif(F.count_if("new"), F.lit(0)).alias("n"),
        F.min(F.when(c("rejected").isNotNull() & c("digest").isNotNull(), F.struct("digest", "rejected"))).alias("why"),
    )
    case = Window.partitionBy(*CASE)
    differ = F.coalesce(c("first") < c("last"), F.lit(False))
    split = F.coalesce(F.min("low").over(case) < F.max("high").over(case), F.lit(False))
    failed = F.max(F.when(c("e").isNotNull() & ~differ, c("e.status") != "success")).over(case)
    once = once.select(*KEY, "e", "n_rows", "v", "v_rows", "n", c("why.rejected").alias("why"), differ.alias("differ"), split.alias("split"), failed.alias("failed"))
    fault = F.when(c("e").isNotNull(), F.when(c("differ") | c("split"), "conflicting-traces").when(c("n_rows") > 1, "duplicate-traces"))
    return once.select(*KEY, "e", "n_rows", fault.alias("fault"), "v", "v_rows", "n", "why", F.when(~c("split"), c("failed")).alias("failed"))


def join(executions: DataFrame, evidence: DataFrame, lineage: list[str]) -> DataFrame:
    """(key, outcome, detail, score, n_rows): one row per execution identity and per orphan of the evidence."""
    return _outcomes(identities(executions, evidence, lineage), lineage).where("shown").drop("shown", "fault")


def _outcomes(keys: DataFrame, lineage: list[str]) -> DataFrame:
    """The outcome of each row of ``identities``, its fault, and whether it is ``shown``: conflicting executions and evidence that is only refused are not."""
    usable = F.col("e").isNotNull() & F.coalesce(F.col("fault") != "conflicting-traces", F.lit(True))
    own = lambda x: F.when(usable, F.col(x))
    out = keys.select(*KEY, "fault", (~usable).alias("orphan"), *[own(f"e.{c}").alias(f"e_{c}") for c in ("status", "dispatch", "completed_at", *lineage)], own("fault").alias("e_fault"), "n", "v_rows", "v", "why", "failed", (usable | F.col("n").isNotNull()).alias("shown"))
    strays = F.lit(False)
    for c in lineage:
        strays = strays | ~F.col(f"v.{c}").eqNullSafe(F.col(f"e_{c}"))
    conflict = (F.col("n") > 1) | (F.col("n").isNotNull() & strays)
    old = F.col("v.produced_at") < F.col("e_completed_at")
    rules = [
        (F.col("orphan") & (F.col("n") > 1), "orphan", "conflicting-evaluator-evidence"),
        (F.col("orphan") & F.col("failed"), "orphan", "evidence-for-failed-execution"),
        (F.col("orphan") & F.col("failed").isNotNull(), "orphan", "terminal-output-mismatch"),
        (F.col("orphan"), "orphan", "no-matching-trace"),
        (F.col("e_dispatch") == "sent_unknown", "ambiguous", None),
        (F.col("e_status") != "success", "failure", None),
        (F.col("n").isNotNull() & ~conflict & old, "invalid", "evidence-predates-completion"),
        (F.col("n").isNotNull() & ~conflict, "by-kind", None),
        (F.col("why").isNotNull(), "invalid", "by-why"),
        (F.col("n") > 1, "conflicting", "different-evidence"),
        (conflict, "conflicting", "lineage"),
    ]
    outcome = detail = None
    for test, name, why in rules:
        value = F.col("v.kind") if name == "by-kind" else F.lit(name)
        said = F.col("why") if why == "by-why" else F.lit(why).cast("string")
        outcome = F.when(test, value) if outcome is None else outcome.when(test, value)
        detail = F.when(test, said) if detail is None else detail.when(test, said)
    out = out.withColumn("outcome", outcome.otherwise("missing")).withColumn("detail", F.coalesce(detail, F.lit("")))
    score = F.when(F.col("outcome") == "failure", F.lit(0.0)).when(F.col("outcome") == "scored", F.col("v.score"))
    duplicate = (F.coalesce("e_fault", F.lit("")) == "duplicate-traces").alias("duplicate_traces")
    repeated = (F.coalesce("v_rows", F.lit(0)) > F.coalesce("n", F.lit(0))).alias("duplicate_evidence")
    return out.select(*KEY, "outcome", "detail", score.alias("score"), duplicate, repeated, "fault", "shown")


def counts(executions: DataFrame, evidence: DataFrame, lineage: list[str]) -> DataFrame:
    """(what, n): the join's counts and its blocking reasons, each with the number of rows behind it; a short list.

    Cases and replicates are gathered on the way, so no list of distinct ones is kept.
    """
    rows, c = _outcomes(identities(executions, evidence, lineage), lineage), F.col
    own, orphan, said = c("shown") & (c("outcome") != "orphan"), c("shown") & (c("outcome") == "orphan"), lambda x, *names: c("shown") & c(x).isin(*names)
    tests = {
        "accepted": own, "conflicting-traces": c("fault") == "conflicting-traces", "joined": own, "scored": said("outcome", "scored"),
        "matched": said("outcome", "scored", "abstained") | said("detail", "evidence-predates-completion"), "orphan-evaluator-evidence": orphan,
        "duplicate-traces": c("shown") & c("duplicate_traces"), "duplicate-evaluator-evidence": c("shown") & c("duplicate_evidence"),
        "conflicting-evaluator-evidence": said("detail", "different-evidence", "conflicting-evaluator-evidence", "lineage"),
    }
    summed = lambda names: [F.sum(c(f"`{n}`")).alias(n) for n in names]
    per = rows.groupBy("case_id", "replicate").agg(*[F.count_if(test).alias(n) for n, test in tests.items()], F.max(own.cast("int")).alias("case-replicates"))
    per = per.groupBy("case_id").agg(*summed([*tests, "case-replicates"]), F.max("`case-replicates`").alias("cases"))
    names = [*tests, "cases", "case-replicates"]
    row = executions.agg(F.count("*").alias("trace-rows")).crossJoin(per.agg(*[F.coalesce(x, F.lit(0)).cast("bigint").alias(n) for n, x in zip(names, summed(names))]))
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("what"), c(f"`{n}`").alias("n")) for n in row.columns])).alias("x")).select("x.*")
