"""Serving runtimes: what each can do, what became of an attempt, and how much work a shadow run may cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The capabilities that a runtime may have.
CAPABILITIES = [
    "chatCompletions",
    "completions",
    "responses",
    "nativeChat",
    "nativeGenerate",
    "streaming",
    "finalUsage",
    "logprobs",
    "structuredOutput",
    "tools",
    "cancellation",
    "modelDiscovery",
    "liveness",
    "readiness",
    "prometheusMetrics",
    "jsonMetrics",
]

# What each runtime supports, capability by capability.
RUNTIMES = {
    "llama.cpp": {
        "chatCompletions": "conditional",
        "completions": "supported",
        "responses": "conditional",
        "nativeChat": "unknown",
        "nativeGenerate": "unknown",
        "streaming": "supported",
        "finalUsage": "conditional",
        "logprobs": "conditional",
        "structuredOutput": "conditional",
        "tools": "conditional",
        "cancellation": "unknown",
        "modelDiscovery": "supported",
        "liveness": "supported",
        "readiness": "unknown",
        "prometheusMetrics": "conditional",
        "jsonMetrics": "unsupported",
    },
    "lm-studio": {
        "chatCompletions": "conditional",
        "completions": "unknown",
        "responses": "conditional",
        "nativeChat": "conditional",
        "nativeGenerate": "unknown",
        "streaming": "supported",
        "finalUsage": "supported",
        "logprobs": "unknown",
        "structuredOutput": "conditional",
        "tools": "conditional",
        "cancellation": "unknown",
        "modelDiscovery": "supported",
        "liveness": "unknown",
        "readiness": "unknown",
        "prometheusMetrics": "unknown",
        "jsonMetrics": "unknown",
    },
    "mlx-lm": {
        "chatCompletions": "conditional",
        "completions": "conditional",
        "responses": "unknown",
        "nativeChat": "unknown",
        "nativeGenerate": "unknown",
        "streaming": "supported",
        "finalUsage": "conditional",
        "logprobs": "conditional",
        "structuredOutput": "unsupported",
        "tools": "conditional",
        "cancellation": "unknown",
        "modelDiscovery": "supported",
        "liveness": "supported",
        "readiness": "unknown",
        "prometheusMetrics": "unsupported",
        "jsonMetrics": "unsupported",
    },
    "ollama": {
        "chatCompletions": "conditional",
        "completions": "conditional",
        "responses": "conditional",
        "nativeChat": "supported",
        "nativeGenerate": "supported",
        "streaming": "supported",
        "finalUsage": "supported",
        "logprobs": "conditional",
        "structuredOutput": "conditional",
        "tools": "conditional",
        "cancellation": "unknown",
        "modelDiscovery": "supported",
        "liveness": "conditional",
        "readiness": "unknown",
        "prometheusMetrics": "unsupported",
        "jsonMetrics": "unsupported",
    },
    "sglang": {
        "chatCompletions": "conditional",
        "completions": "supported",
        "responses": "conditional",
        "nativeChat": "unknown",
        "nativeGenerate": "unknown",
        "streaming": "supported",
        "finalUsage": "conditional",
        "logprobs": "conditional",
        "structuredOutput": "conditional",
        "tools": "conditional",
        "cancellation": "unknown",
        "modelDiscovery": "supported",
        "liveness": "conditional",
        "readiness": "conditional",
        "prometheusMetrics": "conditional",
        "jsonMetrics": "unsupported",
    },
    "tensorrt-llm": {
        "chatCompletions": "conditional",
        "completions": "supported",
        "responses": "conditional",
        "nativeChat": "unknown",
        "nativeGenerate": "unknown",
        "streaming": "supported",
        "finalUsage": "conditional",
        "logprobs": "conditional",
        "structuredOutput": "conditional",
        "tools": "conditional",
        "cancellation": "unknown",
        "modelDiscovery": "supported",
        "liveness": "supported",
        "readiness": "conditional",
        "prometheusMetrics": "conditional",
        "jsonMetrics": "conditional",
    },
    "tgi": {
        "chatCompletions": "conditional",
        "completions": "unknown",
        "responses": "unsupported",
        "nativeChat": "unknown",
        "nativeGenerate": "supported",
        "streaming": "supported",
        "finalUsage": "supported",
        "logprobs": "conditional",
        "structuredOutput": "conditional",
        "tools": "conditional",
        "cancellation": "unknown",
        "modelDiscovery": "supported",
        "liveness": "supported",
        "readiness": "unknown",
        "prometheusMetrics": "supported",
        "jsonMetrics": "unsupported",
    },
    "vllm": {
        "chatCompletions": "conditional",
        "completions": "supported",
        "responses": "conditional",
        "nativeChat": "unknown",
        "nativeGenerate": "unknown",
        "streaming": "supported",
        "finalUsage": "conditional",
        "logprobs": "conditional",
        "structuredOutput": "conditional",
        "tools": "conditional",
        "cancellation": "unknown",
        "modelDiscovery": "supported",
        "liveness": "supported",
        "readiness": "unknown",
        "prometheusMetrics": "supported",
        "jsonMetrics": "unsupported",
    },
}


def registry(spark) -> DataFrame:
    """(runtime, capability, support), a row for each of both."""
    rows = [(name, c, support) for name, own in RUNTIMES.items() for c, support in own.items()]
    return spark.createDataFrame(rows, "runtime string, capability string, support string")


def resolve(instances: DataFrame, probes: DataFrame) -> DataFrame:
    """(instance, capability, support) of instances (instance, runtime, pinned); probes (instance, capability, support).

    An instance whose build is not the pinned one, or whose runtime is not listed, has unknown support of everything; a
    probe of the instance itself overrides one capability.  The registry is a fixed table, hence broadcast.
    """
    spark = instances.sparkSession
    every = instances.withColumn("capability", F.explode(F.array(*map(F.lit, CAPABILITIES))))
    known = every.join(F.broadcast(registry(spark).withColumnRenamed("support", "listed")), ["runtime", "capability"], "left")
    probed = probes.groupBy("instance", "capability").agg(F.max("support").alias("probed"))
    found = known.join(probed, ["instance", "capability"], "left")
    listed = F.when(F.col("pinned"), F.col("listed"))
    return found.select("instance", "capability", F.coalesce("probed", listed, F.lit("unknown")).alias("support"))


def mismatches(resolved: DataFrame, required: list[str]) -> DataFrame:
    """(instance, lacking, open): required capabilities known to be lacking, and those that are not known for sure."""
    pick = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("support").isin(*kinds), F.col("capability"))))
    return resolved.where(F.col("capability").isin(*required)).groupBy("instance").agg(pick("unsupported").alias("lacking"), pick("unknown", "conditional").alias("open"))


def attempt_outcome(rows: DataFrame) -> DataFrame:
    """Adds abort, outcome and failure to attempts.

    Columns: status (completed, incomplete, failed), dispatch (not_sent, sent_unknown, completed), lifecycle
    (not-aborted, cancelled-before-dispatch, cancelled-after-dispatch, deadline-exceeded), partial, finish_reason, model,
    output, late (completed at or after the deadline of lease or run) and error (its category).  Nulls count as absent.
    """
    absent = lambda c: F.coalesce(c, F.lit(False))
    late, dispatch, status = absent(F.col("late")), F.col("dispatch"), F.col("status")
    abort = (
        F.when(late, "abort-ambiguous")
        .when(F.col("lifecycle") == "cancelled-before-dispatch", "abort-confirmed")
        .when(F.col("lifecycle") == "cancelled-after-dispatch", "abort-ambiguous")
        .when(F.col("lifecycle") == "deadline-exceeded", F.when(dispatch == "not_sent", "abort-confirmed").otherwise("abort-ambiguous"))
        .otherwise("not-aborted")
    )
    whole = F.col("finish_reason").isNotNull() & F.col("model").isNotNull() & F.col("output").isNotNull() & ~absent(F.col("partial"))
    success = absent((status == "completed") & (dispatch == "completed") & (abort == "not-aborted") & whole)
    outcome = F.when(success, "success").when(abort != "not-aborted", "aborted").otherwise("failure")
    failure = (
        F.when(success, None)
        .when(late, "timeout")
        .when(status == "incomplete", "incomplete-response")
        .when(abort != "not-aborted", F.coalesce("error", F.lit("cancelled")))
        .when(dispatch == "sent_unknown", "unknown")
        .otherwise(F.coalesce("error", F.when(status == "failed", "internal").otherwise("invalid-response")))
    )
    return rows.withColumns({"abort": abort, "outcome": outcome, "failure": failure})


def retryable(attempt: Column, most: int) -> Column:
    """Whether another attempt may follow: not sent, failed without an abort, in transport or by time, and one is left."""
    return (F.col("dispatch") == "not_sent") & (F.col("outcome") == "failure") & (F.col("abort") == "not-aborted") & F.col("failure").isin("transport", "timeout") & (attempt < most)


def admission(jobs: DataFrame, attempts: int, timeout_ms: int, limits: dict[str, int]) -> DataFrame:
    """One row of the work that jobs (profile, response_limit) may cause at most, and the limits that it breaks.

    Limits by name: executions, attempts, records, response_bytes, wall_ms.  Sums are decimals, so that none overflows.
    """
    big = lambda c: c.cast("decimal(38,0)")
    n = F.coalesce(big(F.sum(F.lit(1))), F.lit(0).cast("decimal(38,0)"))
    work = jobs.agg(n.alias("executions"), F.coalesce(big(F.sum(big(F.col("response_limit")) * attempts)), F.lit(0)).alias("response_bytes"))
    work = work.withColumn("attempts", F.col("executions") * attempts)
    work = work.withColumn("records", 1 + 3 * F.col("executions") + 2 * F.col("attempts")).withColumn("wall_ms", F.col("attempts") * timeout_ms)
    names = sorted(limits)
    broken = F.array_compact(F.array(*[F.when(F.col(k) > limits[k], k) for k in names]))
    return work.select(*[F.col(k).cast("decimal(38,0)").alias(k) for k in ("executions", "attempts", "records", "response_bytes", "wall_ms")], broken.alias("broken"))
