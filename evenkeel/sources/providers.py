"""Decoders of providers' stored responses: usage, model lists, metrics, ends of event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Finish reasons that are kept as they are.
FINISH_REASONS = ["abort", "cancelled", "completed", "content_filter", "eos_token", "error", "function_call", "length", "load", "stop", "stop_sequence", "tool_calls", "unload"]

# The operational metrics of the JSON metrics page.
JSON_METRICS = [
    "gpuMemUsage", "cpuMemUsage", "iter", "iterLatencyMS", "numActiveRequests", "numQueuedRequests", "numContextRequests", "numGenerationRequests",
    "kvCacheStats.allocNewBlocks", "kvCacheStats.allocTotalBlocks", "kvCacheStats.cacheHitRate", "kvCacheStats.freeNumBlocks", "kvCacheStats.maxNumBlocks",
    "kvCacheStats.missedBlocks", "kvCacheStats.reusedBlocks", "kvCacheStats.tokensPerBlock", "kvCacheStats.usedNumBlocks",
]

# Wire protocol, path of the input and output counts and of the total, path of the finish reason.
USAGE = {
    "openai-chat": ("usage", "prompt_tokens", "completion_tokens", "total_tokens", "choices[0].finish_reason"),
    "openai-responses": ("usage", "input_tokens", "output_tokens", "total_tokens", "status"),
    "ollama": (None, "prompt_eval_count", "eval_count", None, "done_reason"),
}
SAFE = 2**53 - 1


def finish_reason(raw: Column) -> Column:
    """A known reason, or `other`; null where there is none or it is no text of 1 to 128 characters."""
    fits = F.length(raw).between(1, 128)
    return F.when(fits, F.when(raw.isin(*FINISH_REASONS), raw).otherwise("other"))


def _count(raw: Column) -> Column:
    """A count of tokens: a whole number from 0 to 2^53 - 1, else null."""
    n = F.when(raw.rlike(r"^(0|[1-9]\d{0,15})$"), raw.cast("bigint"))
    return F.when(n <= SAFE, n)


def usage(rows: DataFrame, body: str, protocol: str) -> DataFrame:
    """Adds input_tokens, output_tokens, total_tokens, finish, usage_state of one protocol's response bodies.

    The state is `missing` without usage, `invalid` where a count is none, is the other protocol's, or the total is not
    the sum, else `valid`; only a valid usage has counts.
    """
    root, inp, out, total, reason = USAGE[protocol]
    at = f"$.{root}." if root else "$."
    foreign = [x for name, p in USAGE.items() if root and p[0] == root and name != protocol for x in p[1:3]]
    paths = {"a": at + inp, "b": at + out, "reason": f"$.{reason}", **({"c": at + total} if total else {}), **({"root": f"$.{root}"} if root else {}), **{f"x{i}": at + x for i, x in enumerate(foreign)}}
    # values first, each path of a body is parsed once, then what is made of them
    read = rows.withColumns({f"_usage_{n}": F.get_json_object(F.col(body), path) for n, path in paths.items()})
    raw = lambda n: F.col(f"_usage_{n}")
    read = read.withColumns({"_usage_in": _count(raw("a")), "_usage_out": _count(raw("b"))})
    a, b = raw("in"), raw("out")
    c = _count(raw("c")) if total else a + b
    none = raw("root").isNull() if root else raw("a").isNull() & raw("b").isNull()
    strange = F.coalesce(*[raw(f"x{i}") for i in range(len(foreign))]).isNotNull() if foreign else F.lit(False)
    read = read.withColumn("_usage_sum", c)
    c = raw("sum")
    sound = F.coalesce(~strange & (c == a + b) & (c <= SAFE), F.lit(False))
    state = F.when(none, "missing").when(sound, "valid").otherwise("invalid")
    kept = {n: F.when(F.col("usage_state") == "valid", v) for n, v in (("input_tokens", a), ("output_tokens", b), ("total_tokens", c))}
    read = read.withColumns({"finish": finish_reason(raw("reason")), "usage_state": state}).withColumns(kept)
    return read.drop(*[n for n in read.columns if n.startswith("_usage_") and n not in rows.columns])


def model_listed(body: Column, model: Column) -> Column:
    """Whether a model list names each model once and this one among them; false for bodies that are no list."""
    ids = F.from_json(F.get_json_object(body, "$.data"), "array<struct<id:string>>")["id"]
    sound = (F.get_json_object(body, "$.object") == "list") & F.forall(ids, lambda x: F.length(x).between(1, 512)) & (F.size(F.array_distinct(ids)) == F.size(ids))
    return F.coalesce(sound & F.array_contains(ids, model), F.lit(False))


def json_metrics(rows: DataFrame, key: str, body: str, selected: list[str]) -> DataFrame:
    """(key, metric, value) of the selected metrics of stored metric pages, an array of objects each; others are ignored.

    A value that is no finite number is null; a page that is no array gives no rows.
    """
    unknown = sorted(set(selected) - set(JSON_METRICS))
    if unknown:
        raise ValueError(f"not a metric: {unknown[0]}")
    flat = rows.select(key, F.explode(F.from_json(body, "array<string>")).alias("row"))
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.get_json_object("row", f"$.{m}").alias("raw")) for m in selected])
    each = flat.select(key, F.explode(F.filter(entries, lambda e: e["raw"].isNotNull())).alias("e"))
    number = F.expr("try_cast(e.raw AS double)")
    finite = F.col("e.raw").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    return each.select(key, "e.metric", F.when(finite & (F.abs(number) < float("inf")), number).alias("value"))


def stream_end(events: DataFrame, key: str, protocol: str) -> DataFrame:
    """(key, terminal, final_usage) from the events (key, place, event, data) of stored JSON event streams.

    Protocols: generic, openai-chat, openai-responses.  Terminal: provider-error, done-sentinel, response.completed, eof or
    truncated.  Final usage is present where the event before the sentinel, or the completed response, has usage.
    """
    done = F.col("data") == "[DONE]"
    kind = F.coalesce(F.get_json_object("data", "$.type"), F.col("event"))
    used = F.coalesce(F.get_json_object("data", "$.usage"), F.get_json_object("data", "$.response.usage")).isNotNull()
    failed = (F.col("event") == "error") | (kind == "error") | kind.endswith(".error") | F.coalesce(F.array_contains(F.json_object_keys("data"), "error"), F.lit(False))
    before = F.lag("used").over(Window.partitionBy(key).orderBy("place"))
    rows = events.select(key, "place", done.alias("done"), kind.alias("kind"), used.alias("used"), F.coalesce(failed, F.lit(False)).alias("failed")).withColumn("before", before)
    completed = F.col("kind") == "response.completed"
    ends = rows.groupBy(key).agg(F.max("failed").alias("failed"), F.max_by("done", "place").alias("done"), F.max_by("before", "place").alias("before"), F.max(completed).alias("completed"), F.max(completed & F.col("used")).alias("completed_used"))
    if protocol == "openai-responses":
        last, present = F.when(F.col("completed"), "response.completed").otherwise("truncated"), F.col("completed_used")
    else:
        last, present = F.when(F.col("done"), "done-sentinel").otherwise("eof" if protocol == "generic" else "truncated"), F.col("done") & F.col("before")
    state = F.lit("not-required") if protocol == "generic" else F.when(~F.col("failed") & present, "present").otherwise("missing")
    return ends.select(key, F.when(F.col("failed"), "provider-error").otherwise(last).alias("terminal"), state.alias("final_usage"))
