"""Queries of the controller, experiments, runtimes, provider responses and keyed identities, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import identity
from ..operators import controller, experiments, runtime
from ..sources import decoders, providers
from . import catalog

KEY = bytes(range(40))  # of a made-up study
SEEDS = [bytes([i + 1]) * 32 for i in range(5)]  # of made-up signers
REQUIRED = ["chatCompletions", "finalUsage", "streaming", "structuredOutput", "tools"]
LIMITS = {"executions": 20_000, "attempts": 100_000, "records": 1_000_000, "response_bytes": 10**9, "wall_ms": 10**12}
# Facts of each controller by place, in the order of an undisturbed life; what follows is drawn from LATER by the event.
LIFE = ["protocol-registered", "collection-started", "development-evidence-ready", "development-assessment-recorded", "shadow-assessment-started", "holdout-assessment-recorded", "window-manifest-recorded", "window-assessment-recorded", "deployment-observed"]
LATER = ["window-manifest-recorded", "window-assessment-recorded", "window-assessment-recorded", "identity-drift-recorded", "controller-retired", "deployment-observed", "window-manifest-recorded"]


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def controller_states(spark, sf_dir):
    """Each user's events as the facts of a controller, every ninth recorded twice."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = _t(spark, sf_dir, "events").withColumn("place", place)
    later = F.element_at(F.array(*map(F.lit, LATER)), (F.col("event_id") % len(LATER)).cast("int") + 1)
    fact = F.when(F.col("place") <= len(LIFE), F.element_at(F.array(*map(F.lit, LIFE)), F.least(F.col("place"), F.lit(len(LIFE))))).otherwise(later)
    good = F.when(F.col("place") == 4, "NOMINATED").otherwise("PASS")
    result = F.when(F.col("event_id") % 31 == 0, "STALE").when(F.col("event_id") % 17 == 0, "HOLD").otherwise(good)
    facts = e.select("user_id", "place", fact.alias("fact"), result.alias("result"), (F.col("place") > 40).alias("expired"), "event_id")
    twice = facts.withColumn("copy", F.explode(F.when(F.col("event_id") % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return controller.reduce_facts(twice.drop("copy", "event_id"), "user_id")


#: Gates of the first version by the names that the diagnosis knows.
GATES = {"mean_score": "minimum-mean-score", "slice_0": "paired-critical-slice-quality:1-urgent", "p95_ttft": "maximum-p95-ttft", "p95_e2e": "maximum-p95-end-to-end", "error_rate": "maximum-failure-rate", "cost_per_request": "maximum-cost-per-thousand"}


def experiment_proposals(spark, sf_dir):
    """What to try next for each policy, by its gates."""
    names = F.create_map(*[F.lit(x) for pair in GATES.items() for x in pair])
    failed = F.array_compact(F.collect_list(F.when(~F.col("pass"), F.try_element_at(names, F.col("gate")))))
    none = F.array().cast("array<string>")
    rows = catalog._gated(spark, sf_dir).groupBy("policy").agg(failed.alias("failed"), F.min("pass").alias("ok"))
    rows = rows.select("policy", F.lit("development").alias("phase"), F.when(F.col("ok"), "NOMINATED").otherwise("HOLD").alias("status"), "failed", none.alias("insufficient"), none.alias("stale"), F.lit(False).alias("capacity_unknown"), F.lit(False).alias("mismatch"))
    out = experiments.propose(experiments.diagnose(rows))
    return out.select("policy", "diagnosis", "variable", "target", F.array_join("evidence", ",").alias("evidence"), F.array_join("frozen", ",").alias("frozen"))


def _instances(spark, sf_dir):
    """Suppliers as instances of the runtimes, one in five of another build, one in seven probed."""
    names = F.array(*map(F.lit, sorted(runtime.RUNTIMES)))
    s = _t(spark, sf_dir, "supplier")
    instances = s.select(F.col("s_suppkey").alias("instance"), F.element_at(names, (F.col("s_suppkey") % 8).cast("int") + 1).alias("runtime"), (F.col("s_suppkey") % 5 != 0).alias("pinned"))
    probes = s.where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("instance"), F.lit("tools").alias("capability"), F.lit("unsupported").alias("support"))
    return runtime.resolve(instances, probes)


def runtime_capabilities(spark, sf_dir):
    """How many instances have which support of each capability."""
    return _instances(spark, sf_dir).groupBy("capability", "support").agg(F.count("*").alias("instances"))


def capability_mismatches(spark, sf_dir):
    """What the required capabilities lack, instance by instance."""
    out = runtime.mismatches(_instances(spark, sf_dir), REQUIRED)
    return out.select("instance", F.array_join("lacking", ",").alias("lacking"), F.array_join("open", ",").alias("open"))


def attempt_outcomes(spark, sf_dir):
    """Attempts made of the events' numbers, and whether each may be tried again."""
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("event_id") / n) % len(values)).cast("int") + 1)
    e = _t(spark, sf_dir, "events")
    rows = e.select(
        "event_id", pick(1, "completed", "completed", "completed", "incomplete", "failed").alias("status"), pick(2, "completed", "completed", "not_sent", "sent_unknown").alias("dispatch"),
        pick(3, "not-aborted", "not-aborted", "not-aborted", "cancelled-before-dispatch", "cancelled-after-dispatch", "deadline-exceeded").alias("lifecycle"),
        (F.col("event_id") % 13 == 0).alias("partial"), F.when(F.col("event_id") % 11 != 0, "stop").alias("finish_reason"), F.lit("m").alias("model"), F.when(F.col("user_id") % 10 != 0, "o").alias("output"),
        (F.col("event_id") % 29 == 0).alias("late"), F.when(F.col("event_id") % 3 == 0, "transport").when(F.col("event_id") % 7 == 0, "provider").alias("error"),
    )
    out = runtime.attempt_outcome(rows)
    again = F.coalesce(runtime.retryable(F.col("event_id") % 3 + 1, 3), F.lit(False))
    return out.select("event_id", "abort", "outcome", "failure", again.alias("again"))


def shadow_admission(spark, sf_dir):
    """The most work that a shadow run over all orders, two profiles and three replicates may cause."""
    jobs = _t(spark, sf_dir, "orders").select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r")).withColumn("profile", F.explode(F.array(F.lit("expert"), F.lit("primary")))).withColumn("response_limit", F.when(F.col("profile") == "expert", 4096).otherwise(1024))
    out = runtime.admission(jobs, 3, 2000, LIMITS)
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in LIMITS], F.array_join("broken", ",").alias("broken"))


def provider_usage(spark, sf_dir):
    """Usage written in three protocols from the lineitems, some without, some with a wrong total or another protocol's count."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("bigint").alias("a"), F.col("l_quantity").cast("bigint").alias("b"), "l_returnflag")
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    total = (F.col("a") + F.col("b") + F.when(F.col("a") % 7 == 0, 1).otherwise(0)).cast("string")
    reason = F.when(F.col("l_returnflag") == "R", "made_up").otherwise("length")
    chat = F.when(F.col("a") % 5 == 0, say('{"choices":[{"finish_reason":"', reason, '"}]}')).otherwise(say('{"choices":[{"finish_reason":"', reason, '"}],"usage":{"prompt_tokens":', a, ',"completion_tokens":', b, ',"total_tokens":', total, F.when(F.col("a") % 11 == 0, ',"input_tokens":1').otherwise(""), "}}"))
    responses = say('{"status":"completed","usage":{"input_tokens":', a, ',"output_tokens":', b, ',"total_tokens":', total, "}}")
    ollama = say('{"done_reason":"load","eval_count":', b, F.when(F.col("a") % 7 == 0, "").otherwise(say(',"prompt_eval_count":', a)), "}")
    out = None
    for name, body in (("openai-chat", chat), ("openai-responses", responses), ("ollama", ollama)):
        got = providers.usage(li.withColumn("body", body), "body", name).groupBy(F.lit(name).alias("protocol"), "finish", "usage_state").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("total_tokens").alias("total_tokens"))
        out = got if out is None else out.unionByName(got)
    return out


def model_listed(spark, sf_dir):
    """Model lists that name a model never, once or twice."""
    s = _t(spark, sf_dir, "supplier")
    entry = F.concat(F.lit('{"id":"m-'), F.col("s_suppkey").cast("string"), F.lit('"}'))
    body = F.concat(F.lit('{"object":"list","data":[{"id":"x"}'), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit(","), entry)).otherwise(""), F.when(F.col("s_suppkey") % 3 == 2, F.concat(F.lit(","), entry)).otherwise(""), F.lit("]}"))
    return s.select("s_suppkey", providers.model_listed(body, F.concat(F.lit("m-"), F.col("s_suppkey").cast("string"))).alias("listed"))


def json_metrics_page(spark, sf_dir):
    """Metric pages with a nested figure, one not asked for and one that is no number."""
    e = _t(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    body = F.concat(F.lit('[{"iter":'), n, F.lit(',"cpuMemUsage":1,"kvCacheStats":{"usedNumBlocks":'), n, F.lit(',"tokensPerBlock":32}},{"iter":'), F.when(F.col("event_id") % 4 == 0, '"many"').otherwise("1.5e1"), F.lit("}]"))
    got = providers.json_metrics(e.select("user_id", body.alias("body")), "user_id", "body", ["iter", "kvCacheStats.usedNumBlocks"])
    return got.groupBy("user_id", "metric").agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("bad"))


def stream_ends(spark, sf_dir):
    """Chat streams read from stored bytes; some fail, some lack the sentinel, some the usage before it."""
    e = _t(spark, sf_dir, "events")
    delta = F.lit('data: {"choices":[{"delta":{"content":"x"}}]}\n\n')
    used = F.when(F.col("event_id") % 3 > 0, 'data: {"choices":[],"usage":{"total_tokens":3}}\n\n').otherwise("")
    end = F.when(F.col("event_id") % 10 == 0, 'data: {"error":{"message":"no"}}\n\n').when(F.col("event_id") % 7 == 0, "").otherwise("data: [DONE]\n\n")
    events = decoders.sse(e.select("event_id", F.concat(delta, used, end).alias("body")), "event_id", "body")
    return providers.stream_end(events, "event_id", "openai-chat")


def hmac_identity(spark, sf_dir):
    out = identity.payload_identity(KEY, "evenkeel/payload/1", "study-1", "key-1", F.encode("props", "UTF-8"))
    return _t(spark, sf_dir, "events").select("event_id", out.alias("identity"))


def ed25519_verified(spark, sf_dir):
    """Nations signed by five keys; every third signature is another message's."""
    keys = spark.createDataFrame([(i, s, identity.public_key(s)) for i, s in enumerate(SEEDS)], "signer int, seed binary, public binary")
    signed = F.pandas_udf(lambda s, m: s.combine(m, lambda a, b: identity.sign(a, b.encode())), "binary")
    n = _t(spark, sf_dir, "nation").withColumn("signer", (F.col("n_nationkey") % 5).cast("int")).join(F.broadcast(keys), "signer")
    n = n.withColumn("signature", signed(F.col("seed"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("x")).otherwise(F.col("n_name"))))
    return n.select("n_nationkey", identity.ed25519_verify(F.col("public"), F.encode("n_name", "UTF-8"), F.col("signature")).alias("verified"))


def queries() -> dict:
    own = [controller_states, experiment_proposals, runtime_capabilities, capability_mismatches, attempt_outcomes, shadow_admission, provider_usage, model_listed, json_metrics_page, stream_ends, hmac_identity, ed25519_verified]
    return {f.__name__: f for f in own}


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_NEXT = """CASE WHEN (r.p + 1 > 40) AND fact NOT IN ('identity-drift-recorded', 'controller-retired') THEN NULL
  WHEN state = 'RETIRED' THEN NULL WHEN fact = 'identity-drift-recorded' THEN 'STALE' WHEN fact = 'controller-retired' THEN 'RETIRED'
  WHEN state = 'DRAFT' AND fact = 'protocol-registered' THEN 'REGISTERED' WHEN state = 'REGISTERED' AND fact = 'collection-started' THEN 'COLLECTING'
  WHEN state = 'COLLECTING' AND fact = 'development-evidence-ready' THEN 'DEV_READY'
  WHEN state = 'DEV_READY' AND fact = 'development-assessment-recorded' THEN CASE WHEN result IN ('NOMINATED', 'STALE') THEN result ELSE 'HOLD' END
  WHEN state = 'NOMINATED' AND fact = 'shadow-assessment-started' THEN 'SHADOW_ASSESSING'
  WHEN state = 'SHADOW_ASSESSING' AND fact = 'holdout-assessment-recorded' THEN CASE result WHEN 'PASS' THEN 'HOLDOUT_CONFIRMED' WHEN 'STALE' THEN 'STALE' ELSE 'HOLD' END
  WHEN state = 'PROMOTION_RECOMMENDED' AND fact = 'window-manifest-recorded' THEN 'HOLDOUT_CONFIRMED'
  WHEN state IN ('SHADOW_ASSESSING', 'HOLDOUT_CONFIRMED', 'MONITORING') AND fact = 'window-manifest-recorded' THEN state
  WHEN state = 'HOLDOUT_CONFIRMED' AND fact = 'window-assessment-recorded' THEN CASE result WHEN 'PASS' THEN 'PROMOTION_RECOMMENDED' WHEN 'STALE' THEN 'STALE' ELSE 'HOLD' END
  WHEN state = 'MONITORING' AND fact = 'window-assessment-recorded' THEN CASE result WHEN 'PASS' THEN state WHEN 'STALE' THEN 'STALE' WHEN 'HOLD' THEN 'ROLLBACK_RECOMMENDED' ELSE 'HOLD' END
  WHEN state = 'PROMOTION_RECOMMENDED' AND fact = 'deployment-observed' THEN 'MONITORING' END"""

_REGISTRY = "(VALUES " + ", ".join(f"('{n}', '{c}', '{support}')" for n, own in runtime.RUNTIMES.items() for c, support in own.items()) + ") AS g(runtime, capability, support)"


def oracle_sql() -> dict[str, str]:
    pick = lambda n, *v: f"{_list(v)}[CAST(event_id // {n} % {len(v)} AS INTEGER) + 1]"
    inner, outer = ("".join(f"{b ^ pad:02X}" for b in KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    head = b"evenkeel/payload/1study-1\0key-1\0".hex()
    proposals = ", ".join("(" + ", ".join(f"'{x}'" for x in (d, v, t, ",".join(e), ",".join(sorted(set(experiments.ALWAYS + experiments.SOMETIMES) - {f})))) + ")" for d, v, t, e, f in experiments.PROPOSALS)
    return {
        "controller_states": f"""WITH RECURSIVE placed AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
f AS (
  SELECT user_id, p, CASE WHEN p <= {len(LIFE)} THEN {_list(LIFE)}[p] ELSE {_list(LATER)}[event_id % {len(LATER)} + 1] END AS fact,
    CASE WHEN event_id % 31 = 0 THEN 'STALE' WHEN event_id % 17 = 0 THEN 'HOLD' WHEN p = 4 THEN 'NOMINATED' ELSE 'PASS' END AS result FROM placed),
r AS (
  SELECT DISTINCT user_id, 0::BIGINT AS p, 'DRAFT' AS state, FALSE AS stopped FROM events
  UNION ALL SELECT r.user_id, CASE WHEN after IS NULL THEN r.p ELSE r.p + 1 END, coalesce(after, state), after IS NULL
  FROM (SELECT r.*, {_NEXT} AS after FROM r JOIN f ON f.user_id = r.user_id AND f.p = r.p + 1 WHERE NOT stopped) AS r)
SELECT user_id, arg_max(state, p) AS state, max(p) AS applied, CASE WHEN bool_or(stopped) THEN max(p) + 1 END AS refused FROM r GROUP BY user_id""",
        "experiment_proposals": f"""WITH {catalog._gated_sql(catalog.LIMITS)},
w AS (SELECT policy, bool_and(pass) AS ok, list(gate) FILTER (NOT pass) AS bad FROM gated GROUP BY policy),
d AS (SELECT policy, CASE WHEN list_contains(bad, 'mean_score') THEN 'quality-regression' WHEN list_contains(bad, 'slice_0') THEN 'critical-slice-regression'
  WHEN list_contains(bad, 'p95_ttft') THEN 'ttft-regression' WHEN list_contains(bad, 'p95_e2e') THEN 'tail-latency-regression' WHEN list_contains(bad, 'error_rate') THEN 'error-regression'
  WHEN list_contains(bad, 'cost_per_request') THEN 'cost-regression' WHEN ok THEN 'sealed-shadow-replication' END AS diagnosis FROM w)
SELECT policy, diagnosis, variable, target, evidence, frozen FROM d JOIN (VALUES {proposals}) AS t(diagnosis, variable, target, evidence, frozen) USING (diagnosis)""",
        "runtime_capabilities": f"""WITH i AS (SELECT s_suppkey AS instance, {_list(sorted(runtime.RUNTIMES))}[s_suppkey % 8 + 1] AS runtime, s_suppkey % 5 != 0 AS pinned FROM supplier)
SELECT capability, CASE WHEN capability = 'tools' AND instance % 7 = 0 THEN 'unsupported' WHEN pinned THEN support ELSE 'unknown' END AS support, count(*) AS instances FROM i JOIN {_REGISTRY} USING (runtime) GROUP BY ALL""",
        "capability_mismatches": f"""WITH i AS (SELECT s_suppkey AS instance, {_list(sorted(runtime.RUNTIMES))}[s_suppkey % 8 + 1] AS runtime, s_suppkey % 5 != 0 AS pinned FROM supplier),
a AS (SELECT instance, capability, CASE WHEN capability = 'tools' AND instance % 7 = 0 THEN 'unsupported' WHEN pinned THEN support ELSE 'unknown' END AS s
  FROM i JOIN {_REGISTRY} USING (runtime) WHERE capability IN ({", ".join(f"'{c}'" for c in REQUIRED)}))
SELECT instance, coalesce(string_agg(capability, ',' ORDER BY capability) FILTER (s = 'unsupported'), '') AS lacking,
  coalesce(string_agg(capability, ',' ORDER BY capability) FILTER (s IN ('unknown', 'conditional')), '') AS open FROM a GROUP BY instance""",
        "attempt_outcomes": f"""WITH a AS (
  SELECT event_id, {pick(1, "completed", "completed", "completed", "incomplete", "failed")} AS status, {pick(2, "completed", "completed", "not_sent", "sent_unknown")} AS dispatch,
    {pick(3, "not-aborted", "not-aborted", "not-aborted", "cancelled-before-dispatch", "cancelled-after-dispatch", "deadline-exceeded")} AS lifecycle, event_id % 13 = 0 AS partial,
    event_id % 11 != 0 AS finished, user_id % 10 != 0 AS has_output, event_id % 29 = 0 AS late, CASE WHEN event_id % 3 = 0 THEN 'transport' WHEN event_id % 7 = 0 THEN 'provider' END AS error FROM events),
b AS (SELECT *, CASE WHEN late THEN 'abort-ambiguous' WHEN lifecycle = 'not-aborted' THEN 'not-aborted' WHEN lifecycle = 'cancelled-before-dispatch' OR (lifecycle = 'deadline-exceeded' AND dispatch = 'not_sent') THEN 'abort-confirmed' ELSE 'abort-ambiguous' END AS abort FROM a),
c AS (SELECT *, CASE WHEN status = 'completed' AND dispatch = 'completed' AND abort = 'not-aborted' AND NOT partial AND finished AND has_output THEN 'success' WHEN abort != 'not-aborted' THEN 'aborted' ELSE 'failure' END AS outcome FROM b),
d AS (SELECT *, CASE WHEN outcome = 'success' THEN NULL WHEN late THEN 'timeout' WHEN status = 'incomplete' THEN 'incomplete-response' WHEN outcome = 'aborted' THEN coalesce(error, 'cancelled')
  WHEN dispatch = 'sent_unknown' THEN 'unknown' ELSE coalesce(error, CASE WHEN status = 'failed' THEN 'internal' ELSE 'invalid-response' END) END AS failure FROM c)
SELECT event_id, abort, outcome, failure, coalesce(dispatch = 'not_sent' AND outcome = 'failure' AND failure IN ('transport', 'timeout') AND event_id % 3 < 2, FALSE) AS again FROM d""",
        "shadow_admission": f"""WITH n AS (SELECT count(*) * 6 AS executions, count(*) * 18 AS attempts, count(*) * 54 + 1 AS records, count(*) * 9 * 5120 AS response_bytes, count(*) * 36000 AS wall_ms FROM orders)
SELECT *, concat_ws(',', CASE WHEN attempts > {LIMITS["attempts"]} THEN 'attempts' END, CASE WHEN executions > {LIMITS["executions"]} THEN 'executions' END, CASE WHEN records > {LIMITS["records"]} THEN 'records' END,
  CASE WHEN response_bytes > {LIMITS["response_bytes"]} THEN 'response_bytes' END, CASE WHEN wall_ms > {LIMITS["wall_ms"]} THEN 'wall_ms' END) AS broken FROM n""",
        "provider_usage": """WITH r AS (SELECT CAST(l_partkey AS BIGINT) AS a, CAST(l_quantity AS BIGINT) AS b, l_returnflag AS f FROM lineitem),
u AS (
  SELECT 'openai-chat' AS protocol, CASE WHEN f = 'R' THEN 'other' ELSE 'length' END AS finish, CASE WHEN a % 5 = 0 THEN 'missing' WHEN a % 7 = 0 OR a % 11 = 0 THEN 'invalid' ELSE 'valid' END AS usage_state, a, b FROM r
  UNION ALL SELECT 'openai-responses', 'completed', CASE WHEN a % 7 = 0 THEN 'invalid' ELSE 'valid' END, a, b FROM r
  UNION ALL SELECT 'ollama', 'load', CASE WHEN a % 7 = 0 THEN 'invalid' ELSE 'valid' END, a, b FROM r)
SELECT protocol, finish, usage_state, count(*) AS n, CAST(sum(a) FILTER (usage_state = 'valid') AS BIGINT) AS input_tokens, CAST(sum(a + b) FILTER (usage_state = 'valid') AS BIGINT) AS total_tokens FROM u GROUP BY ALL""",
        "model_listed": "SELECT s_suppkey, s_suppkey % 3 = 1 AS listed FROM supplier",
        "json_metrics_page": """SELECT user_id, 'iter' AS metric, CAST(sum(event_id + CASE WHEN event_id % 4 = 0 THEN 0 ELSE 15 END) AS DOUBLE) AS total, 2 * count(*) AS n, count(*) FILTER (event_id % 4 = 0) AS bad FROM events GROUP BY user_id
UNION ALL SELECT user_id, 'kvCacheStats.usedNumBlocks', CAST(sum(event_id) AS DOUBLE), count(*), 0 FROM events GROUP BY user_id""",
        "stream_ends": """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'provider-error' WHEN event_id % 7 = 0 THEN 'truncated' ELSE 'done-sentinel' END AS terminal,
  CASE WHEN event_id % 10 != 0 AND event_id % 7 != 0 AND event_id % 3 > 0 THEN 'present' ELSE 'missing' END AS final_usage FROM events""",
        "hmac_identity": f"SELECT event_id, sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || unhex('{head}') || encode(props)))) AS identity FROM events",
        "ed25519_verified": "SELECT n_nationkey, n_nationkey % 3 != 0 AS verified FROM nation",
    }
