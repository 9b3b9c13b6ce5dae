"""The query of benchmark logs; every event is a log, made by one SQL text for both engines, which its SQL parses again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import benchlogs

_N = "CAST(user_id % 7 AS INT)"
_EXPECTED = f"CASE WHEN event_id % 23 = 0 THEN {_N} + 1 WHEN event_id % 19 <> 0 THEN {_N} END"


def _trial(i: int) -> str:
    """One trial: some on two lines, out of turn, of malformed numbers, indented, or with text after them."""
    text = lambda x: f"CAST({x} AS STRING)"
    number = f"CASE WHEN event_id % 17 = 0 THEN {i} + 1 ELSE {i} END"
    point = f"CASE WHEN event_id % 29 = {i} THEN '..' WHEN event_id % 31 = {i} THEN '' ELSE '.' END"
    gap = f"CASE WHEN (event_id + {i}) % 5 = 0 THEN concat(chr(10), '  ') ELSE ' ' END"
    return f"""CASE WHEN {_N} >= {i} THEN concat(CASE WHEN event_id % 37 = {i} THEN ' ' ELSE '' END, 'Trial ', {text(number)}, ':', {gap}, 'prompt_tps=', {text(f"(event_id * {i}) % 997")}, {point}, {text(f"user_id % {i + 3}")}, ',', {gap},
  'generation_tps=', {text(f"(event_id + {i} * 31) % 89")}, '.5, peak_memory=', {text(f"(user_id + {i} * 7) % 41")}, CASE WHEN event_id % 3 = 0 THEN '.125' ELSE '' END, CASE WHEN event_id % 41 = {i} THEN ' GB' ELSE '' END, CASE WHEN event_id % 43 = {i} THEN chr(13) ELSE '' END, chr(10)) ELSE '' END"""


BODY = f"concat('Running warmup..', chr(10), {', '.join(_trial(i) for i in range(1, 7))}, 'Averages: prompt_tps=1.0, generation_tps=2.0, peak_memory=3.0')"
_SUMMARIES = [*[f"{m}_{name}" for m in benchlogs.MEASURES for name in benchlogs.QUANTILES], "memory_max"]


def benchmark_logs(spark, sf_dir):
    """Trials, failures and summaries of every log."""
    logs = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(BODY).alias("body"), F.expr(_EXPECTED).alias("expected"))
    out = benchlogs.scan(logs, "body", F.col("expected"))
    said = F.array_join(F.transform("trials", lambda t: t["trial"].cast("string")), ",")
    return out.select("event_id", F.size("trials").cast("bigint").alias("n_trials"), said.alias("numbers"), "failure", *_SUMMARIES)


def queries() -> dict:
    return {"benchmark_logs": benchmark_logs}


def oracle_sql() -> dict[str, str]:
    duck = lambda text: text.replace("AS STRING", "AS VARCHAR")
    at = lambda m, p: f"(len({m}s) - 1) * CAST({p} AS DOUBLE)"
    value = lambda m, p, f: f"{m}s[CAST({f}({at(m, p)}) AS BIGINT) + 1]"
    quantiles = ", ".join(f"CASE WHEN failure IS NULL THEN {value(m, p, 'floor')} + ({value(m, p, 'ceil')} - {value(m, p, 'floor')}) * ({at(m, p)} - floor({at(m, p)})) END AS {m}_{name}" for m in benchlogs.MEASURES for name, p in benchlogs.QUANTILES.items())
    return {
        # Lines are put together to trials by what each line holds, without the operator's pattern over the whole log.
        "benchmark_logs": f"""WITH made AS (SELECT event_id, {duck(BODY)} AS body, {duck(_EXPECTED)} AS expected FROM events),
lines AS (SELECT event_id, i, l[i] AS line FROM (SELECT event_id, string_split(body, chr(10)) AS l FROM made), unnest(range(1, len(l) + 1)) AS t(i)),
parts AS (SELECT *, sum(CASE WHEN starts_with(line, 'Trial ') OR starts_with(line, 'Averages') OR starts_with(line, ' Trial') THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY i) AS part FROM lines),
joined AS (SELECT event_id, part, string_agg(line, ' ' ORDER BY i) AS whole FROM parts GROUP BY event_id, part),
fields AS (SELECT event_id, part, string_split_regex(whole, '[ ,:]+') AS f, whole FROM joined WHERE starts_with(whole, 'Trial ')),
valid AS (SELECT event_id, part, f[2] AS trial, split_part(f[3], '=', 2) AS prompt, split_part(f[4], '=', 2) AS generation, split_part(f[5], '=', 2) AS memory FROM fields WHERE len(f) = 5 AND NOT contains(whole, chr(13))),
numbers AS (SELECT event_id, part, CAST(trial AS BIGINT) AS trial, TRY_CAST(prompt AS DOUBLE) AS prompt, TRY_CAST(generation AS DOUBLE) AS generation, TRY_CAST(memory AS DOUBLE) AS memory FROM valid),
placed AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY part) AS place FROM numbers),
logs AS (SELECT event_id, count(*) AS n, string_agg(CAST(trial AS VARCHAR), ',' ORDER BY place) AS numbers, bool_or(prompt IS NULL OR generation IS NULL OR memory IS NULL) AS bad, bool_or(trial <> place) AS gap,
  list(prompt ORDER BY prompt) AS prompts, list(generation ORDER BY generation) AS generations, list(memory ORDER BY memory) AS memorys FROM placed GROUP BY event_id),
judged AS (SELECT made.event_id, logs.* EXCLUDE (event_id), CASE WHEN bad THEN 'invalid-number' WHEN n IS NULL THEN 'no-trials' WHEN n <> expected THEN 'trial-count' WHEN gap THEN 'trial-gap' END AS failure FROM made LEFT JOIN logs USING (event_id))
SELECT event_id, coalesce(n, 0) AS n_trials, coalesce(numbers, '') AS numbers, failure, {quantiles}, CASE WHEN failure IS NULL THEN memorys[len(memorys)] END AS memory_max FROM judged"""
    }
