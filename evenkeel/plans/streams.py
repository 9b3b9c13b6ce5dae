"""Queries of stored response streams in both formats; their SQL parses the same bodies line by line.

The bodies are made of the events by one SQL text for both engines: line ends, comments, retries, marks, errors, usage, blank
lines, data after the end and tails without an end, as the event's number says.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import streams

_LF = "CASE event_id % 3 WHEN 0 THEN chr(10) WHEN 1 THEN concat(chr(13), chr(10)) ELSE chr(13) END"
SSE = f"""concat(CASE WHEN event_id % 13 = 0 THEN chr(65279) ELSE '' END,
  CASE WHEN event_id % 5 = 0 THEN concat(': note', lf, 'retry: ', CAST(event_id AS STRING), lf) ELSE '' END,
  'id: ', CAST(event_id % 4 AS STRING), lf, 'data: {{"choices":[{{"delta":{{"content":"', CASE WHEN event_id % 6 <> 0 THEN 'x' ELSE '' END, '"}}}}]}}', lf, lf,
  CASE WHEN event_id % 10 = 0 THEN concat('event: ', CASE WHEN event_id % 20 = 0 THEN 'error' ELSE 'note' END, lf, 'data: {{"message":"no"', CASE WHEN event_id % 30 = 0 THEN ',"error":null' ELSE '' END, '}}', lf, lf) ELSE '' END,
  CASE WHEN event_id % 17 = 0 THEN concat('data: {{', lf, lf) ELSE '' END,
  CASE WHEN event_id % 4 > 0 THEN concat('data: {{"choices":[],', lf, 'data: "usage":', CASE WHEN event_id % 4 = 1 THEN 'null' ELSE '{{"total_tokens":3}}' END, '}}', lf, lf) ELSE '' END,
  CASE WHEN event_id % 7 <> 0 THEN concat('data: [DONE]', lf, lf) ELSE '' END,
  CASE WHEN event_id % 19 = 0 THEN concat('data: {{}}', lf, lf) WHEN event_id % 23 = 0 THEN 'data: lost' ELSE '' END)"""
_LINE = "CASE event_id % 2 WHEN 0 THEN chr(10) ELSE concat(chr(13), chr(10)) END"
NDJSON = """CASE WHEN event_id % 29 = 0 THEN '' ELSE concat('{"response":"', CASE WHEN event_id % 6 <> 0 THEN 'x' ELSE '' END, '"}', lf,
  CASE WHEN event_id % 11 = 0 THEN concat('{"message":{"content":"y"}}', lf) ELSE '' END,
  CASE WHEN event_id % 13 = 0 THEN concat('{"error":"no"}', lf) ELSE '' END,
  CASE WHEN event_id % 17 = 0 THEN concat('{"response"', lf) ELSE '' END,
  CASE WHEN event_id % 19 = 0 THEN concat(' ', lf) ELSE '' END,
  CASE WHEN event_id % 7 <> 0 THEN concat('{"done":', CASE WHEN event_id % 9 = 0 THEN '"true"' ELSE 'true' END, ',"prompt_eval_count":', CASE event_id % 5 WHEN 0 THEN '-1' WHEN 1 THEN '2.5' ELSE '3' END, ',"eval_count":', CAST(event_id AS STRING), '}') ELSE '' END,
  CASE WHEN event_id % 23 = 0 THEN concat(lf, '{"late":1}', lf) WHEN event_id % 2 = 0 THEN lf ELSE '' END) END"""


def _bodies(spark, sf_dir, body: str, lf: str):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(lf).alias("lf"))
    return rows.select("event_id", F.expr(body.replace("chr(65279)", "decode(X'EFBBBF', 'UTF-8')")).alias("body"))  # chr ends at 255 here


def chat_streams(spark, sf_dir):
    """What became of the event streams of a chat protocol."""
    return streams.read_stream(_bodies(spark, sf_dir, SSE, _LF), "event_id", "body", "openai-chat", "sse")


def sse_frames(spark, sf_dir):
    """Every event of those streams with its id, retry and comments."""
    out = streams.sse_frames(_bodies(spark, sf_dir, SSE, _LF), "event_id", "body")
    return out.where("place IS NOT NULL").select("event_id", "place", "kind", "event", "id", "retry", F.array_join("comments", "|").alias("comments"), "data", "incomplete")


def ndjson_streams(spark, sf_dir):
    """What became of streams of lines."""
    return streams.read_stream(_bodies(spark, sf_dir, NDJSON, _LINE), "event_id", "body", "ollama", "ndjson")


def queries() -> dict:
    return {f.__name__: f for f in (chat_streams, sse_frames, ndjson_streams)}


def _sql(body: str, lf: str) -> str:
    return f"SELECT event_id, {body.replace('STRING', 'VARCHAR')} AS body FROM (SELECT event_id, {lf} AS lf FROM events)"


_FRAMES = f"""
made AS ({_sql(SSE, _LF)}),
cut AS (SELECT event_id, string_split(replace(replace(ltrim(body, chr(65279)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM made),
numbered AS (SELECT event_id, i, l[i] AS line, len(l) AS n FROM cut, unnest(range(1, len(l) + 1)) AS t(i)),
framed AS (SELECT *, coalesce(sum(CASE WHEN line = '' AND i < n THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frame FROM numbered),
fields AS (SELECT *, regexp_extract(line, '^([^:]*)', 1) AS name, regexp_replace(CASE WHEN contains(line, ':') THEN substring(line, position(':' IN line) + 1) ELSE '' END, '^ ', '') AS value FROM framed WHERE line <> ''),
ended AS (SELECT event_id, sum(CASE WHEN line = '' AND i < n THEN 1 ELSE 0 END) AS frames FROM numbered GROUP BY event_id),
held AS (
  SELECT fields.event_id, frame, frame >= frames AS tail, string_agg(value, chr(10) ORDER BY i) FILTER (name = 'data') AS data, arg_max(value, i) FILTER (name = 'event') AS event,
    arg_max(value, i) FILTER (name = 'id') AS own_id, arg_max(TRY_CAST(value AS BIGINT), i) FILTER (name = 'retry' AND regexp_matches(value, '^[0-9]+$')) AS retry, coalesce(string_agg(value, '|' ORDER BY i) FILTER (name = '' AND line[1] = ':'), '') AS said
  FROM fields JOIN ended USING (event_id) GROUP BY ALL),
tails AS (SELECT event_id, bool_or(tail) AS incomplete FROM held GROUP BY event_id),
idle AS (SELECT *, coalesce(last_value(own_id IGNORE NULLS) OVER (PARTITION BY event_id ORDER BY frame), '') AS id FROM held WHERE NOT tail),
events_ AS (
  SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY frame) - 1 AS place, CASE WHEN data = '[DONE]' THEN 'done' ELSE 'event' END AS kind, nullif(event, '') AS event, id, retry, said, data, incomplete
  FROM idle JOIN tails USING (event_id) WHERE data IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "sse_frames": f"""WITH {_FRAMES}
SELECT event_id, CAST(place AS INTEGER) AS place, kind, event, id, retry, CASE WHEN said = '' THEN '' ELSE ' ' || said END AS comments, data, incomplete FROM events_""",
        "chat_streams": f"""WITH {_FRAMES},
judged AS (
  SELECT event_id, place, kind, incomplete, kind = 'done' OR json_valid(data) AS valid, kind = 'event' AND (coalesce(event = 'error', FALSE) OR json_valid(data) AND list_contains(json_keys(CASE WHEN json_valid(data) THEN data ELSE '{{}}' END), 'error')) AS error,
    kind = 'event' AND json_valid(data) AND coalesce(json_type(CASE WHEN json_valid(data) THEN data ELSE '{{}}' END, '$.usage') <> 'NULL', FALSE) AS used,
    kind = 'event' AND json_valid(data) AND coalesce(json_extract_string(CASE WHEN json_valid(data) THEN data ELSE '{{}}' END, '$.choices[0].delta.content') <> '', FALSE) AS output FROM events_),
marked AS (SELECT *, error OR kind = 'done' AS ends, lag(used) OVER (PARTITION BY event_id ORDER BY place) AS used_before FROM judged),
firsts AS (
  SELECT event_id, count(*) AS n, min(place) FILTER (ends) AS e, min(place) FILTER (NOT valid) AS b, min(place) FILTER (kind = 'done') AS d, bool_or(incomplete) AS incomplete, bool_or(error) AS error, arg_max(kind, place) AS last_kind,
    arg_max(coalesce(used_before, FALSE), place) AS last_used, min(place) FILTER (output AND NOT error) AS first_output FROM marked GROUP BY event_id),
late AS (SELECT *, CASE WHEN d IS NOT NULL AND (d + 1 < n OR incomplete) THEN d + 1 END AS s, CASE WHEN e + 1 < n OR incomplete THEN e + 1 END AS x FROM firsts),
said AS (SELECT *, CASE WHEN s IS NOT NULL THEN 'terminal-order' WHEN x <= coalesce(b, x) THEN 'terminal-order' WHEN b IS NOT NULL THEN 'invalid-json' END AS failure FROM late)
SELECT event_id, n AS items, failure, CASE WHEN failure IS NOT NULL THEN coalesce(s, least(x, b)) END AS failed_at,
  CASE WHEN failure IS NULL THEN CASE WHEN error THEN 'provider-error' WHEN last_kind = 'done' THEN 'done-sentinel' ELSE 'truncated' END END AS terminal,
  CASE WHEN failure IS NULL THEN CASE WHEN NOT error AND last_kind = 'done' AND last_used THEN 'present' ELSE 'missing' END END AS final_usage, CASE WHEN failure IS NULL THEN first_output END AS first_output FROM said""",
        "ndjson_streams": f"""WITH made AS ({_sql(NDJSON, _LINE)}),
cut AS (SELECT event_id, CASE WHEN body = '' THEN []::VARCHAR[] ELSE string_split(CASE WHEN right(body, 1) = chr(10) THEN left(body, length(body) - 1) ELSE body END, chr(10)) END AS l FROM made),
lines AS (SELECT event_id, i - 1 AS place, rtrim(l[i], chr(13)) AS data FROM cut, unnest(range(1, len(l) + 1)) AS t(i)),
safe AS (SELECT *, trim(data) = '' AS blank, json_valid(data) AND trim(data) <> '' AS valid, CASE WHEN json_valid(data) AND trim(data) <> '' THEN data ELSE '{{}}' END AS j FROM lines),
judged AS (
  SELECT event_id, place, blank, valid, list_contains(json_keys(j), 'error') AS error, coalesce(json_type(j, '$.done') = 'BOOLEAN' AND json_extract_string(j, '$.done') = 'true', FALSE) AS done,
    coalesce(json_type(j, '$.prompt_eval_count') = 'UBIGINT' AND json_type(j, '$.eval_count') = 'UBIGINT', FALSE) AS used, coalesce(json_extract_string(j, '$.response') <> '', FALSE) OR coalesce(json_extract_string(j, '$.message.content') <> '', FALSE) AS output FROM safe),
firsts AS (
  SELECT event_id, count(*) AS n, min(place) FILTER (error OR done) AS e, min(place) FILTER (NOT valid AND NOT blank) AS b, min(place) FILTER (blank) AS w, bool_or(error) AS error, arg_max(done, place) AS done, arg_max(used, place) AS used, min(place) FILTER (output AND NOT error AND NOT done) AS first_output
  FROM judged GROUP BY event_id),
late AS (SELECT *, CASE WHEN e + 1 < n THEN e + 1 END AS x FROM firsts),
said AS (SELECT *, least(w, x, b) AS f, CASE WHEN w = least(w, x, b) THEN 'blank-line' WHEN x = least(w, x, b) THEN 'terminal-order' WHEN b = least(w, x, b) THEN 'invalid-json' END AS failure FROM late)
SELECT event_id, coalesce(n, 0) AS items, failure, f AS failed_at, CASE WHEN failure IS NULL THEN CASE WHEN coalesce(error, FALSE) THEN 'provider-error' WHEN coalesce(done, FALSE) THEN 'done' ELSE 'truncated' END END AS terminal,
  CASE WHEN failure IS NULL THEN CASE WHEN coalesce(done AND used, FALSE) THEN 'present' ELSE 'missing' END END AS final_usage, CASE WHEN failure IS NULL THEN first_output END AS first_output
FROM made LEFT JOIN said USING (event_id)""",
    }
