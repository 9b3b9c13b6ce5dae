"""Queries of metric pages and of collector policies, with SQL that reads the same lines and compares the same routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collector
from ..sources import exposition

#: Both engines' text: the events as pages of lines, a page for every eighth of a user's, with something wrong here and there.
LINES = r"""
numbered AS (SELECT event_id, user_id, event_type, concat(CAST(user_id AS STRING), '/', CAST(event_id % 8 AS STRING)) AS page, row_number() OVER (PARTITION BY user_id, event_id % 8 ORDER BY event_id) AS place FROM events),
lines AS (
  SELECT page, CAST(place * 3 - 2 AS INT) AS number, CASE WHEN place = 1 THEN concat('# TYPE events_', event_type, ' gauge') WHEN event_id % 401 = 0 THEN '# UNIT events s' WHEN event_id % 251 = 0 THEN '# EOF' WHEN event_id % 151 = 0 THEN concat('# TYPE events_', event_type, ' counter') ELSE '# note' END AS line FROM numbered
  UNION ALL SELECT page, CAST(place * 3 - 1 AS INT), CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 199 = 0 THEN '# HELP events' ELSE concat('# HELP e', CAST(event_id AS STRING), ' text') END FROM numbered
  UNION ALL SELECT page, CAST(place * 3 AS INT), concat('events_', event_type, '{n="', CASE WHEN event_id % 97 = 0 THEN '0' ELSE CAST(event_id AS STRING) END, '",', CASE WHEN event_id % 307 = 0 THEN 'n' ELSE 'a' END, '="x y"', '} ',
    CASE WHEN event_id % 211 = 0 THEN 'NaN' WHEN event_id % 223 = 0 THEN '1.2.3' WHEN event_id % 2 = 0 THEN '1.5e3' ELSE '-7' END, CASE WHEN event_id % 3 = 0 THEN concat(' ', CAST(event_id AS STRING)) ELSE '' END) FROM numbered)
"""


def exposition_pages(spark, sf_dir):
    """Each metric page's counts, and the first line for which a reader refuses it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    text = LINES.replace("{n=", "{{n=").replace("'} '", "'}} '").replace("FROM events)", "FROM {events})")
    rows = spark.sql(f"WITH {text} SELECT * FROM lines", events=events)
    return exposition.pages(rows, ["events_click", "events_view"])


#: Both engines' text: endpoints and routes of a policy; requests are made of the events, child policies of the customers.
ROUTES = "(VALUES ('GET', '/', ''), ('GET', '/click', 'k1'), ('GET', '/click/1', 'k2,k1'), ('POST', '/view', ''), ('GET', '/v', 'k3')) AS r(method, prefix, refs)"
REQUESTS = """
SELECT event_id AS request, 'p' AS policy, concat('e', CAST(user_id % 12 AS STRING)) AS alias, concat('r', CAST(user_id % 12 AS STRING)) AS profile, CASE WHEN event_id % 13 = 0 THEN 'b2' ELSE 'b1' END AS build,
  CASE WHEN event_id % 5 = 0 THEN 'POST' ELSE 'GET' END AS method, concat('/', event_type, '/', CAST(user_id % 7 AS STRING), CASE WHEN event_id % 2 = 0 THEN '/x' ELSE '' END) AS path,
  CASE WHEN event_id % 3 = 1 THEN 'k1' WHEN event_id % 3 = 2 THEN 'k2' END AS reference FROM events"""
CHILDREN = """
SELECT c_custkey AS k, CASE WHEN c_custkey % 43 = 0 THEN 'nobody' ELSE concat('parent', CAST(c_nationkey % 2 AS STRING)) END AS parent, CASE WHEN c_custkey % 3 = 0 THEN 'literal-loopback-only' ELSE 'disabled' END AS local_mode,
  CASE WHEN c_custkey % 7 = 0 THEN 9000 ELSE 4000 END AS duration_ms, CASE WHEN c_custkey % 11 = 0 THEN 's9' ELSE 's1' END AS secret, CASE WHEN c_custkey % 13 = 0 THEN 'v9' ELSE 'v1' END AS evaluator_key, CASE WHEN c_custkey % 17 = 0 THEN '/tmp' ELSE '/data' END AS root,
  CASE WHEN c_custkey % 19 = 0 THEN 'e9' ELSE 'e1' END AS alias, CASE WHEN c_custkey % 23 = 0 THEN 'b2' ELSE 'b1' END AS build, CASE WHEN c_custkey % 5 = 0 THEN '/click/1/deep' WHEN c_custkey % 5 = 1 THEN '/clicker' ELSE '/click' END AS prefix,
  CASE WHEN c_custkey % 29 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN c_custkey % 31 < 10 THEN 'k1' WHEN c_custkey % 31 < 20 THEN 'k2' END AS reference FROM customer"""


def _routes(spark, aliases, policy: str):
    """The routes of a policy's endpoints."""
    rows = spark.sql(f"SELECT method, prefix, refs FROM {ROUTES}")
    references = F.when(F.col("refs") == "", F.array().cast("array<string>")).otherwise(F.split("refs", ","))
    return rows.select(F.lit(policy).alias("policy"), F.explode(F.array(*map(F.lit, aliases))).alias("alias"), "method", "prefix", references.alias("references"))


def authorized_requests(spark, sf_dir):
    """Which requests a policy with ten endpoints authorizes, and by which route."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    requests = spark.sql(REQUESTS.replace("FROM events", "FROM {events}"), events=events)
    aliases = [f"e{i}" for i in range(10)]
    ends = spark.createDataFrame([("p", a, "o", f"r{a[1:]}", "b1") for a in aliases], "policy string, alias string, origin string, profile string, build string")
    out = collector.authorize(requests, ends, _routes(spark, aliases, "p"))
    return out.select("request", "verdict", "prefix")


def policy_widenings(spark, sf_dir):
    """What the customers' policies allow beyond one of two parents."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    kids = spark.sql(CHILDREN.replace("FROM customer", "FROM {customer}"), customer=customer)
    name = F.concat(F.lit("c"), F.col("k").cast("string")).alias("policy")
    parents = spark.createDataFrame([(f"parent{i}", None, ["disabled", "literal-loopback-only"][i], 5000, ["s1", "s2"], ["v1"], ["/data"]) for i in range(2)], "policy string, parent string, local_mode string, duration_ms int, secrets array<string>, evaluator_keys array<string>, roots array<string>")
    policies = kids.select(name, "parent", "local_mode", "duration_ms", F.array("secret").alias("secrets"), F.array("evaluator_key").alias("evaluator_keys"), F.array("root").alias("roots")).unionByName(parents)
    ends = spark.createDataFrame([(f"parent{i}", "e1", "o", "r1", "b1") for i in range(2)], "policy string, alias string, origin string, profile string, build string")
    ends = ends.unionByName(kids.select(name, "alias", F.lit("o").alias("origin"), F.lit("r1").alias("profile"), "build"))
    routes = _routes(spark, ["e1"], "parent0").unionByName(_routes(spark, ["e1"], "parent1")).unionByName(kids.select(name, "alias", "method", "prefix", F.array_compact(F.array("reference")).alias("references")))
    return collector.widenings(policies, ends, routes).select("policy", "parent", F.array_join("widened", ",").alias("widened"))


def queries() -> dict:
    return {f.__name__: f for f in (exposition_pages, authorized_requests, policy_widenings)}


_WITHIN = "(r.prefix = '/' OR {path} = r.prefix OR starts_with({path}, r.prefix || '/'))"


def oracle_sql() -> dict[str, str]:
    varchar = lambda text: text.replace("STRING", "VARCHAR")
    return {
        "exposition_pages": rf"""WITH {varchar(LINES)},
told AS (
  SELECT *, CASE WHEN line = '' THEN 'blank' WHEN line[1] = '#' THEN 'comment' ELSE 'sample' END AS kind, regexp_extract(line, '^# (HELP|TYPE) ([a-z0-9_]+) (.+)$', ['w', 'm', 't']) AS c,
    regexp_extract(line, '^([a-z_]+)\{{(.*)\}} ([^ ]+) ?([0-9]*)$', ['m', 'l', 'v', 't']) AS s FROM lines),
judged AS (
  SELECT *, CASE WHEN line = '# EOF' OR starts_with(line, '# UNIT ') OR (starts_with(line, '# HELP') OR starts_with(line, '# TYPE')) AND c.m = '' THEN 'unsupported-syntax' WHEN kind = 'sample' AND regexp_matches(s.l, 'n=.*n=') THEN 'duplicate-sample'
    WHEN kind = 'sample' AND s.v = 'NaN' THEN 'nonfinite-value' WHEN kind = 'sample' AND TRY_CAST(s.v AS DOUBLE) IS NULL THEN 'unsupported-syntax' END AS own FROM told),
twice AS (
  SELECT page, number, kind, own, row_number() OVER (PARTITION BY page, kind, CASE kind WHEN 'sample' THEN s.m || s.l WHEN 'comment' THEN CASE WHEN c.w <> '' THEN c.w || ' ' || c.m ELSE CAST(number AS VARCHAR) END ELSE CAST(number AS VARCHAR) END, own IS NULL ORDER BY number) AS nth FROM judged),
bad AS (SELECT page, number, coalesce(own, CASE WHEN kind = 'sample' THEN 'duplicate-sample' ELSE 'unsupported-syntax' END) AS code FROM twice WHERE own IS NOT NULL OR nth > 1),
first AS (SELECT page, min(number) AS refused_at, arg_min(code, number) AS code FROM bad GROUP BY page)
SELECT page, count(*) AS lines, count(*) FILTER (kind = 'comment') AS comments, count(*) FILTER (kind = 'sample') AS samples, count(*) FILTER (kind = 'sample' AND (starts_with(line, 'events_click{{') OR starts_with(line, 'events_view{{'))) AS selected, refused_at, code
FROM judged LEFT JOIN first USING (page) GROUP BY page, refused_at, code""".replace("{{", "{").replace("}}", "}"),
        "authorized_requests": f"""WITH q AS ({varchar(REQUESTS)}),
best AS (SELECT request, arg_max(prefix, length(prefix)) AS prefix, arg_max(refs, length(prefix)) AS refs FROM q JOIN {ROUTES} ON q.method = r.method AND {_WITHIN.format(path="path")} GROUP BY request),
said AS (
  SELECT q.request, best.prefix, CASE WHEN CAST(substring(alias, 2) AS INT) >= 10 THEN 'unknown-endpoint' WHEN build <> 'b1' THEN 'runtime-mismatch' WHEN best.prefix IS NULL THEN 'no-route'
    WHEN CASE WHEN refs = '' THEN reference IS NOT NULL ELSE NOT coalesce(list_contains(string_split(refs, ','), reference), FALSE) END THEN 'authentication' ELSE 'authorized' END AS verdict FROM q LEFT JOIN best USING (request))
SELECT request, verdict, CASE WHEN verdict = 'authorized' THEN prefix END AS prefix FROM said""",
        "policy_widenings": f"""WITH c AS ({varchar(CHILDREN)}),
best AS (SELECT k, arg_max(refs, length(r.prefix)) AS refs FROM c JOIN {ROUTES} ON c.method = r.method AND c.alias = 'e1' AND parent <> 'nobody' AND {_WITHIN.format(path="c.prefix")} GROUP BY k)
SELECT 'c' || k AS policy, parent, CASE WHEN parent = 'nobody' THEN 'unknown-parent' ELSE concat_ws(',', CASE WHEN parent = 'parent0' AND local_mode <> 'disabled' THEN 'local-mode' END, CASE WHEN duration_ms > 5000 THEN 'duration' END,
  CASE WHEN secret NOT IN ('s1', 's2') THEN 'secrets' END, CASE WHEN evaluator_key <> 'v1' THEN 'evaluator-keys' END, CASE WHEN root <> '/data' THEN 'store-roots' END, CASE WHEN alias <> 'e1' OR build <> 'b1' THEN 'endpoint-identity' END,
  CASE WHEN refs IS NULL OR CASE WHEN refs = '' THEN reference IS NOT NULL ELSE reference IS NULL OR NOT list_contains(string_split(refs, ','), reference) END THEN 'route-authority' END) END AS widened
FROM c LEFT JOIN best USING (k)""",
    }
