"""Collector policies: which requests they authorize, and whether a policy only narrows its parent.

A request's path is expanded to its prefixes, as many as it has segments, and each is looked up by (policy, endpoint, method,
prefix): an equi-join in place of a comparison with every route.  The longest prefix that is found is the route.

Tables: policies (policy, parent, local_mode, duration_ms, secrets, evaluator_keys, roots), endpoints (policy, alias, origin,
profile, build), routes (policy, alias, method, prefix, references), one row each; requests (request, policy, alias, profile, build, method, path,
reference).  Null lists are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .semantics import listed

KEY = ["policy", "alias", "method"]


def prefixes(path: Column) -> Column:
    """``/`` and every prefix of whole segments: of /a/b these are /, /a and /a/b."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    longer = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.concat(F.array(F.lit("/")), F.when(F.size(parts) > 0, longer).otherwise(F.array().cast("array<string>")))


def longest_route(rows: DataFrame, routes: DataFrame, path: str) -> DataFrame:
    """The rows with ``route``, the most specific route (prefix, references) of their policy, alias and method; null if there is none."""
    rows = rows.withColumn("own_row", F.struct(*rows.columns))
    known = routes.select(*KEY, F.col("prefix").alias("own_prefix"), F.struct("prefix", F.coalesce("references", F.array().cast("array<string>")).alias("references")).alias("found"))
    each = rows.select("own_row", *[F.col(c) for c in KEY], F.explode(prefixes(F.col(path))).alias("own_prefix"))
    best = each.join(known, [*KEY, "own_prefix"], "left").groupBy("own_row").agg(F.max_by("found", F.when(F.col("found").isNotNull(), F.length("own_prefix"))).alias("route"))
    return best.select("own_row.*", "route")


def authorize(requests: DataFrame, endpoints: DataFrame, routes: DataFrame) -> DataFrame:
    """The requests with ``verdict``: unknown-endpoint, runtime-mismatch, no-route, authentication or authorized; and ``prefix``."""
    known = endpoints.select("policy", "alias", F.struct("profile", "build").alias("runtime"))
    rows = longest_route(requests, routes, "path").join(known, ["policy", "alias"], "left")
    listed_ = F.col("route.references")
    right = F.when(F.size(listed_) == 0, F.col("reference").isNull()).otherwise(F.coalesce(F.array_contains(listed_, F.col("reference")), F.lit(False)))
    verdict = (
        F.when(F.col("runtime").isNull(), "unknown-endpoint")
        .when(~F.col("profile").eqNullSafe(F.col("runtime.profile")) | ~F.col("build").eqNullSafe(F.col("runtime.build")), "runtime-mismatch")
        .when(F.col("route").isNull(), "no-route")
        .when(~right, "authentication")
        .otherwise("authorized")
    )
    return rows.select(*requests.columns, verdict.alias("verdict"), F.when(verdict == "authorized", F.col("route.prefix")).alias("prefix"))


def widenings(policies: DataFrame, endpoints: DataFrame, routes: DataFrame) -> DataFrame:
    """(policy, parent, widened): what each policy with a parent allows beyond it; an empty list if it only narrows.

    Codes: unknown-parent, local-mode, duration, secrets, evaluator-keys, store-roots, endpoint-identity, route-authority.
    """
    lists = ["secrets", "evaluator_keys", "roots"]
    above = policies.select(F.col("policy").alias("parent"), F.struct("local_mode", "duration_ms", *lists).alias("above"))
    own = policies.where("parent IS NOT NULL").select("policy", "parent")
    # endpoints and routes under the parent's name, to be looked up there
    ends = endpoints.join(own, "policy")
    there = endpoints.select(F.col("policy").alias("parent"), "alias", F.struct("origin", "profile", "build").alias("there"))
    ends = ends.join(there, ["parent", "alias"], "left").groupBy("policy").agg(F.max(~F.col("there").eqNullSafe(F.struct("origin", "profile", "build"))).alias("other_endpoint"))
    asked = routes.join(own, "policy").select(F.col("policy").alias("child"), F.col("parent").alias("policy"), "alias", "method", "prefix", "references")
    got = longest_route(asked, routes, "prefix")
    mine, theirs = F.coalesce("references", F.array().cast("array<string>")), F.col("route.references")
    narrows = F.when(F.col("route").isNull(), F.lit(False)).when(F.size(theirs) == 0, F.size(mine) == 0).otherwise((F.size(mine) > 0) & (F.size(F.array_except(mine, theirs)) == 0))
    wide = got.groupBy(F.col("child").alias("policy")).agg(F.max(~narrows).alias("wide_route"))
    rows = policies.where("parent IS NOT NULL").join(above, "parent", "left").join(ends, "policy", "left").join(wide, "policy", "left")
    beyond = lambda c: F.size(F.array_except(F.coalesce(F.col(c), F.array().cast("array<string>")), F.coalesce(F.col(f"above.{c}"), F.array().cast("array<string>")))) > 0
    has = F.col("above").isNotNull()
    codes = listed(
        [
            ("unknown-parent", ~has),
            ("local-mode", has & (F.col("above.local_mode") == "disabled") & (F.col("local_mode") != "disabled")),
            ("duration", has & (F.col("duration_ms") > F.col("above.duration_ms"))),
            *[(code, has & beyond(c)) for code, c in zip(["secrets", "evaluator-keys", "store-roots"], lists)],
            ("endpoint-identity", has & F.coalesce("other_endpoint", F.lit(False))),
            ("route-authority", has & F.coalesce("wide_route", F.lit(False))),
        ]
    )
    return rows.select("policy", "parent", codes.alias("widened"))
