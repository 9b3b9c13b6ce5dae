"""Window manifests: membership digests, revisions sealed one after the other, and what is wrong with stored chains of them.

A manifest is one row: BODY and self_digest, the domain digest of the canonical JSON of BODY.  ``rule`` is a struct (algorithm,
sample, seed); ``membership`` the digest of window, protocol and rule that traces must name; ``capacity`` a struct (kind, requests,
policy, starts, ends), whose kind is reported or unavailable; ``traces`` and ``evaluators`` digests of the evidence up to the
watermark.  Times are whole numbers.  Revision 1 has no predecessor; a later one names the digest of the one before.

``arrivals`` digests each member once: what came up to a seal is the digest of the lists of what came at each, so that its cost does
not grow with the number of revisions, and a seal at which nothing came has its predecessor's digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import canonical_rows
from .semantics import listed

VERSION = "window-manifest/1"
DOMAIN = "evenkeel/window-manifest/1"
MEMBERSHIP_DOMAIN = "evenkeel/window-membership/1"
CHANGES = 1_024  # proposed changes of one window that are folded in a row; later ones are refused
RULE = T.StructType().add("algorithm", "string").add("sample", "long").add("seed", "string")
CAPACITY = T.StructType().add("kind", "string").add("requests", "long").add("policy", "string").add("starts", "long").add("ends", "long")
_FIELDS = [
    ("version", "string"),
    ("window_id", "string"),
    ("protocol", "string"),
    ("policy", "string"),
    ("starts", "long"),
    ("ends", "long"),
    ("watermark", "long"),
    ("closure", "string"),
    ("rule", RULE),
    ("membership", "string"),
    ("revision", "long"),
    ("predecessor", "string"),
    ("traces", "string"),
    ("evaluators", "string"),
    ("capacity", CAPACITY),
]
BODY = [name for name, _ in _FIELDS]
BODY_TYPE = T.StructType()
for _name, _kind in _FIELDS:
    BODY_TYPE.add(_name, _kind)
MANIFEST = [*BODY, "self_digest"]
CHANGED = ["watermark", "closure", "traces", "evaluators", "capacity"]  # what a revision may change, besides its number and predecessor
FROZEN = ["version", "window_id", "protocol", "policy", "starts", "ends", "rule", "membership"]


def membership_digest(window: Column, protocol: Column, rule: Column) -> Column:
    """The identity that traces of this window, protocol and sampling rule declare."""
    kind = T.StructType().add("window_id", "string").add("protocol", "string").add("rule", RULE)
    return canonical_rows.digest(MEMBERSHIP_DOMAIN, F.struct(window.alias("window_id"), protocol.alias("protocol"), rule.alias("rule")), kind)


def self_digest(body: Column | None = None) -> Column:
    """The digest of a manifest's body (by default of the row's)."""
    return canonical_rows.digest(DOMAIN, F.struct(*BODY) if body is None else body, BODY_TYPE)


def first(windows: DataFrame) -> DataFrame:
    """Revision 1 of each window, from window_id, protocol, policy, starts, ends, rule and CHANGED."""
    out = windows.withColumns({"version": F.lit(VERSION), "revision": F.lit(1).cast("bigint"), "predecessor": F.lit(None).cast("string"), "membership": membership_digest(F.col("window_id"), F.col("protocol"), F.col("rule"))})
    return out.withColumn("self_digest", self_digest()).select(*MANIFEST)


def arrivals(members: DataFrame, seals: DataFrame) -> DataFrame:
    """The seals (window_id, place) with ``traces`` and ``evaluators``: digests of the members (window_id, place, kind, member) up to each.

    ``kind`` is trace or evaluator.  A member counts from its own place on; repeated members are counted, and their order is nothing.
    """
    came = canonical_rows.tree_digest(members, ["window_id", "place", "kind"], "member")
    came = came.groupBy("window_id", "place").agg(*[F.max(F.when(F.col("kind") == kind, F.col("digest"))).alias(kind) for kind in ("trace", "evaluator")])
    rows = seals.select("window_id", "place").distinct().withColumn("seal", F.lit(True)).join(came, ["window_id", "place"], "full")
    upto = Window.partitionBy("window_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # a row a seal
    total = lambda c: F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.collect_list(c).over(upto), ","), 256))
    return rows.withColumns({"traces": total("trace"), "evaluators": total("evaluator")}).where("seal").select("window_id", "place", "traces", "evaluators")


def _refusal(now: Column, change: Column) -> Column:
    """Why a change is no revision of the manifest ``now``; null if it is one."""
    same = lambda c: now[c].eqNullSafe(change[c])
    capacity = change["capacity"]
    reported = capacity["kind"] == "reported"
    return (
        F.when(F.coalesce(change["watermark"] < now["watermark"], F.lit(True)), "watermark-fell")
        .when(same("traces") & same("evaluators") & same("capacity"), "nothing-changed")
        .when(reported & ~capacity["policy"].eqNullSafe(now["policy"]), "capacity-policy")
        .when(reported & (~capacity["starts"].eqNullSafe(now["starts"]) | ~capacity["ends"].eqNullSafe(now["ends"])), "capacity-bounds")
    )


def revise(manifests: DataFrame, changes: DataFrame) -> DataFrame:
    """Every proposed change (window_id, place, CHANGED) with ``refusal`` and, where it was sealed, its manifest.

    ``manifests`` are one a window, with self_digest.  Changes are taken by place; one that is refused leaves the chain where it is, so the next
    is held against the last that was sealed.  Changes of unknown windows are refused, and those beyond CHANGES of a window.
    A place that a window has twice must not stand in ``changes``.
    """
    kind = T.StructType([*BODY_TYPE.fields, T.StructField("self_digest", T.StringType())]).simpleString()
    done = f"struct<place:bigint,refusal:string,manifest:{kind}>"
    numbered = changes.withColumn("nth", F.row_number().over(Window.partitionBy("window_id").orderBy("place")))
    taken = numbered.where(F.col("nth") <= CHANGES).groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("bigint").alias("place"), *CHANGED))).alias("changes"))

    def next_body(now, change):
        own = {c: change[c] for c in CHANGED} | {"revision": now["revision"] + 1, "predecessor": now["self_digest"]}
        return F.struct(*[own.get(c, now[c]).alias(c) for c in BODY])

    def step(acc, change):
        def sealed(body):
            return F.struct(*[body[c].alias(c) for c in BODY], self_digest(body).alias("self_digest"))

        def added(x):
            taken = F.when(x["refusal"].isNull(), x["manifest"])
            entry = F.struct(change["place"].alias("place"), x["refusal"].alias("refusal"), taken.alias("manifest"))
            return F.struct(F.coalesce(taken, acc["now"]).alias("now"), F.concat(acc["done"], F.array(entry)).alias("done"))

        refusal = _refusal(acc["now"], change)
        manifest = F.when(refusal.isNull(), canonical_rows.once(next_body(acc["now"], change), sealed))
        return canonical_rows.once(F.struct(refusal.alias("refusal"), manifest.alias("manifest")), added)

    start = F.struct(F.struct(*MANIFEST).cast(kind).alias("now"), F.array().cast(f"array<{done}>").alias("done"))
    folded = manifests.join(taken, "window_id").select("window_id", F.explode(F.aggregate("changes", start, step, lambda acc: acc["done"])).alias("x"))
    folded = folded.select("window_id", "x.place", "x.refusal", *[F.col(f"x.manifest.{c}").alias(c) for c in MANIFEST if c != "window_id"])
    rest = numbered.join(manifests.select("window_id", F.lit(True).alias("known")), "window_id", "left").where(F.col("known").isNull() | (F.col("nth") > CHANGES))
    rest = rest.select("window_id", "place", F.when(F.col("known").isNull(), "unknown-window").otherwise("too-many-changes").alias("refusal"))
    return folded.unionByName(rest, allowMissingColumns=True)


def manifest_faults(manifests: DataFrame, protocols: DataFrame | None = None) -> DataFrame:
    """The manifests with ``faults``: codes of the rules that each breaks, by itself, against its predecessor and against its protocol.

    A revision's predecessor is looked up by its digest in the same window: none (predecessor-unknown), or one that the revision does not
    follow (revision-gap, watermark-fell, nothing-changed, frozen-changed).  Two revisions of one predecessor are a fork, two
    of one number a repeated revision.  ``protocols`` (protocol, rule) gives the sampling rule that a manifest must have.
    """
    c = F.col
    before = manifests.select("window_id", c("self_digest").alias("predecessor"), F.struct("revision", *FROZEN, *CHANGED).alias("before"))
    before = before.groupBy("window_id", "predecessor").agg(F.min("before").alias("before"))  # a repeated row is one predecessor
    rows = manifests.join(before, ["window_id", "predecessor"], "left")
    if protocols is not None:
        rows = rows.join(protocols.select("protocol", c("rule").alias("protocol_rule"), F.lit(True).alias("known")), "protocol", "left")
    else:
        rows = rows.withColumns({"protocol_rule": c("rule"), "known": F.lit(True)})
    children = F.count("*").over(Window.partitionBy("window_id", "predecessor"))  # few rows: a window's revisions
    twins = F.count("*").over(Window.partitionBy("window_id", "revision"))
    rows = rows.withColumns({"children": children, "twins": twins})
    same = lambda x: c(x).eqNullSafe(c(f"before.{x}"))
    reported = c("capacity.kind") == "reported"
    linked = c("before").isNotNull()
    frozen = ~same(FROZEN[0])
    for name in FROZEN[1:]:
        frozen = frozen | ~same(name)
    rules = [
        ("interval-empty", c("starts") >= c("ends")),
        ("ends-after-watermark", c("ends") > c("watermark")),
        ("first-with-predecessor", (c("revision") == 1) & c("predecessor").isNotNull()),
        ("predecessor-missing", (c("revision") > 1) & c("predecessor").isNull()),
        ("membership", ~c("membership").eqNullSafe(membership_digest(c("window_id"), c("protocol"), c("rule")))),
        ("capacity-policy", reported & ~c("capacity.policy").eqNullSafe(c("policy"))),
        ("capacity-bounds", reported & (~c("capacity.starts").eqNullSafe(c("starts")) | ~c("capacity.ends").eqNullSafe(c("ends")))),
        ("self-digest", ~c("self_digest").eqNullSafe(self_digest())),
        ("protocol-unknown", c("known").isNull()),
        ("protocol-rule", c("known") & ~c("rule").eqNullSafe(c("protocol_rule"))),
        ("predecessor-unknown", c("predecessor").isNotNull() & ~linked),
        ("revision-gap", linked & (c("revision") != c("before.revision") + 1)),
        ("watermark-fell", linked & (c("watermark") < c("before.watermark"))),
        ("nothing-changed", linked & same("traces") & same("evaluators") & same("capacity")),
        ("frozen-changed", linked & frozen),
        ("fork", c("predecessor").isNotNull() & (c("children") > 1)),
        ("revision-repeated", c("twins") > 1),
    ]
    return rows.withColumn("faults", listed(rules)).select(*manifests.columns, "faults")
