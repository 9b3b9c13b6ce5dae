"""Canonical JSON (RFC 8785) of rows as Spark expressions, domain digests of them, and digests of sets of any size.

The text of a column is that of ``canonical.encode`` for the same value: keys in UTF-16 order, strings escaped as ECMAScript
does, numbers with the shortest digits.  A value that has no canonical form (a number that is not finite, a whole number
beyond 2^53 - 1) makes the whole text null.  Nulls stand as ``null``.  Types: strings, whole numbers, doubles, booleans, arrays, structs,
maps with string keys; others raise TypeError when the plan is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .canonical import SAFE, encode

#: Class and method in Spark's JSON library that writes a number with the shortest digits (Java 17's own has one too many at times).
SHORTEST = ("com.fasterxml.jackson.core.io.schubfach.DoubleToDecimal", "toString")
# Control characters that JSON writes with a letter.
LETTERS = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), *((chr(i), f"\\{LETTERS[i]}" if i in LETTERS else f"\\u{i:04x}") for i in range(32))]


def once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _string(c: Column) -> Column:
    escaped = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), _ESCAPES, c)
    return F.concat(F.lit('"'), F.when(c.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(c), F.lit('"'))


def _double(c: Column) -> Column:
    """A number as ECMAScript writes it.

    The digits are those of Spark's JSON library, which are the shortest but for one that it writes as two.
    """
    size = F.abs(c)

    def parts(text: Column) -> Column:
        mantissa = F.substring_index(text, "E", 1)
        whole, fraction = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
        power = F.when(text.contains("E"), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
        return once(F.concat(whole, fraction), lambda d: F.struct(F.regexp_replace(d, "^0+", "").alias("d"), (F.length(whole) + power - F.length(d) + F.length(F.regexp_replace(d, "^0+", ""))).alias("point")))

    def shorter(p: Column, digits: Column) -> Column:
        """The parts with ``digits`` digits, if they give the same number."""
        kept = F.substr(p["d"], F.lit(1), digits).cast("decimal(20,0)") + F.when(F.substr(p["d"], digits + 1, F.lit(1)) >= "5", 1).otherwise(0)
        rounded = kept.cast("decimal(20,0)").cast("string")
        q = F.struct(rounded.alias("d"), (p["point"] + F.length(rounded) - digits).alias("point"))
        same = F.concat(F.lit("0."), rounded, F.lit("E"), q["point"].cast("string")).cast("double") == size
        return F.when((F.length(p["d"]) > digits) & same, q)

    def strip(p: Column) -> Column:
        return F.struct(F.regexp_replace(p["d"], "0+$", "").alias("d"), p["point"].alias("point"))

    def write(p: Column) -> Column:
        d, point, n = p["d"], p["point"], F.length(p["d"])
        rest = F.substr(d, F.lit(2), F.greatest(n, F.lit(1)))
        return (
            F.when((point > 0) & (point <= 21) & (n <= point), F.concat(d, F.repeat(F.lit("0"), point - n)))
            .when((point > 0) & (point <= 21), F.concat(F.substr(d, F.lit(1), point), F.lit("."), F.substr(d, point + 1, n)))
            .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d))
            .otherwise(F.concat(F.substr(d, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(point > 1, "+").otherwise("-"), F.abs(point - 1).cast("string")))
        )

    short = lambda p: F.when(F.length(p["d"]) == 2, F.coalesce(shorter(p, F.lit(1)), p)).otherwise(p)
    text = once(parts(F.reflect(F.lit(SHORTEST[0]), F.lit(SHORTEST[1]), size)), lambda p: once(strip(p), lambda q: once(short(q), lambda r: once(strip(r), write))))
    finite = ~F.isnan(c) & (size < float("inf"))
    return F.when(c == 0, "0").when(finite, F.concat(F.when(c < 0, "-").otherwise(""), text))


def text(c: Column, kind: T.DataType) -> Column:
    """The canonical text of a column of this type."""
    if isinstance(kind, T.StringType):
        own = _string(c)
    elif isinstance(kind, T.BooleanType):
        own = c.cast("string")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        own = F.when(c.cast("bigint").between(-SAFE, SAFE), c.cast("string"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        own = _double(c.cast("double"))
    elif isinstance(kind, T.ArrayType):
        own = once(F.transform(c, lambda x: text(x, kind.elementType)), lambda items: F.when(~F.exists(items, lambda x: x.isNull()), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))))
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        said = [F.concat(F.lit(("," if i else "") + encode(f.name) + ":"), text(c[f.name], f.dataType)) for i, f in enumerate(fields)]
        own = F.concat(F.lit("{"), *said, F.lit("}"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(F.hex(F.encode(e["key"], "UTF-16BE")).alias("order"), F.concat(_string(e["key"]), F.lit(":"), text(e["value"], kind.valueType)).alias("said"))))
        own = once(F.transform(entries, lambda e: e["said"]), lambda items: F.when(~F.exists(items, lambda x: x.isNull()), F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(kind.simpleString())
    return F.when(c.isNull(), "null").otherwise(own)


def _writes_alike(kind: T.DataType) -> bool:
    """Whether Spark's JSON writer gives the canonical text of all values of this type but odd ones."""
    if isinstance(kind, T.StructType):
        return len(kind) > 0 and all(_writes_alike(f.dataType) for f in kind)
    return _writes_alike(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _ordered(c: Column, kind: T.DataType) -> Column:
    """The column with all names in UTF-16 order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        return F.when(c.isNotNull(), F.struct(*[_ordered(c[f.name], f.dataType).alias(f.name) for f in fields]))
    return F.transform(c, lambda x: _ordered(x, kind.elementType)) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)) else c


def _has_long(kind: T.DataType) -> bool:
    return isinstance(kind, T.LongType) or isinstance(kind, T.StructType) and any(_has_long(f.dataType) for f in kind) or isinstance(kind, T.ArrayType) and _has_long(kind.elementType)


def _safe(c: Column, kind: T.DataType) -> list[Column]:
    """Conditions under which all whole numbers have a canonical form."""
    if isinstance(kind, T.LongType):
        return [F.coalesce(c.between(-SAFE, SAFE), F.lit(True))]
    if isinstance(kind, T.StructType):
        return [x for f in kind for x in _safe(c[f.name], f.dataType)]
    if isinstance(kind, T.ArrayType) and _has_long(kind.elementType):
        return [F.coalesce(F.forall(c, lambda x: reduce(lambda a, b: a & b, _safe(x, kind.elementType))), F.lit(True))]
    return []


def _written(c: Column, kind: T.DataType) -> Column:
    """``text``, by Spark's JSON writer at once where that gives the same: all but control characters without a letter of their own and whole numbers beyond 2^53 - 1."""
    if not (isinstance(kind, T.StructType) and _writes_alike(kind)):
        return text(c, kind)
    same = lambda json: reduce(lambda a, b: a & b, [c.isNotNull(), ~F.contains(json, F.lit("\\u")), *_safe(c, kind)])
    return once(F.to_json(_ordered(c, kind), {"ignoreNullFields": "false"}), lambda json: F.when(same(json), json).otherwise(text(c, kind)))


def digest(domain: str, c: Column, kind: T.DataType) -> Column:
    """``sha256:`` and the hex digest of the canonical text of {domain, value}."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit('{"domain":' + encode(domain) + ',"value":'), _written(c, kind), F.lit("}")), 256))


def row_digest(rows: DataFrame, domain: str, columns: list[str] | None = None, name: str = "digest") -> DataFrame:
    """The rows with the domain digest of the struct of ``columns`` (all by default)."""
    columns = columns or rows.columns
    kind = T.StructType([rows.schema[c] for c in columns])
    return rows.withColumn(name, digest(domain, F.struct(*columns), kind))


def tree_digest(rows: DataFrame, keys: list[str], member: str, levels: int = 4, width: int = 2) -> DataFrame:
    """(keys, digest, members): a digest of each key's set of members, repeated ones counted, in any order and of any size.

    The members' digests are hashed in groups by ``levels`` prefixes of ``width`` hex digits, the longest first, so a row gathers a
    key's share of one prefix (1 in 65,536 at first), and at most 256 digests further up.  Members are shuffled once, as bytes, by
    the second prefix from the top, which holds all longer ones.
    """
    near = F.hex(F.substring("h", 1, (width * min(2, levels) + 1) // 2))
    leaf = rows.select(*keys, F.unhex(F.sha2(F.coalesce(F.col(member).cast("string"), F.lit("null")), 256)).alias("h"))
    leaf = leaf.withColumn("near", F.lower(F.substring(near, 1, width * min(2, levels)))).repartition("near")
    level = leaf.groupBy(*keys, "near", "h").agg(F.count("*").alias("n")).select(*keys, "near", F.lower(F.hex("h")).alias("h"), "n")
    level = level.select(*keys, "near", F.substring("h", 1, width * levels).alias("p"), F.concat_ws(":", "h", F.col("n").cast("string")).alias("x"), "n")
    for depth in range(levels, -1, -1):
        by = [*keys, "near"] if depth >= min(2, levels) else keys  # below, a row a prefix is left
        done = level.groupBy(*by, "p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), ","), 256).alias("d"), F.sum("n").alias("n"))
        if depth == 0:
            return done.select(*keys, F.col("d").alias("digest"), F.col("n").alias("members"))
        level = done.select(*by, F.substring("p", 1, width * (depth - 1)).alias("p"), F.concat_ws(":", "p", "d").alias("x"), "n")
