"""Strict, bounded JSON: one document on the driver, or newline-delimited rows as a DataFrame with an error per row.

Errors carry a code and a line, never a piece of the input.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 1 << 20
    max_depth: int = 64
    max_keys: int = 100_000
    max_items: int = 100_000
    max_string: int = 1 << 18
    max_number: int = 64


class InputError(ValueError):
    def __init__(self, code: str, line: int | None = None):
        super().__init__(code if line is None else f"{code} at line {line}")
        self.code, self.line = code, line


def parse(raw: bytes, limits: Limits = Limits()):
    """The document in ``raw``; duplicate keys, bad UTF-8, byte-order marks, NaN and lone surrogates are errors."""
    if len(raw) > limits.max_bytes:
        raise InputError("too-many-bytes")
    if raw.startswith(b"\xef\xbb\xbf"):
        raise InputError("byte-order-mark")
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        raise InputError("invalid-utf-8") from None
    if not text.strip(" \t\r\n"):
        raise InputError("empty-input")
    keys = 0

    def unique(pairs):
        nonlocal keys
        keys += len(pairs)
        if keys > limits.max_keys:
            raise InputError("too-many-keys")
        if len({k for k, _ in pairs}) != len(pairs):
            raise InputError("duplicate-key")
        return dict(pairs)

    def bounded(kind):
        def make(token):
            if len(token) > limits.max_number:
                raise InputError("number-too-long")
            return kind(token)

        return make

    def constant(_):
        raise InputError("number-not-finite")

    depth = most = 0
    quoted = escaped = False
    for c in text:  # depth is bounded before the recursive parser sees it
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    if most > limits.max_depth:
        raise InputError("too-deep")
    try:
        value = json.loads(text, object_pairs_hook=unique, parse_int=bounded(int), parse_float=bounded(float), parse_constant=constant)
    except json.JSONDecodeError:
        raise InputError("invalid-json") from None
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, float) and x in (float("inf"), float("-inf")):
            raise InputError("number-not-finite")
        if isinstance(x, str):
            if len(x.encode("utf-16-le", "surrogatepass")) > 2 * limits.max_string:
                raise InputError("string-too-long")
            if any(0xD800 <= ord(c) < 0xE000 for c in x):
                raise InputError("lone-surrogate")
        elif isinstance(x, list):
            if len(x) > limits.max_items:
                raise InputError("too-many-items")
            todo += x
        elif isinstance(x, dict):
            todo += [*x.keys(), *x.values()]
    return value


BLOCKS = 1_000_000  # file blocks whose places may go to every task (32 bytes each)


def numbered(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` of a text source with their number within their file, from 1, as ``line``; no row is shuffled.

    A block's rows stand together and in order in one partition, so a row's place is its distance from the block's first
    row, plus the rows of the blocks before it in the file.  Only one row per block is gathered by file.
    """
    at = lines.select("*", F.xxhash64(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_id", F.monotonically_increasing_id())
    blocks = at.groupBy("_file", "_block").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    places = blocks.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_shift"))
    side = F.broadcast(places) if places.limit(BLOCKS + 1).count() <= BLOCKS else places
    out = at.join(side, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return out.withColumn(line, F.col("_id") + F.col("_shift") + 1).drop("_file", "_block", "_id", "_f", "_b", "_shift")


#: How a variant names the JSON values that a column of a type may hold; a whole number has no fraction and no exponent.
KINDS = {T.StringType: "STRING", T.BooleanType: "BOOLEAN", T.LongType: "BIGINT", T.IntegerType: "BIGINT", T.DoubleType: "BIGINT|DOUBLE|DECIMAL"}


def shape_error(value: Column, kind: T.DataType) -> Column:
    """Why a variant has not exactly the shape of a type, at any depth: wrong-type, unknown-field or missing-field; null if it has."""
    name = F.schema_of_variant(value)
    if isinstance(kind, T.StructType):
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        unknown = F.size(F.array_except(keys, F.array(*[F.lit(f.name) for f in kind.fields]))) > 0
        code = F.when(~name.startswith("OBJECT"), "wrong-type").when(unknown, "unknown-field")
        inner = []
        for f in kind.fields:
            own = F.try_variant_get(value, f"$['{f.name}']", "variant")
            none = own.isNull() | F.is_variant_null(own)
            inner.append(F.when(none, F.lit(None if f.nullable else "missing-field").cast("string")).otherwise(shape_error(own, f.dataType)))
        return F.coalesce(code, *inner)
    if isinstance(kind, T.ArrayType):
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.when(F.is_variant_null(x), F.lit(None if kind.containsNull else "missing-field").cast("string")).otherwise(shape_error(x, kind.elementType)))
        return F.coalesce(F.when(~name.startswith("ARRAY"), F.lit("wrong-type")), F.try_element_at(F.array_compact(each), F.lit(1)))
    return F.when(~name.rlike(f"^(?:{KINDS[type(kind)]})\\b"), F.lit("wrong-type"))


def ndjson(spark, path: str, schema: T.StructType, max_line: int = 8 << 20, max_rows: int | None = None) -> DataFrame:
    """(file, line, value, error_code) of each line; ``line`` counts from 1 in its file.

    A blank line, a repeated or unknown field at any depth, a missing one or a wrong type is an error, not a null.  One line feed
    at the end is no line of its own; a CR before a line feed is dropped, others are data.  Lines of a file beyond
    ``max_rows`` are too-many-items.
    """
    lines = numbered(spark.read.option("lineSep", "\n").text(path).select("value", "_metadata"), "line")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), "line", F.regexp_replace("value", r"\r$", "").alias("body"))
    names, tree = F.json_object_keys("body"), F.try_parse_json("body")
    code = (
        F.when(F.lit(False) if max_rows is None else F.col("line") > max_rows, "too-many-items")
        .when(F.octet_length("body") > max_line, "line-too-long")
        .when(F.trim("body") == "", "blank-line")
        .when(names.isNull(), "invalid-json")
        .when(F.size(names) != F.size(F.array_distinct(names)), "duplicate-key")
        .when(tree.isNull(), "invalid-json")  # broken below the top, or a name that stands twice there
        .otherwise(shape_error(tree, schema))
    )
    value = F.from_json("body", schema, {"mode": "PERMISSIVE"})
    return lines.select("file", "line", F.when(code.isNull(), value).alias("value"), code.alias("error_code"))
