"""Whole pages of Prometheus text: what makes a reader refuse a page, and the samples of those that it takes.

A page is its numbered lines, which may lie in any number of splits.  What a line is, and whether it is well formed, is an
expression over it; what must not stand twice on a page (a metric's HELP, its TYPE, a sample) is looked at among the lines that say
the same, so nothing is carried from line to line.  Every line is read once and shuffled once.  Codes: utf8-bom, unsupported-syntax, duplicate-sample, nonfinite-value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The format's names, types and numbers.
TYPES = ["counter", "gauge", "histogram", "summary", "untyped"]
_METRIC, _LABEL = "[a-zA-Z_:][a-zA-Z0-9_:]*", "[a-zA-Z_][a-zA-Z0-9_]*"
_VALUE = r'"([^"\\\x00]*(?:\\[\\"n][^"\\\x00]*)*)"'
_PAIR = rf"({_LABEL})[ \t]*=[ \t]*{_VALUE}"
_PLAIN = _PAIR.replace("(" + _LABEL + ")", _LABEL).replace('"(', '"').replace(')"', '"')
_SAMPLE = rf"^({_METRIC})(\{{[ \t]*(?:{_PLAIN}(?:[ \t]*,[ \t]*{_PLAIN})*[ \t]*)?\}})?[ \t]+([^ \t]+)(?:[ \t]+([+-]?[0-9]{{1,31}})|[ \t]*)$"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_ODD = "(?i)^([+-]?inf(inity)?|[+-]?nan)$"


#: A sample's parts in one match, with NULs between them; only the last, the value, may hold one itself.  A line ends where ``$`` says so.
_WHOLE = _SAMPLE[:-1] + "(?:\\r\\n|[\\n\\r\\x85\\u2028\\u2029])?\\z"
_PARTS = "$1\0$2\0$4\0$3"
#: Codes in the order in which they are told of lines of one number.
CODES = ["duplicate-sample", "nonfinite-value", "unsupported-syntax", "utf8-bom"]
_LEAST = -(2**63)


def _part(parts: Column, i: int) -> Column:
    """A part of the sample by its group, empty where the line is none."""
    return F.when(F.size(parts) == 4, F.get(parts, F.lit([0, 1, 3, 2][i - 1]))).otherwise("")


def read_lines(lines: DataFrame, page: str = "page", number: str = "number", line: str = "line") -> DataFrame:
    """(page, number, kind, metric, labels, value, timestamp_ms, code): every line, the code if it is at fault by itself.

    ``kind``: blank, help, type, comment or sample.  A sample's labels are (name, value) pairs in the order of their names.
    """
    raw = F.regexp_replace(F.coalesce(F.col(line), F.lit("")), "\r\\z", "")
    rows = lines.select(F.col(page).alias("page"), F.col(number).alias("number"), raw.alias("line"))
    x = F.col("line")
    said = F.regexp_replace(x, _WHOLE, _PARTS)
    kind = F.when(x == "", "blank").when(x.startswith("# HELP "), "help").when(x.startswith("# TYPE "), "type").when(x.startswith("#"), "comment").otherwise("sample")
    help_name, type_name = F.regexp_extract("line", f"^# HELP ({_METRIC}) ", 1), F.regexp_extract("line", rf"^# TYPE ({_METRIC})[ \t]+({'|'.join(TYPES)})$", 1)
    rows = rows.withColumns({"kind": kind, "said": F.when(kind == "sample", said)})
    rows = rows.withColumn("parts", F.when(F.col("said") != x, F.split("said", "\\x00", 4)))
    kind, parts = F.col("kind"), F.col("parts")
    names = F.regexp_extract_all(_part(parts, 2), F.lit(_PAIR), F.lit(1))
    plain = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("\\\\"), F.lit("\0")), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\0"), F.lit("\\"))
    values = F.transform(F.regexp_extract_all(_part(parts, 2), F.lit(_PAIR), F.lit(2)), plain)
    labels = F.array_sort(F.arrays_zip(names.alias("name"), values.alias("value")))
    token = _part(parts, 3)
    value = F.when(token.rlike(_NUMBER), token.try_cast("double"))
    stamp = F.nullif(_part(parts, 4), F.lit(""))
    rows = rows.withColumns({"metric": F.when(kind == "help", help_name).when(kind == "type", type_name).when(kind == "sample", _part(parts, 1)), "labels": F.when(kind == "sample", labels), "token": token, "value": value, "stamp": stamp, "timestamp_ms": stamp.try_cast("bigint")})
    own = F.col("labels.name")
    code = (
        F.when(x.startswith("﻿") & (F.col("number") == 1), "utf8-bom")
        .when(F.col("kind").isin("help", "type", "sample") & (F.col("metric") == ""), "unsupported-syntax")
        .when((x == "# EOF") | x.startswith("# UNIT "), "unsupported-syntax")
        .when((F.col("kind") == "sample") & (F.size(F.array_distinct(own)) < F.size(own)), "duplicate-sample")
        .when((F.col("kind") == "sample") & (F.col("token").rlike(_ODD) | (F.abs(F.col("value")) == float("inf"))), "nonfinite-value")
        .when((F.col("kind") == "sample") & (F.col("value").isNull() | (F.col("stamp").isNotNull() & F.col("timestamp_ms").isNull())), "unsupported-syntax")
    )
    return rows.select("page", "number", "kind", "metric", "labels", "value", "timestamp_ms", code.alias("code"))


def _judged(read: DataFrame) -> DataFrame:
    """The lines with ``fault``: the number and the code of a line at fault, by itself or for what stands on an earlier line, as one number that orders them."""
    named = F.col("kind").isin("help", "type", "sample") & F.col("code").isNull()
    # every other line is by itself
    same = [F.col("page"), F.col("kind"), F.when(named, F.col("metric")), F.when(named, F.col("labels")), F.when(~named, F.col("number")), ~named]
    before = F.min("number").over(Window.partitionBy(*same))
    again = F.when(F.col("kind") == "sample", "duplicate-sample").otherwise("unsupported-syntax")
    code = F.coalesce("code", F.when(named & (F.col("number") > before), again))
    place = F.array_position(F.array(*map(F.lit, CODES)), code) - 1
    return read.withColumn("fault", F.when(code.isNotNull(), F.coalesce(F.col("number").cast("bigint") * 4, F.lit(_LEAST)) + place))


def _first() -> list[Column]:
    """A page's first line at fault, by the least ``fault``, and its code."""
    first = F.min("fault")
    return [F.when(first >= _LEAST + 4, F.shiftright(first, 2)).alias("number"), F.get(F.array(*map(F.lit, CODES)), F.pmod(first, F.lit(4)).cast("int")).alias("code")]


def refusals(read: DataFrame) -> DataFrame:
    """(page, number, code): the first line of each page at fault, by itself or for what stands on an earlier line."""
    kind = read.schema["number"].dataType
    return _judged(read).where("fault IS NOT NULL").groupBy("page").agg(*_first()).withColumn("number", F.col("number").cast(kind))


def pages(lines: DataFrame, selected: list[str], page: str = "page", number: str = "number", line: str = "line") -> DataFrame:
    """(page, lines, comments, samples, selected, refused_at, code): each page's counts; a refused page has its line and code."""
    read = read_lines(lines, page, number, line)
    counts = [F.count("*").alias("lines"), F.count_if(F.col("kind").isin("help", "type", "comment")).alias("comments"), F.count_if(F.col("kind") == "sample").alias("samples"), F.count_if((F.col("kind") == "sample") & F.col("metric").isin(*selected)).alias("selected")]
    at, code = _first()
    out = _judged(read).groupBy("page").agg(*counts, at, code)
    return out.withColumn("number", F.col("number").cast(read.schema["number"].dataType)).withColumnRenamed("number", "refused_at")
