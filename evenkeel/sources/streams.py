"""Stored response streams, server-sent events and newline-delimited JSON, by one machine over ordered items.

Either format gives items (key, place, kind, data, ...); a protocol says of each item whether it is an error, ends the stream,
carries usage or output; ``close`` reads the stream's end off them: what is after the end, is no JSON or is blank is a
failure, else the stream has a terminal and its final usage.  All of it is one aggregation by key; a stream's bytes are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SAFE = 2**53 - 1
PROTOCOLS = {"sse": ["generic", "openai-chat", "openai-responses"], "ndjson": ["generic", "ollama"]}


def sse_frames(streams: DataFrame, key: str, body: str, most_retry: int = SAFE) -> DataFrame:
    """(key, place, kind, event, id, retry, comments, data, incomplete): the complete events of each stream, in order.

    Lines end in CR, LF or CRLF; a leading byte order mark is dropped; a field's value loses one leading blank; unknown fields are
    ignored; an id with a NUL is ignored and an id stays for later events; a retry counts if it is digits up to ``most_retry``; an
    event without data is none.  ``kind`` is done for the data ``[DONE]``, else event.  ``incomplete``: fields follow the last
    blank line.  A stream without events has one row with a null place.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), "^﻿", ""), "\r\n|\r", "\n")
    blocks = streams.select(key, F.split(text, "\n\n").alias("blocks"))
    tail = F.exists(F.split(F.element_at("blocks", -1), "\n"), lambda x: x != "")
    parts = blocks.select(key, tail.alias("incomplete"), F.posexplode("blocks").alias("at", "block"), F.size("blocks").alias("n"))
    # the part after the last blank line is no frame; it stays as a row without data, so that no stream is lost
    lines = F.when(F.col("at") < F.col("n") - 1, F.filter(F.split("block", "\n"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    comments = F.transform(F.filter("lines", lambda x: x.startswith(":")), lambda x: F.substr(x, F.lit(2)))
    fields = F.transform(F.filter("lines", lambda x: ~x.startswith(":")), lambda x: F.struct(F.substring_index(x, ":", 1).alias("name"), F.regexp_replace(F.when(x.contains(":"), F.substr(x, F.instr(x, ":") + 1)).otherwise(""), "^ ", "").alias("value")))
    rows = parts.withColumn("lines", lines).select(key, "incomplete", "at", comments.alias("comments"), fields.alias("fields"))
    of = lambda name: F.transform(F.filter("fields", lambda f: f["name"] == name), lambda f: f["value"])
    final = lambda values: F.try_element_at(values, F.lit(-1))
    retry = F.transform(F.filter(of("retry"), lambda v: v.rlike("^0*[0-9]{1,16}$")), lambda v: v.cast("bigint"))
    rows = rows.select(
        key, "incomplete", "at", "comments", final(of("event")).alias("e"), final(F.filter(of("id"), lambda v: ~v.contains("\0"))).alias("i"),
        final(F.filter(retry, lambda v: v <= most_retry)).alias("retry"), of("data").alias("d"),
    )
    order = Window.partitionBy(key).orderBy("at")  # one stored stream
    rows = rows.withColumn("id", F.coalesce(F.last("i", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    rows = rows.withColumn("there", F.size("d") > 0).withColumn("any", F.max("there").over(Window.partitionBy(key)))
    rows = rows.where("there OR (NOT any AND at = 0)").withColumn("place", F.when(F.col("there"), F.row_number().over(order) - 1))
    data = F.when(F.col("there"), F.array_join("d", "\n"))
    kind = F.when(data == "[DONE]", "done").when(F.col("there"), "event")
    return rows.select(key, "place", kind.alias("kind"), F.nullif(F.col("e"), F.lit("")).alias("event"), "id", "retry", "comments", data.alias("data"), "incomplete")


def ndjson_frames(streams: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, kind, data): the lines of each stream; CR before a line's end is dropped, the last line may lack its end.

    ``kind`` is blank for a line of blanks and tabs or of nothing, else event.  A stream without bytes has one row with a null place.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    lines = F.split(F.regexp_replace(text, "\n\\z", ""), "\n")
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(lines)
    rows = streams.select(key, F.posexplode_outer(lines).alias("place", "line"))
    data = F.regexp_replace("line", "\r\\z", "")
    kind = F.when(data.rlike("^[ \t\r]*$"), "blank").when(data.isNotNull(), "event")
    return rows.select(key, "place", kind.alias("kind"), data.alias("data"))


def _is_text(json: Column, path: str) -> Column:
    """Whether there is a string that is not empty."""
    at = F.try_variant_get(json, path, "variant")
    return F.coalesce((F.schema_of_variant(at) == "STRING") & (F.length(F.try_variant_get(json, path, "string")) > 0), F.lit(False))


def _own(json: Column, path: str) -> Column:
    at = F.try_variant_get(json, path, "variant")
    return F.coalesce(~F.is_variant_null(at), F.lit(False)) & at.isNotNull()


def _count(json: Column, path: str) -> Column:
    """Whether there is a whole number from 0 to 2^53 - 1."""
    at = F.try_variant_get(json, path, "variant")
    return F.coalesce((F.schema_of_variant(at) == "BIGINT") & F.try_variant_get(json, path, "bigint").between(0, SAFE), F.lit(False))


def judged(frames: DataFrame, key: str, protocol: str) -> DataFrame:
    """The frames with valid, type, error, ends, completed, used and output, as the protocol says.

    JSON is strict: names that repeat in an object make it none.
    """
    sse = "event" in frames.columns
    if protocol not in PROTOCOLS["sse" if sse else "ndjson"]:
        raise ValueError(f"not a protocol: {protocol}")
    json = F.try_parse_json("data")
    rows = frames.withColumn("json", F.when(F.col("kind") == "event", json))
    v, name = F.col("json"), F.col("event") if sse else F.lit(None).cast("string")
    has = lambda p: F.coalesce(F.array_contains(F.json_object_keys("data"), p), F.lit(False)) & v.isNotNull()
    own_type = F.when(F.schema_of_variant(F.try_variant_get(v, "$.type", "variant")) == "STRING", F.try_variant_get(v, "$.type", "string"))
    kind = F.coalesce(own_type, name) if sse else F.lit(None).cast("string")
    error = has("error")
    if sse:
        error = error | F.coalesce((name == "error") | (kind == "error") | kind.endswith(".error"), F.lit(False))
    completed = F.coalesce(kind == "response.completed", F.lit(False))
    used = _own(v, "$.usage") | _own(v, "$.response.usage") if sse else _count(v, "$.prompt_eval_count") & _count(v, "$.eval_count")
    finished = (F.col("kind") == "done") if sse else F.coalesce((F.schema_of_variant(F.try_variant_get(v, "$.done", "variant")) == "BOOLEAN") & F.try_variant_get(v, "$.done", "boolean"), F.lit(False)) & F.lit(protocol == "ollama")
    if protocol == "openai-chat":
        each = F.try_variant_get(v, "$.choices", "array<variant>")
        output = _is_text(v, "$.text") | _is_text(v, "$.content") | F.coalesce(F.exists(each, lambda c: _is_text(c, "$.text") | _is_text(c, "$.delta.content") | _is_text(c, "$.message.content")), F.lit(False))
    elif protocol == "openai-responses":
        output = (kind == "response.output_text.delta") & _is_text(v, "$.delta")
    elif protocol == "ollama":
        output = ~finished & (_is_text(v, "$.response") | _is_text(v, "$.message.content"))
    else:
        output = v.isNotNull()
    ends = error | finished | (completed & F.lit(protocol == "openai-responses"))
    keep = [key, "place", "kind", *(["incomplete"] if sse else [])]
    shown = {"valid": v.isNotNull() | (F.col("kind") == "done"), "type": kind, "error": error, "finished": finished, "ends": ends, "completed": completed, "used": used, "output": F.coalesce(output, F.lit(False)) & ~error}
    return rows.select(*keep, *[c.alias(n) for n, c in shown.items()])


def close(items: DataFrame, key: str, protocol: str) -> DataFrame:
    """(key, items, failure, failed_at, terminal, final_usage, first_output) of each stream.

    failure: blank-line, terminal-order (something follows the end) or invalid-json, the first that a reader meets, with the place;
    an incomplete event after the end is terminal-order too, at the number of items.  A failed stream has no terminal.
    """
    sse = "incomplete" in items.columns
    c, at = F.col, F.col("place")
    least = lambda rule: F.min(F.when(rule, at))
    out = items.groupBy(key).agg(
        F.count("place").alias("items"), least(c("ends")).alias("end"), least(~c("valid") & (c("kind") != "blank")).alias("bad"), least(c("kind") == "blank").alias("blank"), least(c("finished")).alias("finish"),
        F.max("error").alias("error"), F.max("completed").alias("completed"), F.max_by("used", F.when(c("completed"), at)).alias("completed_used"), F.max_by("used", F.when(~c("finished"), at)).alias("used_before"), F.max_by("used", F.when(c("finished"), at)).alias("used_at"),
        least(c("output")).alias("first_output"), (F.max("incomplete") if sse else F.lit(False)).alias("incomplete"),
    )
    n = c("items")
    beyond = F.when((c("end") + 1 < n) | c("incomplete"), c("end") + 1)
    sentinel = F.when(c("finish").isNotNull() & ((c("finish") + 1 < n) | c("incomplete")), c("finish") + 1) if sse else F.lit(None).cast("int")
    first = F.least(c("blank"), beyond, c("bad"))
    code = F.when(sentinel.isNotNull(), "terminal-order").when(c("blank") == first, "blank-line").when(beyond == first, "terminal-order").when(c("bad") == first, "invalid-json")
    failed_at = F.coalesce(sentinel, first)
    error, done = F.coalesce(c("error"), F.lit(False)), F.coalesce(c("finish") == n - 1, F.lit(False))
    if protocol == "openai-responses":
        terminal, present = F.when(c("completed"), "response.completed").otherwise("truncated"), c("completed_used")
    elif protocol == "ollama":
        terminal, present = F.when(done, "done").otherwise("truncated"), done & c("used_at")
    else:
        terminal, present = F.when(done, "done-sentinel").otherwise("eof" if protocol == "generic" else "truncated"), done & c("used_before")
    usage = F.lit("not-required") if protocol == "generic" else F.when((~error if sse else F.lit(True)) & present, "present").otherwise("missing")
    sound = code.isNull()
    return out.select(key, c("items").cast("bigint").alias("items"), code.alias("failure"), F.when(~sound, failed_at).cast("bigint").alias("failed_at"), F.when(sound, F.when(error, "provider-error").otherwise(terminal)).alias("terminal"), F.when(sound, usage).alias("final_usage"), F.when(sound, c("first_output")).cast("bigint").alias("first_output"))


def read_stream(streams: DataFrame, key: str, body: str, protocol: str, form: str) -> DataFrame:
    """What became of each stored stream, by its protocol; ``form`` is sse or ndjson."""
    frames = {"sse": sse_frames, "ndjson": ndjson_frames}[form](streams, key, body)
    return close(judged(frames, key, protocol), key, protocol)
