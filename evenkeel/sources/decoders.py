"""Decoders of stored bytes: server-sent events, Prometheus text, addresses, redacted errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_SAMPLE = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{((?:[a-zA-Z_][a-zA-Z0-9_]*="(?:[^"\\\n]|\\[\\"n])*",?)*)\})?[ \t]+([^ \t]+)(?:[ \t]+(-?\d+))?[ \t]*$'
_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def prometheus(lines: DataFrame, column: str) -> DataFrame:
    """(metric, labels, value, timestamp_ms, bad) of each sample line; comments and blank lines are left out.

    ``bad`` marks lines that are no sample, and values that are not finite.
    """
    line = F.regexp_replace(F.col(column), r"\r$", "")
    rows = lines.select(line.alias("line")).where(~F.col("line").rlike(r"^\s*(#|$)"))
    part = lambda i: F.regexp_extract("line", _SAMPLE, i)
    names = F.regexp_extract_all(part(2), F.lit(_LABEL), F.lit(1))
    values = F.transform(F.regexp_extract_all(part(2), F.lit(_LABEL), F.lit(2)), lambda v: F.replace(F.replace(F.replace(v, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    value = F.expr(f"try_cast(regexp_extract(line, r'{_SAMPLE}', 3) AS double)")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return rows.select(F.nullif(part(1), F.lit("")).alias("metric"), F.map_from_arrays(names, values).alias("labels"), value.alias("value"), F.expr(f"try_cast(regexp_extract(line, r'{_SAMPLE}', 4) AS bigint)").alias("timestamp_ms"), (~F.coalesce(finite, F.lit(False))).alias("bad"))


def duplicates(samples: DataFrame) -> DataFrame:
    """Metrics with labels that occur more than once."""
    labels = F.array_sort(F.map_entries("labels"))
    return samples.groupBy("metric", labels.alias("labels")).agg(F.count("*").alias("n")).where("n > 1")


def sse(streams: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, event, id, data) of the complete events of each stored stream.

    Lines end in CR, LF or CRLF; a comment begins with a colon; one blank after a field's colon is dropped; an event
    without data is none; an id stays for the events after it; what follows the last blank line is incomplete.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(body), "^\ufeff", ""), "\r\n|\r", "\n")
    parts = streams.select(key, F.posexplode(F.split(text, "\n\n")).alias("at", "block"), F.size(F.split(text, "\n\n")).alias("parts")).where("at < parts - 1")
    lines = F.filter(F.split("block", "\n"), lambda x: (x != "") & ~x.startswith(":"))
    field = lambda name: F.transform(F.filter("lines", lambda x: F.substring_index(x, ":", 1) == name), lambda x: F.regexp_replace(F.when(x.contains(":"), F.substr(x, F.lit(len(name) + 2))).otherwise(""), "^ ", ""))
    rows = parts.withColumn("lines", lines).select(key, "at", field("event").alias("e"), field("id").alias("i"), field("data").alias("d"))
    order = Window.partitionBy(key).orderBy("at")
    last_id = F.last(F.when(F.size("i") > 0, F.element_at("i", -1)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("id", last_id).where(F.size("d") > 0)
    name = F.coalesce(F.nullif(F.try_element_at("e", F.lit(-1)), F.lit("")), F.lit("message"))
    return rows.select(key, (F.row_number().over(order) - 1).alias("place"), name.alias("event"), "id", F.array_join("d", "\n").alias("data"))


def _ipv4_class(octets: Column) -> Column:
    a, b, c = octets[0], octets[1], octets[2]
    special = ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 192) & (b == 88) & (c == 99)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | ((a == 198) & b.isin(18, 19))
    return (
        F.when(a == 127, "loopback")
        .when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), "private")
        .when((a == 169) & (b == 254), "link-local")
        .when((a == 100) & b.between(64, 127), "shared")
        .when((a >= 224) & (a < 240), "multicast")
        .when((a == 0) | (a >= 240), "reserved")
        .when(special, "special")
        .otherwise("public")
    )


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ipv6_words(address: Column) -> Column:
    """The eight words of an IPv6 address as numbers; null if it is none.  A zone (``%``) makes it none."""

    def hexed(low: Column) -> Column:
        """A dotted end as two words."""
        octets = F.split(F.regexp_extract(low, rf":({_IPV4})$", 1), r"\.")
        pair = lambda o, i: F.lower(F.hex(o[i].cast("bigint") * 256 + o[i + 1].cast("bigint")))
        return _let(octets, lambda o: F.when(F.size(o) == 4, F.concat(F.regexp_extract(low, "^(.*:)", 1), pair(o, 0), F.lit(":"), pair(o, 2))).otherwise(low))

    words = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))

    def filled(halves: Column) -> Column:
        left, right = words(halves[0]), words(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
        return _let(F.struct(left.alias("l"), right.alias("r"), F.size(halves).alias("n")), whole)

    def whole(x: Column) -> Column:
        missing = 8 - F.size(x["l"]) - F.size(x["r"])
        fits = ((x["n"] == 1) & (missing == 0)) | ((x["n"] == 2) & (missing >= 1))
        every = F.concat(x["l"], F.array_repeat(F.lit("0"), missing), x["r"])
        return F.when(fits & F.forall(F.concat(x["l"], x["r"]), lambda w: w.rlike("^[0-9a-f]{1,4}$")), F.transform(every, lambda w: F.conv(w, 16, 10).cast("int")))

    return F.when(address.contains(":"), _let(F.split(hexed(F.lower(address)), "::"), filled))


def _ipv6_class(words: Column) -> Column:
    a, b = words[0], words[1]
    special = ((a == 0x2001) & ((b <= 0x01FF) | (b == 0x0DB8))) | (a == 0x2002) | (a.bitwiseAND(0xFFF0) == 0x3FF0)
    last = F.forall(F.slice(words, 1, 7), lambda w: w == 0) & (words[7] == 1)
    return F.when(
        words.isNotNull(),
        F.when(last, "loopback")
        .when(a.bitwiseAND(0xFE00) == 0xFC00, "private")
        .when(a.bitwiseAND(0xFFC0) == 0xFE80, "link-local")
        .when(a.bitwiseAND(0xFF00) == 0xFF00, "multicast")
        .when(special, "special")
        .when(a.bitwiseAND(0xE000) == 0x2000, "public")
        .otherwise("reserved"),
    )


def address_class(address: Column) -> Column:
    """What a dotted IPv4 or an IPv6 address is for; null if it is none.  Only ``public`` ones may be reached."""
    return F.when(address.rlike(rf"^{_IPV4}$"), _let(F.split(address, r"\.").try_cast("array<int>"), _ipv4_class)).otherwise(_let(ipv6_words(address), _ipv6_class))


MESSAGES = {"transport": "the connection failed", "timeout": "the time limit was reached", "provider": "the provider reported an error"}


def redact(errors: DataFrame) -> DataFrame:
    """Errors that may be kept: the category's fixed message, and the status if it is one."""
    message = F.create_map(*[x for k, v in MESSAGES.items() for x in (F.lit(k), F.lit(v))])[F.col("category")]
    return errors.withColumn("message", message).withColumn("http_status", F.when(F.col("http_status").between(100, 599), F.col("http_status")))
