"""Metric pages line by line; collector policies: routes, requests, narrowing."""

import pytest

from evenkeel.operators import collector
from evenkeel.sources import exposition


def test_lines(spark):
    good = {
        'm 1': ("m", [], 1.0, None), 'm{} -2.5e-1 7': ("m", [], -0.25, 7), 'a:b{ x = "1" , b="q\\"\\\\\\n" }\t+.5\t-3': ("a:b", [("b", 'q"\\\n'), ("x", "1")], 0.5, -3), 'm{x="}, y=\\"z"} 3.': ("m", [("x", '}, y="z')], 3.0, None), 'm 1 ': ("m", [], 1.0, None), 'm 1\r': ("m", [], 1.0, None), 'm 1 +9223372036854775807': ("m", [], 1.0, 2**63 - 1),
    }
    bad = {
        "m": "unsupported-syntax", "m{x=\"1\",} 1": "unsupported-syntax", 'm{x="\\t"} 1': "unsupported-syntax", "m 1 2 3": "unsupported-syntax", "m 0x1": "unsupported-syntax", "9m 1": "unsupported-syntax", "m +Inf": "nonfinite-value", "m nan": "nonfinite-value", "m 1e999": "nonfinite-value",
        'm{x="1",x="2"} 1': "duplicate-sample", "m 1 9223372036854775808": "unsupported-syntax", "# EOF": "unsupported-syntax", "# UNIT m s": "unsupported-syntax", "# HELP m": "unsupported-syntax", "# TYPE m": "unsupported-syntax", "# TYPE m info": "unsupported-syntax", " m 1": "unsupported-syntax",
    }
    fine = ["# any", "#EOF", "# HELP m text", "# TYPE m\tgauge", "", "\r"]
    lines = [*good, *bad, *fine]
    rows = exposition.read_lines(spark.createDataFrame([("p", i + 2, x) for i, x in enumerate(lines)], "page string, number int, line string")).orderBy("number").collect()
    for line, r in zip(lines, rows, strict=True):
        if line in good:
            assert (r.metric, [tuple(x) for x in r.labels], r.value, r.timestamp_ms, r.code) == (*good[line], None), line
        else:
            assert r.code == bad.get(line), line


def test_pages(spark):
    pages = {
        "sample": (["a 1", "b 2", 'a{x="1"} 1', 'a{x="1"} 2', "a 3"], (4, "duplicate-sample")),
        "order": (['a{x="1",y="2"} 1', 'a{y="2",x="1"} 2'], (2, "duplicate-sample")),
        "help": (["# HELP a x", "# TYPE a gauge", "a 1", "# HELP a y"], (4, "unsupported-syntax")),
        "type": (["# TYPE a gauge", "# TYPE b gauge", "# TYPE a counter", "b nan"], (3, "unsupported-syntax")),
        "first": (["b nan", "# TYPE a gauge", "# TYPE a counter"], (1, "nonfinite-value")),
        "mark": (["﻿a 1"], (1, "utf8-bom")),
        "fine": (["# HELP a x", "# TYPE a gauge", "a 1", "# note", "# note", "", 'a{x="2"} 1'], (None, None)),
    }
    df = spark.createDataFrame([(p, i + 1, x) for p, (lines, _) in pages.items() for i, x in enumerate(lines)], "page string, number int, line string").repartition(5)
    got = {r.page: r for r in exposition.pages(df, ["a"]).collect()}
    assert {p: (r.refused_at, r.code) for p, r in got.items()} == {p: want for p, (_, want) in pages.items()}
    assert (got["fine"].lines, got["fine"].comments, got["fine"].samples, got["fine"].selected) == (7, 4, 2, 2)


def test_pages_read_lines_once(spark):
    """One shuffle of the lines and one of the pages' counts, no join; NULs, odd line ends and numbers told twice are as before."""
    lines = [(1, "m 1\0"), (2, "m{x=\"a\"} 1\0\0 5"), (3, "n 1 \u2028"), (4, "o 2\u2028"), (5, "k \0"), (6, "\0k 1"), (7, "m\0 1")]
    odd = spark.createDataFrame([("p", *x) for x in lines], "page string, number int, line string")
    got = [(r.metric, r.value, r.timestamp_ms, r.code) for r in exposition.read_lines(odd).orderBy("number").collect()]
    bad = "unsupported-syntax"
    assert got == [("m", None, None, bad), ("m", None, 5, bad), ("n", 1.0, None, None), ("o", None, None, bad), ("k", None, None, bad), ("", None, None, bad), ("", None, None, bad)]
    rows = [("p", 1, "a 1"), ("p", 2, "a 2"), ("p", 2, "b nan"), ("p", 3, "a 3"), ("q", 1, "a 1"), ("q", 1, "a 2"), ("r", None, "# EOF"), ("r", 1, "a nan"), (None, 5, "a 1"), (None, 6, "a 1"), ("s", -3, "a 1"), ("s", -2, "a 1")]
    out = exposition.pages(spark.createDataFrame(rows, "page string, number int, line string"), ["a"])
    assert {(r.page, r.lines, r.samples, r.refused_at, r.code) for r in out.collect()} == {("p", 4, 4, 2, "duplicate-sample"), ("q", 2, 2, None, None), ("r", 2, 1, None, bad), (None, 2, 2, 6, "duplicate-sample"), ("s", 2, 2, -2, "duplicate-sample")}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 2 and "Join" not in plan


ROUTES = [("/", ["r"]), ("/v1", []), ("/v1/chat", ["k1", "k2"])]


@pytest.fixture(scope="module")
def tables(spark):
    ends = [("top", "e", "o", "p", "b"), ("kid", "e", "o", "p", "b"), ("moved", "e", "o", "p", "b2"), ("stray", "x", "o", "p", "b")]
    routes = [("top", "e", "GET", p, a) for p, a in ROUTES] + [("kid", "e", "GET", "/v1/chat/x", ["k2"]), ("kid", "e", "GET", "/v1", None), ("moved", "e", "GET", "/v1/chat", ["k1", "z"]), ("stray", "x", "GET", "/", ["r"])]
    policies = [("top", None, "disabled", 10, ["s"], None, ["/d"])] + [(k, "top", "disabled", 10, ["s"], [], ["/d"]) for k in ("kid", "moved", "stray")] + [("orphan", "none", "disabled", 1, [], [], []), ("wide", "top", "literal-loopback-only", 11, ["s", "t"], ["v"], ["/e"])]
    make = spark.createDataFrame
    return make(policies, "policy string, parent string, local_mode string, duration_ms int, secrets array<string>, evaluator_keys array<string>, roots array<string>"), make(ends, "policy string, alias string, origin string, profile string, build string"), make(routes, "policy string, alias string, method string, prefix string, references array<string>")


def test_requests(spark, tables):
    asked = {
        ("e", "p", "b", "GET", "/v1/chat", "k1"): ("authorized", "/v1/chat"), ("e", "p", "b", "GET", "/v1/chat/a/b", "k2"): ("authorized", "/v1/chat"), ("e", "p", "b", "GET", "/v1/chatter", None): ("authorized", "/v1"), ("e", "p", "b", "GET", "/v1/chatter", "k1"): ("authentication", None), ("e", "p", "b", "GET", "/v1/chat", None): ("authentication", None),
        ("e", "p", "b", "GET", "/", "r"): ("authorized", "/"), ("e", "p", "b", "POST", "/v1", None): ("no-route", None), ("e", "p", "b2", "GET", "/v1", None): ("runtime-mismatch", None), ("y", "p", "b", "GET", "/v1", None): ("unknown-endpoint", None),
    }
    rows = spark.createDataFrame([(i, "top", *k) for i, k in enumerate(asked)] * 2, "request int, policy string, alias string, profile string, build string, method string, path string, reference string")
    got = [(r.verdict, r.prefix) for r in collector.authorize(rows.where("request < 99").dropDuplicates(), tables[1], tables[2]).orderBy("request").collect()]
    assert got == list(asked.values())


def test_narrowing(tables):
    got = {r.policy: r.widened for r in collector.widenings(*tables).collect()}
    assert got == {"kid": [], "moved": ["endpoint-identity", "route-authority"], "stray": ["endpoint-identity", "route-authority"], "orphan": ["unknown-parent"], "wide": ["local-mode", "duration", "secrets", "evaluator-keys", "store-roots"]}
