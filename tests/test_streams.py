"""Stored streams of both formats against what their rules say."""

import pytest

from evenkeel.sources import streams


def ends(spark, bodies, protocol, form):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "k int, body string")
    return [tuple(r)[1:] for r in streams.read_stream(df, "k", "body", protocol, form).orderBy("k").collect()]


def test_frames(spark):
    body = "﻿id: 1\nretry: 250\ndata: a\ndata:  b\n\n: note\rdata: c\r\n\r\nevent: x\nid: bad\0\nretry: soon\ndata\n\nid: 9\n\n\n\nunknown: z\ndata: d\n\ndata: lost"
    rows = streams.sse_frames(spark.createDataFrame([(1, body), (2, None), (3, "event: e\n\n")], "k int, body string"), "k", "body").orderBy("k", "place").collect()
    got = [(r.place, r.kind, r.event, r.id, r.retry, r.comments, r.data, r.incomplete) for r in rows if r.k == 1]
    assert got == [(0, "event", None, "1", 250, [], "a\n b", True), (1, "event", None, "1", None, [" note"], "c", True), (2, "event", "x", "1", None, [], "", True), (3, "event", None, "9", None, [], "d", True)]
    assert [(r.place, r.incomplete) for r in rows if r.k > 1] == [(None, False), (None, False)]


def test_chat(spark):
    delta, used, done = 'data: {"choices":[{"delta":{"content":"x"}}]}\n\n', 'data: {"choices":[],"usage":{"total":3}}\n\n', "data: [DONE]\n\n"
    got = ends(spark, [delta + used + done, delta + done, delta, used + done + delta, delta + done + "data: x", "data: {\n\n" + done, 'data: {"a":1,"a":2}\n\n', "event: error\ndata: {}\n\n", 'data: {"error":null}\n\n' + done, "", 'data: {"usage":null}\n\n' + done, ": c\n\n" + done, 'data: {"choices":[{"text":7}]}\n\n' + done], "openai-chat", "sse")
    assert got == [
        (3, None, None, "done-sentinel", "present", 0), (2, None, None, "done-sentinel", "missing", 0), (1, None, None, "truncated", "missing", 0), (3, "terminal-order", 2, None, None, None), (2, "terminal-order", 2, None, None, None),
        (2, "invalid-json", 0, None, None, None), (1, "invalid-json", 0, None, None, None), (1, None, None, "provider-error", "missing", None), (2, "terminal-order", 1, None, None, None), (0, None, None, "truncated", "missing", None),
        (2, None, None, "done-sentinel", "missing", None), (1, None, None, "done-sentinel", "missing", None), (2, None, None, "done-sentinel", "missing", None),
    ]


def test_responses_and_generic(spark):
    text, end = 'data: {"type":"response.output_text.delta","delta":"x"}\n\n', 'event: response.completed\ndata: {"response":{"usage":{}}}\n\n'
    assert ends(spark, [text + end, text, end + text, 'data: {"type":"x.error"}\n\n', end + "data: y", 'event: response.completed\ndata: {}\n\n'], "openai-responses", "sse") == [(2, None, None, "response.completed", "present", 0), (1, None, None, "truncated", "missing", 0), (2, "terminal-order", 1, None, None, None), (1, None, None, "provider-error", "missing", None), (1, "terminal-order", 1, None, None, None), (1, None, None, "response.completed", "missing", None)]
    assert ends(spark, ["data: 1\n\n", "data: 1\n\ndata: [DONE]\n\n", "data: 1\n\ndata: "], "generic", "sse") == [(1, None, None, "eof", "not-required", 0), (2, None, None, "done-sentinel", "not-required", 0), (1, None, None, "eof", "not-required", 0)]
    with pytest.raises(ValueError):
        ends(spark, [""], "ollama", "sse")


def test_ndjson(spark):
    word, end = '{"response":"a"}\n', '{"done":true,"prompt_eval_count":3,"eval_count":0}'
    got = ends(spark, [word + end, word + end + "\r\n", word, end + "\n" + word, word + "\n" + end, word + "  \n", "{\n", '{"done":true,"prompt_eval_count":3.5,"eval_count":1}', '{"done":"true"}', '{"error":"x"}', "", None, '{"message":{"content":"hi"}}\n' + end, end + "\n\n", '{"done":true,"prompt_eval_count":-1,"eval_count":1}'], "ollama", "ndjson")
    assert got == [
        (2, None, None, "done", "present", 0), (2, None, None, "done", "present", 0), (1, None, None, "truncated", "missing", 0), (2, "terminal-order", 1, None, None, None), (3, "blank-line", 1, None, None, None), (2, "blank-line", 1, None, None, None),
        (1, "invalid-json", 0, None, None, None), (1, None, None, "done", "missing", None), (1, None, None, "truncated", "missing", None), (1, None, None, "provider-error", "missing", None), (0, None, None, "truncated", "missing", None), (0, None, None, "truncated", "missing", None),
        (2, None, None, "done", "present", 0), (2, "blank-line", 1, None, None, None), (1, None, None, "done", "missing", None),
    ]
    assert ends(spark, ['1\n"x"\n', '{"error":1}\n{}'], "generic", "ndjson") == [(2, None, None, "eof", "not-required", 0), (2, "terminal-order", 1, None, None, None)]
