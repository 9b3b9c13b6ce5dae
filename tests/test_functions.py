import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import canonical, identity, prng, sampling, stats
from evenkeel.operators import controller, evidence, experiments, replay, runtime
from evenkeel.sources import bounded, decoders, packets, providers
from evenkeel.streaming import windows


def test_mulberry_first_draws(spark):
    got = [r["u"] for r in spark.range(3).select(prng.draw(F.col("id"), 42).alias("u")).collect()]
    assert got == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099]


def test_modulo_takes_the_whole_digest(spark):
    for n in (10, 7, 10_000):
        digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(20)]
        got = [r["m"] for r in spark.createDataFrame([(d,) for d in digests], "d string").select(sampling.modulo(F.col("d"), n).alias("m")).collect()]
        assert got == [int(d, 16) % n for d in digests]


def test_weighted_quantile_of_a_heavy_and_a_light_case(spark):
    rows = spark.createDataFrame([("k", 100.0, 3.0), ("k", 1000.0, 1 / 3), ("k", 1000.0, 1 / 3), ("k", 1000.0, 1 / 3)], "k string, v double, w double")
    got = stats.weighted_quantiles(rows, ["k"], "v", "w", {"p50": 0.5, "p95": 0.95}).first()
    assert (got["p50"], got["p95"]) == (100.0, 1000.0)


def test_r7(spark):
    values = F.sort_array(F.array(*[F.lit(float(x)) for x in (4, 1, 3, 2)]))
    got = spark.range(1).select(stats.r7(values, 0.25).alias("a"), stats.r7(values, 0.5).alias("b"), stats.r7(values, 2).alias("c")).first()
    assert tuple(got) == (1.75, 2.5, 4.0)


@pytest.mark.parametrize("x, text", [(1.0, "1"), (0.1, "0.1"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (-0.0, "0"), (333333333.33333329, "333333333.3333333"), (4.5, "4.5"), (2e-3, "0.002"), (1.5e300, "1.5e+300")])
def test_canonical_numbers(x, text):
    assert canonical.number(x) == text


def test_canonical_order_and_errors():
    assert canonical.encode({"b": [True, None], "a": "é\n"}) == '{"a":"é\\n","b":[true,null]}'
    assert canonical.encode({"\U0001f600": 1, "ﬀ": 2}).startswith('{"\U0001f600"')
    for bad in (float("nan"), "\ud800", 2**60):
        with pytest.raises(ValueError):
            canonical.encode(bad)


@pytest.mark.parametrize("raw, code", [(b'{"a":1,"a":2}', "duplicate-key"), (b"\xff", "invalid-utf-8"), (b"\xef\xbb\xbf{}", "byte-order-mark"), (b" ", "empty-input"), (b"[" * 70 + b"]" * 70, "too-deep"), (b'"\\ud800"', "lone-surrogate"), (b"[NaN]", "number-not-finite"), (b"[1e999]", "number-not-finite"), (b"{", "invalid-json")])
def test_bounded_json_errors(raw, code):
    with pytest.raises(bounded.InputError) as e:
        bounded.parse(raw)
    assert e.value.code == code


def test_ndjson(spark, tmp_path):
    (tmp_path / "x.ndjson").write_bytes(b'{"a":1,"b":"x"}\r\n\n{"a":1,"a":2,"b":"y"}\n{"a":1,"b":"z","c":0}\nno\n{"a":2}\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.StringType(), False)])
    got = bounded.ndjson(spark, f"file://{tmp_path}/x.ndjson", schema).collect()
    assert [r["error_code"] for r in sorted(got, key=lambda r: r["line"])] == [None, "blank-line", "duplicate-key", "unknown-field", "invalid-json", "missing-field"]
    assert [r["line"] for r in sorted(got, key=lambda r: r["line"])] == [1, 2, 3, 4, 5, 6]


def test_ndjson_shapes(spark, tmp_path):
    from pyspark.sql import types as T

    inner = T.StructType([T.StructField("c", T.LongType(), False)])
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", inner), T.StructField("d", T.ArrayType(inner, False)), T.StructField("x", T.DoubleType())])
    cases = [
        ('{"a":1,"b":{"c":2},"d":[{"c":3}],"x":1}', None),
        ('{"a":null,"b":null,"d":[],"x":1.5e3}', None),
        ("{}", None),
        ('{"a":"x"}', "wrong-type"),
        ('{"a":1.5}', "wrong-type"),
        ('{"a":12345678901234567890}', "wrong-type"),
        ('{"x":true}', "wrong-type"),
        ('{"b":[]}', "wrong-type"),
        ('{"b":{"c":1,"zz":3}}', "unknown-field"),
        ('{"b":{"c":1,"c":2}}', "invalid-json"),
        ('{"b":{}}', "missing-field"),
        ('{"d":[{"c":1},null]}', "missing-field"),
        ('{"d":[{"c":1},{"c":"y"}]}', "wrong-type"),
        ("[1]", "invalid-json"),
    ]
    (tmp_path / "s.ndjson").write_text("\n".join(x for x, _ in cases))
    got = {r["line"]: r["error_code"] for r in bounded.ndjson(spark, f"file://{tmp_path}/s.ndjson", schema).collect()}
    assert [got[i + 1] for i in range(len(cases))] == [want for _, want in cases]


def test_line_numbers_over_blocks(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "n").mkdir()
    for name, n in (("a", 3000), ("b", 1700), ("c", 0), ("d", 1)):
        (tmp_path / "n" / name).write_text("".join(f'{{"i":{i + 1}}}\n' for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = bounded.ndjson(spark, f"file://{tmp_path}/n", T.StructType([T.StructField("i", T.LongType())]), max_rows=2900)
        got = rows.collect()
        assert rows.rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 4701 and sum(r["error_code"] == "too-many-items" for r in got) == 100
    assert all(r["value"]["i"] == r["line"] for r in got if r["error_code"] is None)


def test_addresses_as_the_library_reads_them(spark):
    import ipaddress

    tried = ["::", "::1", "1::", "2001:db8::1", "2001:0200::1", "2606:4700::1111", "FE80::1", "fc00::", "ff02::1", "::ffff:10.0.0.1", "2606::1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1::2::3", "1:2:3:4:5:6:7:8:9", "12345::", "g::", ":1", "1:", "2::1:", "fe80::1%eth0", "1.2.3.4", "01.2.3.4", "1.2.3.256", "192.88.99.1", "::1.2.3", "1.2.3.4::", "", None]
    got = {r[0]: (r[1], r[2]) for r in spark.createDataFrame([(x,) for x in tried], "a string").select("a", decoders.address_class(F.col("a")), decoders.ipv6_words(F.col("a"))).collect()}
    for x in tried:
        try:
            known = ipaddress.ip_address(x or "") if "%" not in (x or "") else None
        except ValueError:
            known = None
        assert (got[x][0] is not None) == (known is not None), x
        if known and known.version == 6:
            assert got[x][1] == [int(known) >> (112 - 16 * i) & 0xFFFF for i in range(8)]
    assert [got[x][0] for x in ("::", "::1", "2001:db8::1", "2606:4700::1111", "FE80::1", "fc00::", "192.88.99.1")] == ["reserved", "loopback", "special", "public", "link-local", "private", "special"]


def test_prometheus(spark):
    lines = ["# HELP x y", "", 'm{a="1\\"2",b="q"} 1.5 7\r', "m 3", "m +Inf", "9bad 1", 'm{a="1"} 2', 'm{a="1"} 3']
    got = decoders.prometheus(spark.createDataFrame([(x,) for x in lines], "l string"), "l")
    rows = got.collect()
    assert len(rows) == 6 and sum(r["bad"] for r in rows) == 2
    assert rows[0]["labels"] == {"a": '1"2', "b": "q"} and rows[0]["timestamp_ms"] == 7
    assert [r["n"] for r in decoders.duplicates(got.where("size(labels) = 1")).collect()] == [2]


def test_sse(spark):
    body = "﻿event: a\r\ndata: 1\r\ndata:2\r\n\r\n: c\n\nid: 5\ndata\n\ndata: half"
    got = decoders.sse(spark.createDataFrame([(1, body)], "k int, b string"), "k", "b").orderBy("place").collect()
    assert [(r["event"], r["id"], r["data"]) for r in got] == [("a", None, "1\n2"), ("message", "5", "")]


def test_packet(tmp_path):
    digest = packets.write(str(tmp_path / "p"), {"a.json": b"{}"})
    assert packets.verify(str(tmp_path / "p"), digest) == {"a.json": b"{}"}
    (tmp_path / "p" / "a.json").write_bytes(b"[]")
    with pytest.raises(ValueError):
        packets.verify(str(tmp_path / "p"))
    with pytest.raises(FileExistsError):
        packets.write(str(tmp_path / "p"), {"a.json": b"{}"})


def test_replay_cases(spark):
    cols = "case_id string, replicate int, group_id int, weight double, slice string, input_tokens int, p_status string, p_score double, p_confidence double, p_ttft double, p_e2e double, p_tps double, p_cost double, e_status string, e_score double, e_ttft double, e_e2e double, e_tps double, e_cost double"
    base = [1, 1, 1.0, "routine", 10, "success", 0.5, 0.9, 1.0, 2.0, 30.0, 1.0, "success", 1.0, 10.0, 20.0, 40.0, 5.0]

    def case(name, **k):
        names = [c.split()[0] for c in cols.split(", ")][1:]
        return (name, *[k.get(n, b) for n, b in zip(names, base)])

    rows = spark.createDataFrame([case("routine"), case("failed", p_status="failure"), case("unsure", p_confidence=None), case("long", input_tokens=99), case("slice", slice="hot"), case("both", p_status="failure", e_status="failure")], cols)
    policies = replay.enumerate_policies(spark, [0.5], [50], fast_only=False).where("kind = 'cascade'")
    got = {r["case_id"]: r for r in replay.replay(rows, policies, ["hot"]).collect()}
    assert {k for k, r in got.items() if r["escalated"]} == {"failed", "unsure", "long", "slice", "both"}
    assert (got["routine"]["cost"], got["routine"]["ttft"], got["routine"]["e2e"]) == (1.0, 1.0, 2.0)
    assert (got["long"]["cost"], got["long"]["ttft"], got["long"]["e2e"], got["long"]["score"]) == (6.0, 12.0, 22.0, 1.0)
    assert (got["both"]["status"], got["both"]["score"], got["both"]["ttft"], got["both"]["tps"]) == ("failure", 0.0, 22.0, 0.0)
    assert all(r["total_tps"] is None for r in got.values())


def test_outcome_precedence(spark):
    ex = spark.sql("SELECT * FROM VALUES (1, 'success', 'sent', 5), (2, 'failure', 'sent', 5), (3, 'success', 'sent_unknown', 5), (4, 'success', 'sent', 5), (5, 'success', 'sent', 5), (6, 'success', 'sent', 5) AS t(k, status, dispatch, completed_at)")
    ev = spark.sql("SELECT * FROM VALUES (1, 6, 'scored', 0.5D), (2, 6, 'scored', 0.5D), (3, 6, 'scored', 0.5D), (4, 4, 'scored', 0.5D), (5, 6, 'abstained', NULL), (9, 6, 'scored', 0.5D) AS t(k, produced_at, kind, score)")
    got = {r["k"]: (r["outcome"], r["score"]) for r in evidence.outcomes(ex, ev, ["k"]).collect()}
    assert got == {1: ("scored", 0.5), 2: ("failure", 0.0), 3: ("ambiguous", None), 4: ("invalid", None), 5: ("abstained", None), 6: ("missing", None), 9: ("orphan", None)}


def test_stream_then_seal(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT), 0) AS ts FROM range(60)")
    rows.unionByName(rows.where("event_id < 5")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id BIGINT, ts TIMESTAMP").parquet(f"{tmp_path}/in")
    query = windows.collect(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("completed_at", F.timestamp_add("MINUTE", F.lit(5), F.col("ts")))
    assert kept.count() == 60
    inside, late = windows.seal(kept, "2024-01-01 00:10:00", "2024-01-01 00:30:00", "2024-01-01 00:30:00")
    assert (inside.count(), late.count()) == (16, 4)


def test_ed25519_test_vectors():
    """RFC 8032, section 7.1, tests 1 to 3."""
    vectors = [
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
        ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
    ]
    for seed, public, message, signature in (map(bytes.fromhex, v) for v in vectors):
        assert identity.public_key(seed) == public and identity.sign(seed, message) == signature
        assert identity.verify(public, message, signature)
        assert not identity.verify(public, message + b"x", signature) and not identity.verify(public, message, signature[:-1])
    assert not identity.verify(None, b"", b"") and not identity.verify(b"\xff" * 32, b"", b"\0" * 64)


def test_hmac(spark):
    row = spark.createDataFrame([(bytearray(b"payload"),), (None,)], "m binary")
    for key in (bytes(range(32)), bytes(100)):
        got = [r["h"] for r in row.select(identity.hmac_sha256(key, F.col("m")).alias("h")).collect()]
        assert got == [hmac.new(key, b"payload", "sha256").hexdigest(), None]
    with pytest.raises(ValueError):
        identity.hmac_sha256(b"short", F.lit(b""))


def test_controller_stops_at_gaps_conflicts_and_the_event_limit(spark):
    start = [(1, "protocol-registered"), (2, "collection-started")]
    rows = [("whole", *x) for x in start + start] + [("gap", 1, "protocol-registered"), ("gap", 3, "collection-started")]
    rows += [("torn", 1, "protocol-registered"), ("torn", 1, "controller-retired"), ("late", 2, "collection-started")]
    rows += [("over", p, "protocol-registered" if p == 1 else "identity-drift-recorded") for p in range(1, 10_003)]
    facts = spark.createDataFrame(rows, "c string, place long, fact string").selectExpr("*", "CAST(NULL AS STRING) AS result", "CAST(NULL AS BOOLEAN) AS expired")
    got = {r["c"]: tuple(r)[1:] for r in controller.reduce_facts(facts, "c").collect()}
    assert got == {"whole": ("COLLECTING", 2, None), "gap": ("REGISTERED", 1, 2), "torn": ("DRAFT", 0, 1), "late": ("DRAFT", 0, 1), "over": ("STALE", 10_000, 10_001)}


def test_diagnosis_takes_the_first_rule(spark):
    schema = "phase string, status string, failed array<string>, insufficient array<string>, stale array<string>, capacity_unknown boolean, mismatch boolean"
    rows = [
        ("development", "HOLD", ["maximum-p95-ttft"], ["evaluator-abstention"], [], False, True),
        ("window", "STALE", [], [], ["evaluator-evidence-stale"], False, False),
        ("window", "STALE", [], [], ["evaluator-evidence-stale", "protocol-expired"], False, False),
        ("window", "HOLD", [], ["required-service-capacity-unavailable"], [], False, True),
        ("holdout", "HOLD", [], ["required-service-capacity-unavailable"], [], False, True),
        ("development", "NOMINATED", [], [], [], False, False),
    ]
    got = [r["diagnosis"] for r in experiments.diagnose(spark.createDataFrame(rows, schema)).collect()]
    assert got == ["insufficient-evidence", "evaluator-drift", None, "unavailable-capacity", "capability-mismatch", "sealed-shadow-replication"]


def test_admission_of_no_jobs(spark):
    got = runtime.admission(spark.createDataFrame([], "profile string, response_limit long"), 3, 10, {"records": 0}).first()
    assert tuple(map(int, got[:5])) == (0, 0, 1, 0, 0) and got["broken"] == ["records"]


def test_stream_end_knows_provider_errors(spark):
    done = ("message", '{"type":"response.completed","response":{"usage":{"total_tokens":1}}}')
    streams = {"whole": [done], "named": [("error", "{}")], "typed": [("message", '{"type":"x.error"}')], "null": [("message", '{"error":null}')], "failed": [("message", '{"type":"response.failed"}')]}
    rows = [(k, i, *e) for k, es in streams.items() for i, e in enumerate(es)]
    got = {r[0]: (r[1], r[2]) for r in providers.stream_end(spark.createDataFrame(rows, "k string, place int, event string, data string"), "k", "openai-responses").collect()}
    error = ("provider-error", "missing")
    assert got == {"whole": ("response.completed", "present"), "named": error, "typed": error, "null": error, "failed": ("truncated", "missing")}
