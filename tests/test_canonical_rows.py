"""Canonical JSON as expressions against the driver's encoder; digests of sets against a plain version."""

import hashlib
import math
import random
import struct

import pytest
from pyspark.sql import functions as F, types as T

from evenkeel.functions import canonical, canonical_rows


def texts(spark, values, kind):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)])
    df = spark.createDataFrame(list(enumerate(values)), schema)
    return [r.t for r in df.select("i", canonical_rows.text(F.col("v"), kind).alias("t")).orderBy("i").collect()]


def test_numbers(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.5, 100.0, 1e21, 1e20, 123456789012345680000.0, 1e-6, 1e-7, 5e-324, 1.7976931348623157e308, 2.0**-44, 2.98023223876953125e-8, 2e-3, 9007199254740993.0, 0.1 + 0.2, 333333333.33333329, 4.5, 2e-3, 1e-27, 2.2250738585072014e-308, 1e23, 2e23]
    values += [rng.random() * 10 ** rng.randint(-30, 30) for _ in range(2000)] + [2.0**k for k in range(-1070, 1023, 7)]
    values += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(4000)) if math.isfinite(x)]
    got = texts(spark, values, T.DoubleType())
    assert [(v, g) for v, g in zip(values, got) if g != canonical.number(v)] == []
    assert texts(spark, [math.nan, math.inf, -math.inf, None], T.DoubleType()) == [None, None, None, "null"]
    assert texts(spark, [2**53 - 1, 2**53, -(2**53)], T.LongType()) == ["9007199254740991", None, None]


def test_nested(spark):
    kind = T._parse_datatype_string("struct<b:string,a:array<struct<z:double,y:int>>,`€`:boolean,`A\"`:map<string,double>>")
    every = "".join(map(chr, range(1, 128))) + "é😀€ /  "
    values = [("x", [(1.0, 2), (None, None)], True, {"b": 1.0, "a": 2.5, "\U0001f600": 3.0, "דּ": 4.0}), (every, [], False, {}), (None, None, None, None), ("", [None], None, {"k": None})]
    want = [canonical.encode({"b": b, "a": None if a is None else [None if x is None else {"z": x[0], "y": x[1]} for x in a], "€": c, 'A"': d}) for b, a, c, d in values]
    assert texts(spark, values, kind) == want
    assert texts(spark, [("x", [(math.nan, 1)], None, None)], kind) == [None]
    with pytest.raises(TypeError):
        canonical_rows.text(F.lit(1), T.DateType())


def test_digest(spark):
    df = canonical_rows.row_digest(spark.createDataFrame([("a", 1.5)], "k string, v double"), "d/1")
    assert df.first().digest == canonical.domain_digest("d/1", {"k": "a", "v": 1.5})


def test_tree(spark):
    rows = [("a", str(i % 90)) for i in range(400)] + [("b", None), ("b", "x")]

    def plain(members, levels=4):
        n = {}
        for m in members:
            h = hashlib.sha256((m or "null").encode()).hexdigest()
            n[h] = n.get(h, 0) + 1
        level = {h: f"{h}:{k}" for h, k in n.items()}
        for depth in range(levels, -1, -1):
            groups = {}
            for p, x in level.items():
                groups.setdefault(p[: 2 * depth], []).append(x)
            level = {p: hashlib.sha256(",".join(sorted(xs)).encode()).hexdigest() for p, xs in groups.items()}
            if depth:
                level = {p: f"{p}:{d}" for p, d in level.items()}
        return level[""]

    df = spark.createDataFrame(rows, "k string, m string")
    got = {r.k: (r.digest, r.members) for r in canonical_rows.tree_digest(df, ["k"], "m").collect()}
    assert got == {k: (plain([m for x, m in rows if x == k]), sum(x == k for x, _ in rows)) for k in "ab"}
    changed = canonical_rows.tree_digest(df.withColumn("m", F.when(F.col("m") == "7", "8").otherwise(F.col("m"))), ["k"], "m")
    assert {r.k for r in changed.collect() if r.digest != got[r.k][0]} == {"a"}


def test_numbers_within_keys(spark):
    from evenkeel.functions.numbering import number_within

    rng = random.Random(7)
    rows = [(k, i) for k, n in (("a", 300), ("b", 1), (None, 7), ("c", 40)) for i in rng.sample(range(1000), n)]
    got = number_within(spark.createDataFrame(rows, "k string, x int").repartition(6), ["k"], ["x"]).collect()
    want = {(k, x): (i, n) for k, n in (("a", 300), ("b", 1), (None, 7), ("c", 40)) for i, x in enumerate(sorted(x for j, x in rows if j == k))}
    assert {(r.k, r.x): (r.at, r.n) for r in got} == want and len(got) == len(rows)
    assert number_within(spark.createDataFrame([], "k string, x int"), ["k"], ["x"]).count() == 0


def test_tree_shuffles_members_once(spark):
    """All levels down to the second prefix from the top are worked out where the members lie, also under a constant key."""
    df = spark.range(300).select(F.lit(0).alias("k"), (F.col("id") % 100).cast("string").alias("m"))
    tree = canonical_rows.tree_digest(df, ["k"], "m")
    plan = tree._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 3 and tree.first().members == 300


def test_digest_of_odd_values_is_that_of_the_text(spark):
    """Digests take Spark's JSON writer for common values: also of control characters, long numbers, nulls and unsorted names they are canonical JSON's."""
    values = [("a/é\U0001f600\x7f", 1, [("x", [None, "\b\t\n\f\r\"\\"])]), ("\x01\x1f", -5, None), ("\\u0001", 9007199254740991, [None, (None, None)]), (None, None, []), ("x:1234567890123456789", 0, [(" ", ["</"])])]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v struct<b:string,a:bigint,c:array<struct<z:string,y:array<string>>>>")
    got = [r.d for r in df.select("i", canonical_rows.digest("t", F.col("v"), df.schema["v"].dataType).alias("d")).orderBy("i").collect()]
    plain = lambda v: v and {"a": v[1], "b": v[0], "c": v[2] and [x and {"z": x[0], "y": x[1]} for x in v[2]]}
    assert got == [canonical.domain_digest("t", plain(v)) for v in [*values, None]]
    far = spark.range(1).select(F.struct((F.col("id") + 2**53).alias("a")).alias("v"))
    assert far.select(canonical_rows.digest("t", F.col("v"), far.schema["v"].dataType)).first()[0] is None
    lists = spark.createDataFrame([(0, ([[1], None, []], [(2**53 - 1,), None])), (1, ([[2**53]], None)), (2, (None, [(-(2**53),)]))], "i int, v struct<a:array<array<bigint>>,b:array<struct<n:bigint>>>")
    found = [r.d for r in lists.select("i", canonical_rows.digest("t", F.col("v"), lists.schema["v"].dataType).alias("d")).orderBy("i").collect()]
    assert found == [canonical.domain_digest("t", {"a": [[1], None, []], "b": [{"n": 2**53 - 1}, None]}), None, None]
