"""Operators 11 to 13 against plain versions, and the SQL of all operators that have some."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import audit, pieces, queries, variants

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t ", "▁", "a▁▁b", "don't, stop-it (now); a.b,c!\"?\n\nok", "日本語 テスト😀é́ ﬁ①½", " lead", "tail ", "<s></s><unk><0x41>", "\0a\0", "x" * 3000, "  " * 500, "same text", "same text"]


def table(spark, rows, schema):
    """A table with further columns whose names the operators use inside."""
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in ("word", "n", "key", "mask", "same", "part", "least", "ids", "spans")})


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path(queries.PIECES))


def test_pieces_are_the_librarys(spark, library):
    rng = random.Random(1)
    made = ["".join(rng.choices("ab ,.\n▁é日😀<s>0x1'-\t", k=rng.randint(0, 40))) for _ in range(300)]
    rows = list(enumerate(ODD + made)) + [(None, "null id"), (3, "again"), (3, "again")]
    docs = table(spark, rows, "doc_id bigint, text string")
    got = sorted(pieces.encode_documents(docs, P.path(queries.PIECES)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, bytes(r.ids)))
    texts = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, np.array(library.encode(r[1] or "", add_eos=True), "<u4").tobytes()))
    assert len(got) == len(rows)
    for r, (_, text) in zip(got, texts):
        proto = library.encode(text or "", return_type="proto")
        ids = [p.id for p in proto.pieces] + [2]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert np.frombuffer(r.spans, "<u4").reshape(-1, 2).tolist() == [[p.begin, p.end] for p in proto.pieces]
    digests = pieces.encode_documents(docs, P.path(queries.PIECES), digests=True).collect()
    assert collections.Counter(r.ids_sha256 for r in digests) == collections.Counter(hashlib.sha256(" ".join(map(str, library.encode(t or "", add_eos=True))).encode()).hexdigest() for _, t in rows)
    assert all(r.covered for r in digests)
    assert pieces.encode_documents(docs.limit(0), P.path(queries.PIECES)).count() == 0


def test_any_ids_decode_as_the_librarys(library):
    rng, codec = random.Random(2), pieces.Codec(pieces.Model.read(P.path(queries.PIECES)))
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(259), 28705, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids).decode() == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_character_map_and_offsets(rule):
    from sentencepiece import SentencePieceNormalizer

    own = SentencePieceNormalizer(rule_name=rule, escape_whitespaces=True, add_dummy_prefix=True, remove_extra_whitespaces=True)
    normalize = pieces.Normalizer(pieces.Model.parse(own.serialized_model_proto()))
    for text in [*filter(None, ODD), "ﬀ ½ Ⅷ  ｶﾞ ñ ñ ​ x ﻿", "  Ａｂ　Ｃ  "]:
        want, offsets = own.normalize(text, with_offsets=True)
        got, source = normalize(text)
        raw, places = text.encode(), np.cumsum([0, *(len(c.encode()) for c in got)])
        assert got == want and [len(raw[: source[i]].decode()) for i in places] == list(offsets)


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"")
    with pytest.raises(ValueError):
        pieces.Codec(pieces.Model.read(str(tmp_path / "m")))


def plain_variants(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if doc_id is not None and h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))

    near = {w: [v for v in n if one(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: best[w] if w in best and n[best[w]] >= 2 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=repr)


def test_variants(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcéñ÷", k=rng.randint(4, 7))) for _ in range(25)]
    chain = [w for i, w in enumerate(["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb"]) for _ in range(3 * 2**i)]  # a way of four steps
    rows = [(1, " ".join(chain)), (2, None), (3, ""), (4, "ABÉCD abÉcd ABécd " * 3), (None, "Words words WORDS x" * 4), (5, "z" * 4000 + " " + "qqqqq " * 300)]
    for i in range(300):
        own = []
        for w in rng.choices(base, weights=[1 / (j + 1) for j in range(25)], k=rng.randint(0, 40)):
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "b", "ñ"]) + w[at + rng.randint(0, 1) :]
            own.append(w)
        rows.append((10 + i // 2, ", ".join(own)))
    want = plain_variants(rows)
    got = variants.group(table(spark, rows, "doc_id bigint, text string"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(w == "aaaaa" and r == "abbbb" for w, _, r, *_ in want) and any(len(w) == 5 and "é" in w for w, *_ in want)
    assert variants.group(table(spark, [], "doc_id bigint, text string")).count() == 0


def test_no_words_of_variants_are_sent_through_the_driver(spark):
    words = spark.createDataFrame([("alpha", 9), ("alphas", 3)], "word string, n bigint")
    for joined in (variants.near_pairs(words), variants.group(table(spark, [(i, "alpha alphas") for i in range(4)], "doc_id bigint, text string"))):
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_audit(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = [None, "", "x # y", "CAPS " * 250, " ".join(words), " ".join(words), " ".join(words[:120] * 3), "a" * 5000, "é" * 40 + " AB"]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts * 4)] + [(5, " ".join(words), "en"), (5, " ".join(words), "en"), (None, " ".join(words), "fr")]
    labels = [(0, 1, 0), (4, 1, None), (4, None, 1), (9, 0, 1), (13, 1, 1), (None, 1, 1)]
    failed = []
    for d, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        early = any(o == t and a is not None and d is not None and a < d for a, o, _ in ((a, o or "", x) for a, o, x in rows))
        codes = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), early]
        good, toxic = (any(x == d and d is not None and y[i] == 1 for x, *y in labels) for i in (0, 1))
        failed.append((lang or "", "".join(f for f, c in zip("ABCDE", codes) if c), good, toxic))
    want = {}
    for part in {p for p, *_ in failed}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                row = want.setdefault((part, order, step), [0] * 6)
                for p, fails, good, toxic in failed:
                    if p == part:
                        gone, here = any(x in fails for x in order[: step - 1]), f in fails
                        for i, c in enumerate([not gone and not here, here and not gone, here and gone, fails == f, here and not gone and good, here and not gone and toxic]):
                            row[i] += c
    shapley = collections.Counter()
    for (part, order, step), row in want.items():
        shapley[part, order[step - 1]] += row[1]
    got = audit.audit(audit.cells(audit.fail_masks(table(spark, rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))))
    assert {(r.part, r.filter_order, r.step): [*r[3:9]] for r in got.collect()} == want
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in got.collect()) and got.count() == len(want) == 600 * 4
    none = table(spark, [], "doc_id bigint, text string, lang string")
    assert audit.audit(audit.cells(audit.fail_masks(none, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    rel = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    order = sorted(names)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v
    assert sorted(got.columns) == order
    assert sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr) == sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=repr)


def test_token_store_reads_added_tokens_as_the_contract_says(spark, tmp_path):
    """In the library's default mode the name of an added token in a text is that token."""
    from tokenizers import Tokenizer

    from evenkeel.llm import tokenstore

    path = P.path(queries.WORD_TOKENIZER)
    library = Tokenizer.from_file(path)
    texts = [None, "", "a <|endoftext|> b", "<|ENDOFTEXT|>", "x<|startoftext|>y.", "<|endoftext|><|endoftext|>", "<|end oftext|>", "plain words, here."] + [t for t in ODD if t]
    store = tokenstore.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), path, 2, f"file://{tmp_path}/s")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32, r.verified) for r in tokenstore.read_store(spark, store).collect()}
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert got == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True) for i, ids in want.items()}
    assert 49407 in want[2]
