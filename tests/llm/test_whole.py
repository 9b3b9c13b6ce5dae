"""What the operators once left undone, on small tables."""

import collections
import re

import public_tokenizers as P
from pyspark.sql import functions as F

from evenkeel.llm import decontam, pii, tokenstore


def replaced(spark, *texts):
    rows = pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "key").collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def test_secrets_in_any_case_and_of_any_length(spark):
    long, letters = "aB3" * 100, "Q" * 16
    texts = ['TOKEN = "9233A8EC17BD40F2"', "PASSWORD: Hunterhunter", "see Api_Key=abcdefghij now", f"secret={long}.", f"ghp_{long} end", f"key AKIA{letters}", "sk_" + "x" * 20, "no tokens here: none"]
    got = replaced(spark, *texts)
    assert re.fullmatch(r'TOKEN = "[0-9A-Z]{16}"', got[0]) and "9233A8EC" not in got[0]
    assert re.fullmatch("PASSWORD: [A-Z][a-z]{11}", got[1]) and "unterhunter" not in got[1]
    assert re.fullmatch("see Api_Key=[a-z]{10} now", got[2]) and "abcdefghij" not in got[2]
    # nothing of a long value stays, its tail neither
    assert re.fullmatch(r"secret=([a-z][A-Z][0-9]){100}\.", got[3]) and long[200:] not in got[3]
    assert re.fullmatch(r"ghp_([a-z][A-Z][0-9]){100} end", got[4]) and long[200:] not in got[4]
    # letters only, in texts without any other sign of an entity
    assert re.fullmatch("key AKIA[A-Z]{16}", got[5]) and letters not in got[5]
    assert re.fullmatch("sk_[a-z]{20}", got[6]) and "x" * 20 not in got[6]
    assert got[7] == texts[7]


def test_manifest_decides(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 3) for i in range(40)] + [(None, None)], "doc_id int, text string")
    path = tokenstore.write_store(docs, P.path("word_bpe_49k.json"), 2, f"file://{tmp_path}/s", parts=4)
    whole = {r.doc_id: (r.start, r.verified) for r in tokenstore.read_store(spark, path).collect()}
    assert all(v for _, v in whole.values())
    kept = spark.read.parquet(f"{path}/recipes").localCheckpoint()
    parts = {r.doc_id: r.part for r in kept.collect()}
    # a row of the first file is lost, and another file as a whole
    assert len(set(parts.values())) > 2
    short, gone = sorted(set(parts.values()))[:2]
    first = next(d for d, p in parts.items() if p == short)
    kept.where(~F.col("doc_id").eqNullSafe(F.lit(first)) & (F.col("part") != gone)).write.mode("overwrite").parquet(f"{path}/recipes")
    got = tokenstore.read_store(spark, path).collect()
    there = [r for r in got if r.root]
    assert {r.doc_id for r in there} == {d for d, p in parts.items() if p != gone and d != first}
    assert all(r.verified == (parts[r.doc_id] != short) for r in there)
    assert all(r.start == whole[r.doc_id][0] for r in there if parts[r.doc_id] > gone)
    assert [(r.doc_id, r.verified) for r in got if not r.root] == [(None, False)]


def test_ids_are_joined_from_payloads(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = [None, "", "The quick brown fox. " * 400, "one", "one"]
    store = tokenstore.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), path, 2, f"file://{tmp_path}/s")
    got = {r.doc_id: list(r.ids) for r in tokenstore.read_ids(spark, store).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}


def test_passes_do_not_change_results(spark, monkeypatch):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(1, " ".join(words)), (1, " ".join(words)), (1, "alpha beta " + " ".join(words * 5)), (None, " ".join(words[:3])), (None, "gamma delta epsilon " * 9), (None, None), (2, "gamma delta epsilon"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate([" ".join(words), "one two three", "gamma delta epsilon", "alpha beta"])], "item_id int, text string")
    found = lambda: sorted(((r.doc_id, r.n_words, r.n_hit, bytes(r.hit_mask or b""), tuple(r["items"])) for r in decontam.decontaminate(docs, items).collect()), key=repr)
    once = found()
    monkeypatch.setattr(decontam, "QUERY_BYTES", 20)
    assert found() == once and len(once) == len(rows)


def test_jaccard_of_large_groups(spark, monkeypatch):
    """Groups of many chunks, of several zones of size, with near copies that link in chains only, against brute force."""
    import numpy as np

    from evenkeel.llm import jaccard
    from tests.llm.test_operators import brute_classes

    monkeypatch.setattr(jaccard, "CHUNK", 6)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(160):
        own = base[: int(rng.integers(55, 90))] if i % 3 else base + [f"tail{i}-{j}" for j in range(int(rng.integers(0, 60)))]
        for p in rng.integers(0, len(own), int(rng.integers(0, 4))):
            own = [*own[:p], f"x{i}", *own[p + 1 :]]
        rows.append((1000 - i, " ".join(own)))
    rows += [(None, rows[0][1]), (7, rows[1][1]), (7, rows[1][1]), (8, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit(1).alias("pivot"), F.lit("x").alias("fp"))
    for k, percent in ((4, 85), (5, 80)):
        got = jaccard.join(df, k, percent).collect()
        want = brute_classes(rows, k, percent)
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
        heads = [r for r in got if r.first and r.n_shingles]
        assert sorted(r.component_id for r in heads) == sorted({c for _, n, c in want if n})
    assert jaccard.join(df.limit(0), 5, 80).count() == 0


def test_jaccard_of_very_long_texts(spark, monkeypatch):
    from evenkeel.llm import jaccard
    from tests.llm.test_operators import brute_classes

    monkeypatch.setattr(jaccard, "SHINGLES", 20_000)  # blocks of one or two of these
    rows = [(i, " ".join(f"w{j * 7919 % 30011}" for j in range(i * 900, 30_000))) for i in range(6)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(rows, 5, 80)


def test_names_keep_coreference(spark):
    texts = ["Mr. Jean-Luc Picard met Mrs Smith. Later Picard said that Jean-Luc Picard and SMITH left; Picardy stays.", "Mr Smith wrote; Mr. John Smith too, as J. Smith.", "Smith and Picard, untitled here, stay.", "Dr No; Monsieur O'Neil van Dyke Jones", "Госпожа Иванова и Иванова"]
    got = replaced(spark, *texts)
    m = re.fullmatch(r"Mr\. ([A-Z]\w+)-([A-Z]\w+) ([A-Z]\w+) met Mrs ([A-Z]\w+)\. Later (\w+) said that (\w+)-(\w+) (\w+) and SMITH left; Picardy stays\.", got[0])
    assert m and m[3] == m[5] == m[8] and (m[1], m[2]) == (m[6], m[7]) and len({m[1], m[2], m[3], m[4]}) == 4
    assert not re.search("Jean|Luc|Picard(?!y)|Smith", got[0])
    n = re.fullmatch(r"Mr ([A-Z]\w+) wrote; Mr\. ([A-Z]\w+) ([A-Z]\w+) too, as J\. ([A-Z]\w+)\.", got[1])
    assert n and n[1] == n[3] == n[4] and m[4] == n[1][:-1] + "na"  # one last name, another gender
    assert got[2] == texts[2]
    assert re.fullmatch(r"Dr No; Monsieur [A-Z]'[A-Z]\w+ van [A-Z]\w+ [A-Z]\w+", got[3])
    w = re.fullmatch(r"Госпожа ([А-Я]\w+на) и (\w+)", got[4])
    assert w and w[1] == w[2] != "Иванова"


def test_pii_odd_tables(spark):
    long = "word " * 60_000 + "mail a@b.com " + "word " * 60_000
    rows = [(1, long, "x", 1), (None, "a@b.com", "y", 2), (None, "a@b.com", "y", 2), (2, None, None, None), (3, "", "", 0), (4, "number 20240101123456 and 4111111111111112", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, found string, uid int").withColumn("_key", F.lit("k")).withColumn("row", F.lit(1))
    got = pii.replace_entities(df, "key")
    assert got.columns == [*df.columns, "n_entities"]
    got = got.collect()
    by = {r.doc_id: r for r in got if r.doc_id}
    assert len(got) == 6 and by[4].text == rows[5][1] and by[4].n_entities == 0  # digits that fail Luhn's check are no cards
    mails = {r.text for r in got if r.doc_id is None}
    assert len(mails) == 1 and "a@b.com" not in mails and f" {mails.pop()} " in by[1].text and len(by[1].text) > 599_990
    assert (by[1].found, by[1].uid, by[1]._key, by[1].row) == ("x", 1, "k", 1) and by[2].text is None and by[3].text == ""
    assert pii.replace_entities(df.limit(0), "key").count() == 0


def test_small_spaces_are_widened(spark):
    """More entities than their form has room for: all surrogates are distinct and none is an entity."""
    ten = [(kind, f"4{i}") for i in range(10) for kind in ("ssn", "phone")] + [("ip", "1.2.3.4"), ("iban", "DE1"), ("secret", "sk_")]
    made, _ = pii.surrogates(spark.createDataFrame(ten, "kind string, canon string"), "key")
    made = made.collect()
    for kind in ("ssn", "phone"):
        own = {r.surrogate for r in made if r.kind == kind}
        assert len(own) == 10 and not own & {f"4{i}" for i in range(10)}


def test_pii_against_a_plain_version(spark):
    """What stays of a text, and what its entities are, found by another engine's patterns over the whole table."""
    import regex

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in pii.replace_entities(docs, "key").collect()}
    assert set(before) == set(after)
    luhn = lambda s: sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(re.sub(r"\D", "", s)))) % 10 == 0
    card = regex.compile(f"^(?:{pii.PATTERNS['card']})$")
    every, seen = regex.compile(pii.ALL), {}
    for d, text in before.items():
        found = [m for m in every.finditer(text or "") if not (card.match(m[0]) and not luhn(m[0]))]
        assert after[d].n_entities == len(found)
        rest, at = after[d].text or "", 0
        for i, m in enumerate(found):  # what stands between entities is the same, and equal entities have equal surrogates
            between = text[at : m.start()]
            assert rest.startswith(between)
            rest, at = rest[len(between) :], m.end()
            stop = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]
            new = rest[: rest.index(stop)] if stop and i + 1 < len(found) else (rest[: len(rest) - len(stop)] if i + 1 == len(found) else rest[: len(m[0])])
            assert new != m[0] and seen.setdefault(m[0], new) == new
            rest = rest[len(new) :]
        assert rest == (text or "")[at:]
    assert len(set(seen.values())) == len(seen) and seen


def test_every_language_is_learned(spark):
    """More labels than any table holds, one of them by copies of one text only; no letter is `und`."""
    import regex

    from evenkeel.llm import langid

    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"l{i:03d}", f"{alphabet[i % 26] * 3}{alphabet[i // 26] * 4} " * 20) for i in range(300) for _ in range(2)]
    rows += [("ru", "съешь ещё этих мягких булок")] * 50 + [(None, "no label"), ("xx", None)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    assert model[0] == sorted({a for a, b in rows if a and b})
    odd = [("aaaaaaa bbb", "?"), ("× ÷ ×", "und"), ("123 ½ …", "und"), ("", "und"), (None, "und"), ("этих булок", "ru"), ("é", None), ("zzzllll " * 3, "l311"), ("ab " * 100_000, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(odd)], "doc_id int, text string").withColumn("spans", F.lit(1)).withColumn("share", F.lit(2))
    got = {r.doc_id: r for r in langid.label(df, model).collect()}
    for i, (t, want) in enumerate(odd):
        assert got[i].lang_pred in model[0] or got[i].lang_pred == "und"
        assert want in (None, "?") or want not in [*model[0], "und"] or got[i].lang_pred == want, (t, got[i].lang_pred)
        assert (got[i].lang_pred == "und") == (t is None or not regex.search(r"\p{L}", t))
    assert langid.label(df.limit(0), model).count() == 0


def test_language_against_a_plain_version(spark):
    """Word by word: n-gram sums over a dictionary, Viterbi by recursion, then the language of most bytes."""
    import numpy as np

    from evenkeel.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    langs, tables, scripts = model = langid.train(docs)
    rows = docs.where("length(text) between 20 and 1500").limit(40).collect()
    got = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.label(docs, model).collect()}
    for r in rows:
        buf, words, scores, at = np.frombuffer(r.text.encode(), np.uint8), [], [], 0
        slots = list(langid._grams(buf, np.array([0, len(buf)])))
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", r.text.encode()):
            span = range(m.start(), m.end())
            own = np.array([sum(float(tables[i, g][slots[g][p]]) for g in range(len(langid.GRAMS)) for p in span) for i in range(len(langs))])
            script = langid._word_scripts(buf, np.array([m.start()]), np.array([m.end()]))[0]
            if script < 0:
                own[:] = 0
            elif scripts[:, script].any():
                own[~scripts[:, script]] -= 50
            words.append(len(span))
            scores.append(own)
        best = [(scores[0], [[i] for i in range(len(langs))])]
        value, paths = best[0]
        for own in scores[1:]:
            top = int(value.argmax())
            stay = value >= value[top] - langid.PENALTY
            paths = [paths[i if stay[i] else top] + [i] for i in range(len(langs))]
            value = np.maximum(value, value[top] - langid.PENALTY) + own
        path = paths[int(value.argmax())]
        mass = np.bincount(path, words, len(langs))
        assert got[r.doc_id] == (langs[int(mass.argmax())], round(float(mass.max() / mass.sum()), 6))


def test_jaccard_of_many_texts_of_one_id(spark, monkeypatch):
    """Texts of one null id meet only their own rows: as many are read as when each has an id, and the classes are the same."""
    import numpy as np

    from evenkeel.llm import jaccard
    from tests.llm.test_operators import brute_classes

    rng = np.random.default_rng(5)
    texts = []
    for i in range(120):
        own = [f"g{i % 4}-{j}" for j in range(60)]
        own[int(rng.integers(0, 60))] = f"x{i}"
        texts.append(" ".join(own))
    lean, read = jaccard.lean, {}
    for name, ids in (("own", range(len(texts))), ("null", [None] * len(texts))):
        seen = spark.sparkContext.accumulator(0)

        def counting(f, seen=seen):
            inner = lean(f)

            def run(batches):
                def counted():
                    for b in batches:
                        if b.schema.names[1:3] == ["fp", "text"]:
                            seen.add(b.num_rows)
                        yield b

                yield from inner(counted())

            return run

        monkeypatch.setattr(jaccard, "lean", counting)
        rows = list(zip(ids, texts))
        got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(rows, 5, 80)
        read[name] = (seen.value, sum(r.first for r in got))
    assert read["null"] == read["own"] and 0 < read["own"][0] <= 5 * len(texts)
