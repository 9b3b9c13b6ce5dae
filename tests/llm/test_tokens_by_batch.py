import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from evenkeel.llm import tokenstore
from evenkeel.llm.util import column_bytes
from tokenizers import Tokenizer

PATH = P.path("word_bpe_49k.json")


class Counted(tokenstore.Words):
    asked = 0

    def __getitem__(self, word):
        self.asked += 1
        return super().__getitem__(word)


def words_of():
    with open(PATH, encoding="utf-8") as f:
        return Counted(f.read(), "<u2")


def streams(words, texts):
    ids, ends = words.streams(*column_bytes(pa.array(texts, pa.string())), 2)
    return [part.tolist() for part in np.split(ids, ends[:-1])] if texts else []


def test_a_batch_gives_the_ids_of_the_library():
    library, draw, words = Tokenizer.from_file(PATH), random.Random(7), words_of()
    marks = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    bits = [*marks, *marks, " ", " ", "\n", "\t", "\v", "\x1c", "\x85", " ", "a", "B", "s", "It's", "we'LL", "x'S", "é", "é", "É", "̸", "̧", "ß", "İ", "K", "ſ", "Ж", "中", "7", "٣", "😀", "word", "Other", "<|endoftext|>", "<|", "|>", "<|startOfText|>"]
    for _ in range(60):
        texts = ["".join(draw.choices(bits[: draw.choice([len(bits) - 4, len(bits)])], k=draw.choice([0, 1, 2, 9, 40]))) for _ in range(20)]
        # a name that reaches from one text into the next is none
        texts += [None, "", "so <|endof", "text|> there", "́", "e", "e", "́x", " ", "end."]
        assert streams(words, texts) == [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert streams(words, [None, ""]) == [[2], [2]] and streams(words, [""]) == [[2]]


def test_a_word_is_looked_up_once_a_batch():
    words = words_of()
    streams(words, ["eden*** eden### eden, Eden. eden; other eden" * 5] * 300)
    # the words, the marks, and what differs by the white space after it
    assert words.asked <= 12 and words[b"eden"] and b"eden***" not in words


def test_crcs_of_parts_join():
    draw = np.random.default_rng(3)
    for sizes in ([[1, 2, 3], [5], [], [0, 4, 0]], [[1023, 1024, 1025], [70_000, 1, 1_100_000, 7]], [[]], []):
        parts = [[draw.integers(0, 1 << 32, n, dtype=np.uint32).tobytes() for n in own] for own in sizes]
        flat = [p for own in parts for p in own]
        edges = np.cumsum([0, *map(len, sizes)])
        got = tokenstore.crc_join(np.array([zlib.crc32(p) for p in flat], np.int64), np.array([len(p) // 4 for p in flat], np.int64), edges)
        assert got.tolist() == [zlib.crc32(b"".join(own)) for own in parts]


def test_documents_of_many_chunks_and_cut_payloads(spark, tmp_path):
    draw = random.Random(1)
    texts = [" ".join(draw.choices(["alpha", "beta", "gamma", "delta,", "epsilon."], k=n)) for n in (1, 4000, 9000)] * 2 + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    library = Tokenizer.from_file(PATH)
    path = tokenstore.write_store(docs, PATH, 2, f"file://{tmp_path}/s")
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    got = {r.doc_id: (r.n_tokens, r.ids_crc32, r.verified) for r in tokenstore.read_store(spark, path).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for i, x in want.items()}
    # payloads that lost half an id are found, and do not stop the reading
    chunks = [(bytes(r.digest), bytes(r.payload)[:-1]) for r in spark.read.parquet(f"{path}/chunks").collect()]
    assert len(chunks) > 20
    spark.createDataFrame(chunks, "digest binary, payload binary").write.mode("overwrite").parquet(f"{path}/chunks")
    assert not any(r.verified for r in tokenstore.read_store(spark, path).collect())
