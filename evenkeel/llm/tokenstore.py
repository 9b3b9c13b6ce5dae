"""Token ids as a content-addressed binary store.

Layout under the store's folder (all Parquet, ids little-endian, 16 bits where the vocabulary allows, else 32):

* ``chunks/``    digest -> payload; a rolling hash over the ids cuts each document's stream, equal chunks are kept once;
* ``recipes/``   one row per document in ascending order of its id (file after file): its chunk digests in order, its
  length, and the Merkle root over the digests;
* ``manifest/``  per recipe file: rows, ids, and the root over its documents' roots.

``read_store`` goes the other way: it hashes every payload anew, rebuilds each document's CRC from its chunks' CRCs
(CRC-32 is linear, so payloads need not be brought together), and checks digests and roots.  What a recipe file holds must
give the manifest's rows, ids and root, else none of its documents is verified; a file that is lost whole stands as one row
of the manifest's ids without a document.  ``read_ids`` joins the payloads to each document's ids.

Repeated rows are documents of their own and share their chunks.  A null text is empty and holds the end id only; a null
id sorts first.  An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import string
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F, Window

from .util import BLOCK, blocks, column_bytes, drop_table, lean, mix, share, shared_root, ship

WINDOW, MASK, LEAST, MOST = 16, 0xFF, 32, 4096  # ids under the rolling hash, one cut in 256, bounds of a chunk
STRETCH = 1 << 14  # ids whose rolling hashes are worked out at a time
MEMO = 400_000  # words in each of the two generations of a worker's memo; results do not depend on it


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = byte_letters()


class Words(dict):
    """Ids (as bytes) of single words, found by the tokenizers library when first asked for.

    Outside its pattern the tokenizer drops white space, and none of its steps looks across white space, so a text's ids
    are those of its words, one after another.  Nor does a step look across the place between an ASCII letter and an ASCII
    mark (``parting`` has the marks for which the library says so): what follows is a word of its own here, which leaves
    fewer words to ask for.

    A word of small letters up to U+052F in composed form passes the tokenizer's normalizer and pattern as it is, so the
    library's model is asked for it at once.  A text that holds the name of an added token, in any case, goes to the
    library whole.
    """

    def __init__(self, spec: str, width: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.width, self.old = width, {}
        self.code = {2: "H", 4: "I"}[int(width[2])]
        whole = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.lowers = whole(string.ascii_lowercase) == whole(string.ascii_uppercase)
        tried = ["word", "q", string.ascii_lowercase, "été", "straße", "жизнь", "ñandú"]
        self.direct = self.lowers and all(whole(x) == self._of_model(x) for x in tried)
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # an apostrophe may begin a shortened word, so it is left with what stands before it
        parts = lambda m: all(whole("q" + x) == whole("q") + whole(x) for x in (m, m + m, m + "q", m + "'s", m + " q"))
        self.parting = [m for m in string.punctuation if m != "'" and parts(m)]
        self.kind = np.zeros(256, np.uint8)
        self.kind[[*b" \t\n\r\v\f"]] = _SPACE
        self.kind[[*string.ascii_letters.encode()]] = _LETTER
        self.kind[[*"".join(self.parting).encode()]] = _MARK

    def _of_model(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS))]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        got = self.old.get(word)
        if got is None:
            text = word.decode()
            small = word.isalpha() and word.islower() if text.isascii() else text.isalpha() and text == text.lower() and max(text) < "\u0530" and unicodedata.is_normalized("NFC", text)
            got = array(self.code, self._of_model(text)).tobytes() if self.direct and small else self.library(text)
        self[word] = got
        return got

    def library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def streams(self, buf: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that stand one after another in ``buf``, the end id after each; and where each text's ids end.

        The words of all texts become codes into the different ones, and only those are looked up, once each.
        """
        raw = buf.tobytes()
        low = raw.lower()
        at = np.frombuffer(low if self.lowers else raw, np.uint8)
        named = {int(i) for name in self.added for i in _holders(low, name, offs)}
        marked = (buf == 0xCC) | (buf == 0xCD) if self.lowers else np.zeros(0, bool)
        if marked.any():  # marks of U+0300 to U+036F may compose with a small letter and not with its capital
            at = at.copy()
            for i in np.unique(np.searchsorted(offs, np.flatnonzero(marked), "right") - 1).tolist():
                at[offs[i] : offs[i + 1]] = buf[offs[i] : offs[i + 1]]
        kind = self.kind[at]
        space = kind == _SPACE
        begins = np.zeros(len(at) + 1, bool)
        begins[1:-1] = (space[:-1] & ~space[1:]) | ((kind[:-1] == _LETTER) & (kind[1:] == _MARK))
        for i in named:
            begins[offs[i] : offs[i + 1]] = False
        begins[offs] = True  # of each text, and the end of all
        bounds = np.flatnonzero(begins)
        words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(at)]).dictionary_encode()
        first = np.searchsorted(bounds, offs)  # word of each text's begin
        codes = words.indices.to_numpy().copy()
        skip = {int(codes[first[i]]) for i in named}
        _, cut, spelt = words.dictionary.buffers()
        cut, spelt = np.frombuffer(cut, np.int64, len(words.dictionary) + 1).tolist(), spelt.to_pybytes()
        # what stands for a whole text is left out here
        got = [b"" if k in skip else self[spelt[a:b].strip()] for k, (a, b) in enumerate(zip(cut, cut[1:]))]
        for i in named:
            codes[first[i]] = len(got)
            got.append(self.library(raw[offs[i] : offs[i + 1]].decode()))
        flat = np.frombuffer(b"".join(got), self.width)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // int(self.width[2])
        starts = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])  # ids after each number of words
        ids = flat[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])]
        stops = ends[first[1:]]
        return np.insert(ids, stops, end_id), stops + np.arange(1, len(stops) + 1)


_workers: dict[str, Words] = {}
_SPACE, _LETTER, _MARK = 1, 2, 3


def _holders(low: bytes, name: bytes, offs: np.ndarray):
    """The texts in which ``name`` stands; what reaches from one text into the next does not count."""
    i = low.find(name)
    while i >= 0:
        text = int(np.searchsorted(offs, i, "right")) - 1
        if i + len(name) <= offs[text + 1]:
            yield text
            i = low.find(name, int(offs[text + 1]))
        else:
            i = low.find(name, i + 1)


_gears = np.zeros(0, np.uint64)


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of the windows of WINDOW ids whose rolling hash has MASK's bits clear; sums of 1, 2, 4, ... ids build it up."""
    global _gears
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    if len(_gears) <= int(ids.max()):
        _gears = mix(np.arange(max(65536, 2 * int(ids.max())), dtype=np.uint64) + np.uint64(0x51ED270B))
    found = []
    for at in range(0, len(ids) - WINDOW + 1, STRETCH):  # by stretches that stay in the processor's cache
        roll, step = _gears[ids[at : at + STRETCH + WINDOW - 1]], 1
        with np.errstate(over="ignore"):
            while step < WINDOW:
                more = roll.copy()
                more[step:] += roll[:-step] << np.uint64(2 * step)
                roll, step = more, 2 * step
        found.append(np.flatnonzero((roll[WINDOW - 1 :] >> np.uint64(40)) & np.uint64(MASK) == 0) + (at + WINDOW))
    return np.concatenate(found)


def cuts(ids: np.ndarray, ends: list[int]):
    """Ends of the chunks of each id stream; the streams stand one after another in ``ids`` and end at ``ends``."""
    found = marks(ids)
    edges = np.array([0, *ends], np.int64)
    low = np.searchsorted(found, edges[:-1] + WINDOW).tolist()  # the first window that lies wholly in its stream
    high = np.searchsorted(found, edges[1:], "right").tolist()
    found, last = found.tolist(), 0
    for a, b, end in zip(low, high, ends):
        out = []
        if end - last > LEAST:
            for cut in [*found[a:b], end]:
                while cut - last > MOST:
                    last += MOST
                    out.append(last)
                if cut - last >= LEAST:
                    out.append(cut)
                    last = cut
        if last < end:
            out.append(end)
        last = end
        yield out


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node goes up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def write_store(docs, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> str:
    """Tokenize, chunk and store; returns the store's folder.  The tokenizer file goes out by broadcast (a vocabulary's size)."""
    spark = docs.sparkSession
    path = path or f"{shared_root(spark)}/evenkeel-store-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    from tokenizers import Tokenizer

    width = "<u2" if max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1) <= 65536 else "<u4"
    shared = share(spark, (spec, width, hashlib.sha256(spec.encode()).hexdigest()))
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut_up(batches):
        spec, width, key = shared.value
        if key not in _workers:
            _workers.clear()
            _workers[key] = Words(spec, width)
        known, size = _workers[key], int(width[2])
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            names, totals, roots, edges, payloads = [], [], [], [0], {}
            for _, _, buf, offs in blocks(*column_bytes(batch.column(1)), size=4 * BLOCK):
                ids, ends = known.streams(buf, offs, end_id)
                stream, last = ids.tobytes(), 0
                for own in cuts(ids, ends.tolist()):
                    begin = last
                    for cut in own:
                        payload = stream[last * size : cut * size]
                        names.append(digest(payload))
                        payloads[names[-1]] = payload
                        last = cut
                    totals.append(last - begin)
                    roots.append(merkle(names[edges[-1] :]))
                    edges.append(len(names))
            seqs = np.arange(len(names)) - np.repeat(edges[:-1], np.diff(edges))
            chunks = pa.StructArray.from_arrays([pa.array(seqs, pa.int32()), pa.array(names, pa.binary())], names=["seq", "digest"])
            columns = [batch.column(0), pa.array(range(uid, uid + len(batch)), pa.int64()), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), chunks), pa.array(roots, pa.binary())]
            own = [pa.array(list(payloads), pa.binary()), pa.array(list(payloads.values()), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(batch), c.type) for c in own)], names=fields)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(payloads), c.type) for c in columns), *own], names=fields)
            uid += len(batch)

    # rows of documents, and rows of chunks (digest and payload only), each payload once a batch
    raw, fields = f"{path}/raw", ["doc_id", "uid", "n_tokens", "chunks", "root", "digest", "payload"]
    schema = f"doc_id {id_type}, uid bigint, n_tokens bigint, chunks array<struct<seq:int,digest:binary>>, root binary, digest binary, payload binary"
    docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(cut_up), schema).write.option("compression", "zstd").parquet(raw)
    pieces = spark.read.schema(schema).parquet(raw)
    pieces.where("payload IS NOT NULL").groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = pieces.where("uid IS NOT NULL").select(*fields[:5])
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "uid").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "uid").withColumn("part", F.spark_partition_id())
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop_table(spark, raw)

    def manifest(batches):
        kept: dict[int, list] = {}
        for batch in batches:
            for part, pairs, n_tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
                kept.setdefault(part, []).append((len(pairs), n_tokens, merkle([p["root"] for p in pairs])))
        flat = [(p, *x) for p, xs in kept.items() for x in xs]
        kinds = (("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], k) for i, (_, k) in enumerate(kinds)], names=[k for k, _ in kinds])

    # a recipe file's roots are as many as its documents, which the number of files bounds
    order = F.array_sort(F.collect_list(F.struct(F.col("doc_id"), F.col("uid"), F.col("root"))))
    spark.read.parquet(f"{path}/recipes").groupBy("part").agg(order.alias("roots"), F.sum("n_tokens").alias("n_tokens")).select("part", "roots", "n_tokens").mapInArrow(lean(manifest), "part int, n_docs bigint, n_tokens bigint, root binary").write.parquet(f"{path}/manifest")
    spark.createDataFrame([(width, end_id)], "width string, end_id int").coalesce(1).write.parquet(f"{path}/format")
    return path


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo CRC-32's, bits reflected."""
    one, p = np.uint32(1), np.zeros(len(a), np.uint32)
    for bit in range(31, -1, -1):
        p ^= b * (a >> np.uint32(bit) & one)
        b = (b >> one) ^ (b & one) * _POLY
    return p


_DIGIT = 10
_powers: list[np.ndarray] = []


def _power(digit: int) -> np.ndarray:
    """x to the powers 32 * v * 2 ** (_DIGIT * digit), modulo CRC-32's polynomial, for v below 2 ** _DIGIT."""
    while len(_powers) <= digit:
        out = np.array([0x80000000], np.uint32)  # 1
        step = _times(_powers[-1][-1:], _powers[-1][1:2]) if _powers else np.array([_POLY])  # x ** 32
        for _ in range(_DIGIT):
            out = np.concatenate([out, _times(out, np.repeat(step, len(out)))])
            step = _times(step, step)
        _powers.append(out)
    return _powers[digit]


def crc_join(crcs: np.ndarray, sizes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """CRC-32 of each whole from the CRCs of its parts in order and their sizes in ids of four bytes; ``edges`` are between wholes."""
    ends = np.cumsum(sizes)
    last = np.concatenate([[0], ends])[edges[1:]]
    after = np.repeat(last, np.diff(edges)) - ends  # ids that follow a part in its whole
    out, digit = crcs.astype(np.uint32), 0
    while after.any():
        out = _times(out, _power(digit)[after & ((1 << _DIGIT) - 1)])
        after, digit = after >> _DIGIT, digit + 1
    run = np.concatenate([np.zeros(1, np.uint32), np.bitwise_xor.accumulate(out)])
    return (run[edges[1:]] ^ run[edges[:-1]]).astype(np.int64)


def check_parts(spark, path: str, recipes):
    """(part, n_docs, n_tokens, intact) of each recipe file that the manifest or the recipes name, by the manifest's figures."""

    def top(batches):
        for batch in batches:
            yield batch.set_column(1, "top", pa.array([merkle([p["root"] for p in pairs]) for pairs in batch.column(1).to_pylist()], pa.binary()))

    order = F.array_sort(F.collect_list(F.struct("doc_id", "uid", "root")))
    own = recipes.groupBy("part").agg(order.alias("top"), F.count("*").alias("own_docs"), F.sum("n_tokens").alias("own_tokens")).mapInArrow(lean(top), "part int, top binary, own_docs bigint, own_tokens bigint")
    both = spark.read.parquet(f"{path}/manifest").join(own, "part", "full")
    same = F.col("n_docs").eqNullSafe(F.col("own_docs")) & F.col("n_tokens").eqNullSafe(F.col("own_tokens")) & F.col("root").eqNullSafe(F.col("top"))
    return both.select("part", F.coalesce("n_docs", "own_docs").alias("n_docs"), F.coalesce("n_tokens", "own_tokens").alias("n_tokens"), same.alias("intact"), F.col("own_docs").isNull().alias("lost"))


def read_ids(spark, path: str):
    """(doc_id, uid, ids) of every document of the store, the payloads of its chunks joined in order; null if one is missing or changed."""
    ship(spark)
    width = spark.read.parquet(f"{path}/format").first()["width"]
    refs = spark.read.parquet(f"{path}/recipes").select("doc_id", "uid", F.explode_outer("chunks").alias("c")).select("doc_id", "uid", "c.seq", "c.digest")
    whole = refs.join(spark.read.parquet(f"{path}/chunks"), "digest", "left").groupBy("doc_id", "uid").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "payload"))).alias("got"))

    def join_up(batches):
        for batch in batches:
            ids = []
            for got in batch.column(2).to_pylist():
                sound = all(c["payload"] is not None and digest(c["payload"]) == c["digest"] for c in got)
                ids.append(np.frombuffer(b"".join(c["payload"] for c in got), width).astype(np.int64) if sound else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "uid", "ids"])

    kind = whole.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(lean(join_up), f"doc_id {kind}, uid bigint, ids array<bigint>")


def gathered(column) -> tuple[np.ndarray, pa.StructArray]:
    """(edges, structs): the structs of a column of lists one after another, and where each list begins and the last ends."""
    edges = column.offsets.to_numpy().astype(np.int64)
    return edges - edges[0], column.flatten()


def read_store(spark, path: str):
    """One row per document of the store: doc_id, start, n_tokens, ids_crc32 (of unsigned 32-bit ids), root, verified."""
    ship(spark)
    width = spark.read.parquet(f"{path}/format").first()["width"]

    def check(batches):
        for batch in batches:
            pay, size = batch.column(1).to_pylist(), int(width[2])
            n = np.fromiter(map(len, pay), np.int64, len(pay)) // size
            sound = [digest(p) == d and len(p) % size == 0 for p, d in zip(pay, batch.column(0).to_pylist())]
            stream = b"".join(p if len(p) % size == 0 else p[: len(p) // size * size] for p in pay)
            ids, at = memoryview(np.frombuffer(stream, width).astype("<u4")), [0, *np.cumsum(n).tolist()]
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array(n.astype(np.int32)), pa.array(sound, pa.bool_())], names=["digest", "crc", "n", "sound"])

    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(lean(check), "digest binary, crc bigint, n int, sound boolean")
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("uid", F.explode("chunks").alias("c")).select("uid", "c.seq", "c.digest")
    found = refs.join(chunks, "digest", "left").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "crc", "n", "sound"))).alias("got"))

    def join_up(batches):
        for batch in batches:
            edges, parts = gathered(batch.column(1))
            seq, crc, n = (parts.field(k).fill_null(0).to_numpy() for k in ("seq", "crc", "n"))
            right = parts.field("sound").fill_null(False).to_numpy(zero_copy_only=False) & (seq == np.arange(len(seq)) - np.repeat(edges[:-1], np.diff(edges)))
            wrong, ids = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (~right, n))
            sound = wrong[edges[1:]] == wrong[edges[:-1]]
            names, at = parts.field("digest").to_pylist(), edges.tolist()
            tops = [merkle(names[a:b]) for a, b in zip(at, at[1:])]
            crcs = pa.array(crc_join(crc, n.astype(np.int64), edges), pa.int64(), mask=~sound)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[edges[1:]] - ids[edges[:-1]]), crcs, pa.array(tops, pa.binary()), pa.array(sound)], names=["uid", "n", "crc", "top", "sound"])

    found = found.select("uid", "got").mapInArrow(lean(join_up), "uid bigint, n bigint, crc bigint, top binary, sound boolean")
    # ids before each recipe file by the manifest: one row per file, as many as there are files
    before, total, lost = [], 0, []
    for p in check_parts(spark, path, recipes).orderBy("part").collect():
        before.append((p["part"], total, p["intact"]))
        if p["lost"]:
            lost.append((total, p["n_tokens"]))
        total += p["n_tokens"]
    offsets = spark.createDataFrame(before, "part int, before bigint, intact boolean")
    running = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.join(F.broadcast(offsets), "part").select("uid", "doc_id", "root", "n_tokens", "intact", (F.col("before") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0))).alias("start"))
    good = F.col("intact") & F.col("sound") & (F.col("n") == F.col("n_tokens")) & (F.col("top") == F.col("root"))
    out = placed.join(found, "uid", "left").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), F.lower(F.hex("root")).alias("root"), F.coalesce(good, F.lit(False)).alias("verified"))
    if not lost:
        return out
    gone = spark.createDataFrame(lost, "start bigint, n_tokens bigint")
    return out.unionByName(gone.withColumn("verified", F.lit(False)), allowMissingColumns=True)
