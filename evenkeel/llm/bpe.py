"""Byte-level BPE: a minimal perfect hash over whole pre-tokens, and a heap over linked bytes for the rest.

``encode_documents`` gives one row per input row (repeated rows repeat): the ids as little-endian
unsigned 32-bit integers, and the bytes they decode to.  Null and empty texts give no ids.
Nothing is shuffled; each task holds the tables of the vocabulary and a bounded memo.
Only the columns named are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash

from .util import lean, share

MEMO = 400_000  # entries in each of the two generations of a worker's memo; results do not depend on it


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash (hash, then displace) from the vocabulary's byte strings to their ranks.

    n keys fill exactly n slots.  A slot keeps its key, so a string outside the vocabulary is told apart.
    """

    def __init__(self, ranks: dict[bytes, int]):
        n = self.n = max(1, len(ranks))
        self.buckets = n // 3 + 1
        members: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in ranks:
            h = xxhash.xxh3_64_intdigest(key)
            members[h % self.buckets].append((h >> 20, key))
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.ranks = [0] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            shift = 0
            while True:
                slots = {(h ^ shift) % n for h, _ in members[b]}
                if len(slots) == len(members[b]) and all(self.keys[s] is None for s in slots):
                    break
                shift += 0x9E3779B1
                if shift >> 56:
                    raise ValueError("no displacement found")
            self.shift[b] = shift
            for h, key in members[b]:
                slot = (h ^ shift) % n
                self.keys[slot], self.ranks[slot] = key, ranks[key]

    def get(self, key: bytes) -> int:
        """The rank of ``key``, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        slot = ((h >> 20) ^ self.shift[h % self.buckets]) % self.n
        return self.ranks[slot] if self.keys[slot] == key else -1


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """left rank << 17 | right rank -> rank of the joined bytes, for every way to cut a token into two tokens."""
    if max(ranks.values(), default=0) >> 17:
        raise ValueError("more than 131,072 ranks")
    return {ranks[t[:i]] << 17 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def merge(raw: bytes, byte: list[int], two: list[int], pair) -> list[int]:
    """Merges the linked bytes of a pre-token by a heap of adjacent pairs: least rank first, the leftmost of equals.

    ``byte`` has the rank of each byte, ``two`` that of each pair of bytes (-1: none), ``pair`` finds that of two tokens.
    """
    n = len(raw)
    own = [two[x << 8 | y] for x, y in zip(raw, raw[1:])]  # rank of the pair that begins here, now
    bits = n.bit_length()
    heap = [r << bits | i for i, r in enumerate(own) if r >= 0]
    token = [byte[x] for x in raw]
    if not heap:
        return token
    heapify(heap)
    own.append(-1)
    after, before, low = list(range(1, n + 1)), list(range(-1, n)), (1 << bits) - 1
    while heap:
        top = heappop(heap)
        i, rank = top & low, top >> bits
        if own[i] != rank:
            continue  # one side has been merged since
        j = after[i]
        k = after[i] = after[j]
        token[i], token[j], own[j] = rank, -1, -1
        if k < n:
            before[k] = i
            r = own[i] = pair(rank << 17 | token[k], -1)
            if r >= 0:
                heappush(heap, r << bits | i)
        else:
            own[i] = -1
        h = before[i]
        if h >= 0:
            r = own[h] = pair(token[h] << 17 | rank, -1)
            if r >= 0:
                heappush(heap, r << bits | h)
    return [t for t in token if t >= 0]


class Memo(dict):
    """What ``make`` gives for a key, kept in two generations of at most MEMO entries each."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key, self)
        if got is self:
            got = self.make(key)
        self[key] = got
        return got


class Codec:
    """Encodes and decodes by the ranks; a pre-token is looked up whole, and merged from its bytes if that misses."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash | None = None):
        self.table = table or PerfectHash(ranks)
        self.pair, self.byte = pair_table(ranks).get, [ranks[bytes([b])] for b in range(256)]
        self.two = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.match, self.white = regex.compile(pattern).findall, regex.compile(r"\s").match
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.spaced = Memo(self._spaced).__getitem__
        self.first = Memo(lambda chunk: b"".join(map(self._piece, self.match(chunk)))).__getitem__

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.table.get(raw)
        return array("I", [whole] if whole >= 0 else merge(raw, self.byte, self.two, self.pair)).tobytes()

    def _spaced(self, chunk: str) -> bytes | None:
        """Ids of ``chunk`` after a blank; None where white space at its edges joins it to its neighbours."""
        if chunk.isalpha():
            return self._piece(" " + chunk)
        if not chunk or self.white(chunk) or self.white(chunk[-1]):
            return None
        return b"".join(map(self._piece, self.match(" " + chunk)))

    def encode(self, text: str | None) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if first and not self.white(first[-1]):
            try:
                return self.first(first) + b"".join(list(map(self.spaced, rest)))
            except TypeError:
                pass
        return b"".join(map(self._piece, self.match(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    ranks, table, key = shared.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern, table)
    return _codecs[key]


def encode_documents(docs, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False):
    """One row per document: id, n_tokens, ids, decoded; with ``digests`` the SHA-256 of the latter two instead.

    The rank file is read on the driver and broadcast: its size is that of a vocabulary, whatever the data.
    """
    ranks = read_ranks(ranks_path)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    shared = share(docs.sparkSession, (ranks, PerfectHash(ranks), key))

    def run(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            counts, ids, raw = [], [], []
            for text in batch.column(1).to_pylist():
                own = codec.encode(text)
                back = codec.decode(own)
                counts.append(len(own) // 4)
                ids.append(hashlib.sha256(own).hexdigest() if digests else own)
                raw.append(hashlib.sha256(back).hexdigest() if digests else back)
            kind = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, kind), pa.array(raw, kind)], names=names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = "string" if digests else "binary"
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), f"doc_id {id_type}, n_tokens bigint, {names[2]} {kind}, {names[3]} {kind}")
