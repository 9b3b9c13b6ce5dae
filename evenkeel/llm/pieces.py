"""SentencePiece BPE that keeps offsets: every piece is projected to the bytes of the text that it came from.

A text is normalised from left to right: at each place the longest prefix that the model's compiled character map (a double
array) knows is replaced, any other character stays as it is, and each byte of the outcome records at which byte of the text
its source began.  Spaces become U+2581.  The pieces are found by a heap over linked symbols: best score first, the leftmost
of equals.  Their normalised lengths, summed up, point into the record, which gives each piece's span.

``encode_documents`` gives one row per input row (repeated rows repeat).  A null text is empty; an empty text, and a
text of white space only where the model drops it, has the end id only.  Texts are taken whole.  An empty table gives no rows.
Nothing is shuffled, and only the two columns named are read, so further columns of any name do not matter.
Models: BPE with byte fallback, without user-defined or unused pieces (others raise ValueError); under 131,071 pieces and characters.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections import Counter
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa

from .util import lean, share

SPACE = "▁"
NONE, NO_CODE = 1 << 60, 0x1FFFF  # no pair; the code of characters of no piece, which makes no pair
LONG, ROWS = 32, 16_384  # symbols of a chunk that is merged beside others, and how many at once
MEMO = 500_000  # chunks in each of the two generations of a worker's memo; results do not depend on it
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces


def fields(raw: bytes):
    """(number, value) of each field of a protocol-buffer message: an int, a float's 4 bytes, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, raw[at : at + size]
        at += size


@dataclass
class Model:
    """What of a model file decides about ids."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1
    charsmap: bytes = b""
    dummy_prefix: bool = True
    drop_extra_spaces: bool = True
    escape_spaces: bool = True
    suffix: bool = False
    end_id: int = 2

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        own = cls()
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                own.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
                own.kind, own.suffix, own.end_id = trainer.get(3, 1), bool(trainer.get(24, 0)), trainer.get(42, 2)
            elif number == 3:
                spec = dict(fields(value))
                own.charsmap = spec.get(2, b"")
                own.dummy_prefix, own.drop_extra_spaces, own.escape_spaces = (bool(spec.get(i, 1)) for i in (3, 4, 5))
        return own


class CharMap:
    """The compiled character map: a double array over byte strings, whose values point at the replacements."""

    def __init__(self, raw: bytes):
        (size,) = struct.unpack_from("<I", raw)
        self.units, self.texts = struct.unpack_from(f"<{size // 4}I", raw, 4), raw[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes taken) of the longest prefix of ``text`` from ``at`` on that the map knows."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit & 256:
                start = units[node] & 0x7FFFFFFF
                found = self.texts[start : self.texts.index(b"\0", start)], i + 1 - at
        return found


class Normalizer:
    """Normalised text, and for each of its bytes (and its end) the byte of the text where its source began."""

    def __init__(self, model: Model):
        self.map = CharMap(model.charsmap) if model.charsmap else None
        self.prefix, self.drop, self.escape, self.suffix = model.dummy_prefix, model.drop_extra_spaces, model.escape_spaces, model.suffix
        self.plain = self.map is None and not self.drop and self.escape and not self.suffix

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        return self._plain(text, raw) if self.plain else self._mapped(raw)

    def _plain(self, text: str, raw: bytes) -> tuple[str, np.ndarray]:
        """Characters stand for themselves: all at once."""
        own = np.frombuffer(raw, np.uint8)
        begins = np.maximum.accumulate(np.where(own & 0xC0 == 0x80, 0, np.arange(len(own))))
        source = np.repeat(begins, np.where(own == 32, 3, 1))
        head = [np.zeros(3, np.int64)] if self.prefix else []
        return SPACE * self.prefix + text.replace(" ", SPACE), np.concatenate([*head, source, [len(own)]])

    def _prefix(self, raw: bytes, at: int) -> tuple[bytes, int]:
        found = self.map and self.map.longest(raw, at)
        if found:
            return found
        first = raw[at]
        size = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return raw[at : at + size], size

    def _mapped(self, raw: bytes) -> tuple[str, np.ndarray]:
        at, out, source = 0, bytearray(), []
        space = SPACE.encode() if self.escape else b" "
        while self.drop and at < len(raw):
            got, size = self._prefix(raw, at)
            if got != b" ":
                break
            at += size
        if at == len(raw):
            return "", np.zeros(1, np.int64)

        def add(data: bytes, begin: int) -> None:
            out.extend(data)
            source.extend([begin] * len(data))

        if self.prefix and not self.suffix:
            add(space, at)
        spaced = self.drop
        while at < len(raw):
            got, size = self._prefix(raw, at)
            if spaced:
                got = got.lstrip(b" ")
            if got:
                add(got.replace(b" ", space), at)
                spaced = self.drop and got.endswith(b" ")
            at += size
        end = at
        while self.drop and out.endswith(space):
            end = source[len(out) - len(space)]
            del out[len(out) - len(space) :], source[len(out) :]
        if self.prefix and self.suffix:
            add(space, end)
        return out.decode(), np.array([*source, end], np.int64)


class Codec:
    """Ids and spans of texts, and texts of ids."""

    def __init__(self, model: Model):
        self.normalize, self.end_id = Normalizer(model), model.end_id
        self.strip = model.dummy_prefix or model.drop_extra_spaces
        self.strip_all = model.drop_extra_spaces
        kinds = {k for _, _, k in model.pieces}
        self.bytes_of_id = {i: int(p[3:5], 16) for i, (p, _, k) in enumerate(model.pieces) if k == BYTE}
        self.byte_ids = {b: i for i, b in self.bytes_of_id.items()}
        if model.kind != 2 or len(self.byte_ids) != 256 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("not a BPE model with byte fallback and without user-defined or unused pieces")
        normal = {p: i for i, (p, _, k) in enumerate(model.pieces) if k == NORMAL}
        self.n = len(model.pieces)
        codes = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):  # characters of pieces that are none themselves
            codes[c] = len(codes) + self.n
        if max(codes.values(), default=0) >= NO_CODE:
            raise ValueError("131,071 pieces and characters or more")
        self.code_of = np.full(0x110000, NO_CODE, np.int32)
        for c, i in codes.items():
            if len(c) == 1:
                self.code_of[ord(c)] = i
        scores = Counter(s for _, s, k in model.pieces if k == NORMAL)
        place = {s: r for r, s in enumerate(sorted(scores, reverse=True))}
        self.tied = np.array([scores[s] > 1 for s in place] or [False])
        made = {i: place[model.pieces[i][1]] << 17 | i for i in normal.values()}  # place by score, then the id
        self.pair = {codes[p[:j]] << 17 | codes[p[j:]]: made[i] for p, i in normal.items() for j in range(1, len(p)) if p[:j] in codes and p[j:] in codes}
        self.pair_keys, self.pair_made = (np.array([*x, last], np.int64) for x, last in zip(zip(*sorted(self.pair.items())) if self.pair else ((), ()), (1 << 40, NONE)))
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) if k == NORMAL else 0 for p, _, k in model.pieces], np.int64)
        self.texts = [bytes([self.bytes_of_id[i]]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else b"" if k == CONTROL else " ⁇ ".encode() for i, (p, _, k) in enumerate(model.pieces)]
        self.silent = frozenset(i for i, (_, _, k) in enumerate(model.pieces) if k == CONTROL)
        self.normal = [k == NORMAL for _, _, k in model.pieces]
        self.names = [str(i).encode() for i in range(self.n)]
        self.chunks = self._chunks(normal)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _chunks(normal):
        """Cuts normalised text where no piece can reach across: before U+2581, and between a letter and some marks."""
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            return lambda text: [text]
        inner = {b for p in normal for a, b in zip(p, p[1:]) if a.isascii() and a.isalpha()}
        marks = "".join(c for c in "\n,.;:!?\"'()-" if c not in inner)
        edge = f"(?=[{re.escape(marks + SPACE)}]|\\Z)"
        return re.compile(f"{SPACE}*[A-Za-z]++{edge}|{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def learn(self, chunks) -> None:
        """Puts the ids of chunks that the memo lacks into it."""
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        new: dict[int, list[str]] = {}
        for chunk in set(chunks).difference(self.memo):
            ids = self.old.get(chunk)
            if ids is None and len(chunk) <= LONG:
                new.setdefault((len(chunk) + 7) // 8 * 8, []).append(chunk)
            else:
                self.memo[chunk] = ids or self._merge_linked(chunk)
        for width, own in new.items():
            for i in range(0, len(own), ROWS):
                self._merge_rows(own[i : i + ROWS], width)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 17 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], NONE)

    def _merge_rows(self, chunks: list[str], width: int) -> None:
        """Many chunks at once, a row of linked symbols each; a round merges every row's best pair.

        Each row has an empty column on either side.  Rows with unknown characters or with pieces of equal scores are merged alone.
        """
        n, wide = len(chunks), width + 2
        sizes = np.fromiter(map(len, chunks), np.int64, n)
        token = np.full((n, wide), NO_CODE, np.int32)
        inside = np.arange(wide) - 1 < sizes[:, None]
        inside[:, 0] = False
        token[inside] = self.code_of[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        odd = (inside & (token >= self.n)).any(axis=1)
        best = np.full((n, wide), NONE)
        best[:, 1:-1] = self._pairs(token[:, 1:-1], token[:, 2:])
        after, before = (np.tile(np.arange(wide, dtype=np.int32) + d, n) for d in (1, -1))
        token, dead, flat = token.ravel(), ~inside.ravel(), best.ravel()
        rows = np.flatnonzero(~odd)
        while len(rows):
            at = best[rows].argmin(axis=1)
            i = rows * wide + at
            made = flat[i]
            equal = (made != NONE) & self.tied[np.minimum(made >> 17, len(self.tied) - 1)]
            odd[rows[equal]] = True
            left = (made != NONE) & ~equal
            rows, i, made = rows[left], i[left], made[left] & NO_CODE
            base = rows * wide
            j = base + after[i]
            k = base + after[j]
            h = base + before[i]
            token[i], dead[j], flat[j] = made, True, NONE
            after[i], before[k] = after[j], i - base
            flat[i] = self._pairs(made, token[k])
            flat[h] = self._pairs(token[h], made)
        kept = ~dead.reshape(n, wide)
        ends = np.cumsum(kept.sum(axis=1)) * 4
        raw = token[kept.ravel()].astype(np.uint32).tobytes()
        self.memo.update(zip(chunks, map(raw.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist()))))
        for r in np.flatnonzero(odd).tolist():
            self.memo[chunks[r]] = self._merge_linked(chunks[r])

    def _merge_linked(self, text: str) -> bytes:
        """The ids of a chunk: the adjacent pair of the best score is merged, the leftmost of equals, by a heap over linked symbols."""
        n, pair = len(text), self.pair.get
        token = self.code_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tolist()
        own = [pair(a << 17 | b, NONE) for a, b in zip(token, token[1:])]
        own.append(NONE)
        bits = n.bit_length()
        heap = [p >> 17 << bits | i for i, p in enumerate(own) if p != NONE]
        heapify(heap)
        after, before, low = list(range(1, n + 1)), list(range(-1, n)), (1 << bits) - 1
        dead = [False] * n
        while heap:
            top = heappop(heap)
            i = top & low
            if own[i] >> 17 != top >> bits:
                continue  # one side has been merged since
            j = after[i]
            k = after[i] = after[j]
            made = token[i] = own[i] & NO_CODE
            own[i], own[j], dead[j] = NONE, NONE, True
            if k < n:
                before[k] = i
                own[i] = pair(made << 17 | token[k], NONE)
                if own[i] != NONE:
                    heappush(heap, own[i] >> 17 << bits | i)
            h = before[i]
            if h >= 0:
                own[h] = pair(token[h] << 17 | made, NONE)
                if own[h] != NONE:
                    heappush(heap, own[h] >> 17 << bits | h)
        out = []
        for c, t, gone in zip(text, token, dead):
            if not gone:
                out.extend([t] if t < self.n else map(self.byte_ids.__getitem__, c.encode()))
        return array("I", out).tobytes()

    def encode(self, texts: list[str]):
        """(ids without the end id, their spans) of each text; a span is (begin, end) in bytes of the text."""
        normal, sources = zip(*map(self.normalize, texts)) if texts else ((), ())
        cut = list(map(self.chunks, normal))
        self.learn(chain.from_iterable(cut))
        for chunks, source in zip(cut, sources):
            ids = np.frombuffer(b"".join(map(self.memo.__getitem__, chunks)), np.uint32)
            sizes = self.sizes[ids]
            ends = np.cumsum(sizes)
            spans = np.empty((len(ids), 2), np.uint32)
            spans[:, 1] = source[ends]
            spans[:, 0] = source[ends - sizes]
            yield ids, spans

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids: control ids are silent, the first piece's leading space is the prefix."""
        raw = list(map(self.texts.__getitem__, ids))
        if self.strip:
            for i, part in enumerate(raw):
                if part and not self.normal[ids[i]]:
                    break
                if part.startswith(b" "):
                    raw[i] = part[1:]
                    if not self.strip_all or raw[i]:
                        break
                elif part:
                    break
        if self.silent.isdisjoint(ids[:-1]):
            return _mend(b"".join(raw))
        runs = [[]]  # a control id also ends a run of bytes
        for i, part in zip(ids, raw):
            runs.append([]) if i in self.silent else runs[-1].append(part)
        return b"".join(_mend(b"".join(run)) for run in runs)


def _mend(raw: bytes) -> bytes:
    """Every byte that is in no valid character becomes U+FFFD."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode().encode())
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


_codecs: dict[str, Codec] = {}


def encode_documents(docs, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False):
    """One row per document: id, n_tokens (with the end id), ids, spans (begin and end byte of each piece but the end), decoded.

    Ids and spans are little-endian unsigned 32-bit integers, decoded is text.  With ``digests`` the SHA-256 of each (ids in
    decimal, joined by one space), and covered: whether the spans, end to end, give the whole text.
    The model file is read on the driver and broadcast: its size is that of a vocabulary, whatever the data.
    """
    with open(model_path, "rb") as f:
        raw = f.read()
    Codec(Model.parse(raw))  # a model of another kind raises here
    shared = share(docs.sparkSession, (raw, hashlib.sha256(raw).hexdigest()))

    def run(batches):
        raw, key = shared.value
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = Codec(Model.parse(raw))
        codec = _codecs[key]
        hexed = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for text, (ids, spans) in zip(texts, codec.encode(texts)):
                own = [*ids.tolist(), codec.end_id]
                back = codec.decode(own)
                if digests:
                    flat = spans.ravel()
                    whole = not len(flat) or flat[0] == 0 and flat[-1] == len(text.encode()) and bool((flat[1:-1:2] == flat[2::2]).all())
                    row = (len(own), hexed(b" ".join(map(codec.names.__getitem__, own))), hexed(back), hexed(spans.tobytes()), bool(whole))
                else:
                    row = (len(own), np.array(own, "<u4").tobytes(), spans.tobytes(), back.decode())
                for kept, value in zip(out, row):
                    kept.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, (_, _, k) in zip(out, columns))], names=["doc_id", *(c for c, _, _ in columns)])

    text, binary = ("string", pa.string()), ("binary", pa.binary())
    columns = [("n_tokens", "bigint", pa.int64())]
    if digests:
        columns += [("ids_sha256", *text), ("decoded_sha256", *text), ("spans_sha256", *text), ("covered", "boolean", pa.bool_())]
    else:
        columns += [("ids", *binary), ("spans", *binary), ("decoded", *text)]
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{c} {kind}" for c, kind, _ in columns)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), schema)
