"""Keyed identities: HMAC-SHA256 in Spark expressions, Ed25519 (RFC 8032) in Arrow batches."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, functions as F

LEAST_KEY = 32  # bytes of a key


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lowercase hex of HMAC-SHA256 over a binary column; the key is the driver's and not shorter than 32 bytes."""
    if len(key) < LEAST_KEY:
        raise ValueError("key is shorter than 32 bytes")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def payload_identity(key: bytes, domain: str, study: str, key_id: str, payload: Column) -> Column:
    """HMAC over domain, study, NUL, key id, NUL and the payload's bytes; null for a null payload."""
    head = f"{domain}{study}\0{key_id}\0".encode()
    return hmac_sha256(key, F.concat(F.lit(bytearray(head)), payload))


_P = 2**255 - 19
_ORDER = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_ROOT = pow(2, (_P - 1) // 4, _P)  # a square root of -1


def _recover(y: int, odd: int) -> int | None:
    """The x of a point on the curve by its y and the last bit of x."""
    if y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * _ROOT % _P
    if (x * x - square) % _P or (x == 0 and odd):
        return None
    return x if x & 1 == odd else _P - x


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _multiply(n: int, p):
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p, n = _add(p, p), n >> 1
    return out


_Y = 4 * pow(5, -1, _P) % _P
_X = _recover(_Y, 0)
_BASE = (_X, _Y, 1, _X * _Y % _P)


def _pack(p) -> bytes:
    inverse = pow(p[2], -1, _P)
    x, y = p[0] * inverse % _P, p[1] * inverse % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes):
    whole = int.from_bytes(raw, "little")
    y = whole & (1 << 255) - 1
    x = _recover(y, whole >> 255)
    return None if x is None else (x, y, 1, x * y % _P)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    raw = hashlib.sha512(seed).digest()
    return int.from_bytes(raw[:32], "little") & (1 << 254) - 8 | 1 << 254, raw[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_multiply(_secret(seed)[0], _BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    scalar, prefix = _secret(seed)
    key, nonce = _pack(_multiply(scalar, _BASE)), _hash(prefix, message) % _ORDER
    point = _pack(_multiply(nonce, _BASE))
    return point + ((nonce + _hash(point, key, message) * scalar) % _ORDER).to_bytes(32, "little")


def verify(key: bytes | None, message: bytes | None, signature: bytes | None) -> bool:
    """Whether the signature holds; false for nulls, wrong lengths, points off the curve and a scalar beyond the order."""
    if key is None or message is None or signature is None or len(key) != 32 or len(signature) != 64:
        return False
    own, point, scalar = _unpack(key), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if own is None or point is None or scalar >= _ORDER:
        return False
    right = _add(point, _multiply(_hash(signature[:32], key, message) % _ORDER, own))
    return _pack(_multiply(scalar, _BASE)) == _pack(right)


def ed25519_verify(key: Column, message: Column, signature: Column) -> Column:
    """``verify`` over binary columns, by Arrow batches; the same triple in a batch is checked once."""

    @F.pandas_udf("boolean")
    def check(k: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for triple in zip(k, m, s):
            if triple not in seen:
                seen[triple] = verify(*triple)
            out.append(seen[triple])
        return pd.Series(out, dtype=bool)

    return check(key, message, signature)
