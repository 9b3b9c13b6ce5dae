"""Canonical JSON (RFC 8785) and domain digests for driver-side contracts; bulk rows use ``sampling.canonical_strings``."""

from __future__ import annotations

import hashlib
import json
import math
from decimal import Decimal

SAFE = 2**53 - 1


def number(x: float | int) -> str:
    """A number as ECMAScript writes it: the shortest digits, an exponent from 1e21 on and below 1e-6."""
    if isinstance(x, int):
        if abs(x) > SAFE:
            raise ValueError("integer beyond 2^53 - 1")
        return str(x)
    if not math.isfinite(x):
        raise ValueError("number is not finite")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        body = text + "0" * (point - len(text)) if len(text) <= point else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + text
    else:
        power = point - 1
        body = text[0] + (f".{text[1:]}" if len(text) > 1 else "") + f"e{'+' if power > 0 else '-'}{abs(power)}"
    return "-" * sign + body


def encode(value) -> str:
    """Canonical JSON: keys in UTF-16 order, no blanks; lone surrogates and numbers that are not finite are errors."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, str):
        value.encode("utf-8")  # raises for a lone surrogate
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(encode, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{encode(k)}:{encode(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    raise TypeError(type(value).__name__)


def domain_digest(domain: str, value) -> str:
    return "sha256:" + hashlib.sha256(encode({"domain": domain, "value": value}).encode()).hexdigest()
