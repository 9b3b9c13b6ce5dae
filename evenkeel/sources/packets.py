"""Artifact packets: small payload files and a manifest, written last, with sizes and SHA-256 digests."""

from __future__ import annotations

import hashlib
import os
import tempfile
from pathlib import Path

from ..functions.canonical import domain_digest, encode
from .bounded import parse

MOST_FILES, MOST_BYTES, MOST_TOTAL = 64, 64 << 20, 256 << 20


def write(target: str, payloads: dict[str, bytes]) -> str:
    """Publishes the packet by one rename; an existing target is an error.  Returns the manifest's digest."""
    if os.path.lexists(target):
        raise FileExistsError(target)
    if not 0 < len(payloads) <= MOST_FILES or any(len(b) > MOST_BYTES for b in payloads.values()) or sum(map(len, payloads.values())) > MOST_TOTAL:
        raise ValueError("too many files or bytes")
    if any(Path(n).name != n or n in ("", ".", "..", "manifest.json") for n in payloads):
        raise ValueError("a payload needs a plain file name")
    files = [{"bytes": len(b), "name": n, "sha256": hashlib.sha256(b).hexdigest()} for n, b in sorted(payloads.items())]
    manifest = {"files": files, "packetDigest": domain_digest("evenkeel/packet/1", files)}
    temporary = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(target)), prefix=".packet-")
    for name, body in payloads.items():
        Path(temporary, name).write_bytes(body)
    Path(temporary, "manifest.json").write_text(encode(manifest))
    os.rename(temporary, target)
    return domain_digest("evenkeel/manifest/1", manifest)


def verify(target: str, pinned: str | None = None) -> dict[str, bytes]:
    """The payloads, if they are just those of the manifest and, where given, the manifest has the pinned digest."""
    manifest = parse(Path(target, "manifest.json").read_bytes())
    if pinned and domain_digest("evenkeel/manifest/1", manifest) != pinned:
        raise ValueError("manifest-digest")
    if domain_digest("evenkeel/packet/1", manifest["files"]) != manifest["packetDigest"]:
        raise ValueError("packet-digest")
    if sorted(os.listdir(target)) != sorted([*(f["name"] for f in manifest["files"]), "manifest.json"]):
        raise ValueError("file-list")
    out = {}
    for f in manifest["files"]:
        body = Path(target, f["name"]).read_bytes()
        if len(body) != f["bytes"] or hashlib.sha256(body).hexdigest() != f["sha256"]:
            raise ValueError("file-digest")
        out[f["name"]] = body
    return out
