"""Keyed hashes of constant keys as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pads(key: str) -> tuple[bytes, bytes]:
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def hmac_sha256(c: Column, key: str) -> Column:
    """HMAC-SHA256 in hexadecimal; the key is constant, so that both of its pads are literals."""
    inner, outer = (F.unhex(F.lit(p.hex())) for p in _pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, c.cast("binary")), 256))), 256)


def hmac_sql(c: str, key: str) -> str:
    inner, outer = (p.hex() for p in _pads(key))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({c}))))"
