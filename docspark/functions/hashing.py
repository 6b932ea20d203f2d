"""Hash-based expressions built from the native digests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """Name-based UUID, version 5, from SHA-1 of namespace bytes and name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + 8))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def hmac_sha256(payload: Column, secret: bytes) -> Column:
    """Hex HMAC-SHA256; the padded keys are literals, so only two digests run per row."""
    import hashlib

    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in key).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in key).hex()))
    first = F.sha2(F.concat(inner, payload.cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def md5_mod(c: Column, modulus: int = 10_000) -> Column:
    """The 128-bit MD5 value modulo a small number, summed over 16-bit pieces."""
    h = F.md5(c.cast("binary"))
    total = F.lit(0).cast("long")
    for i in range(8):
        weight = pow(65536, 7 - i, modulus)
        piece = F.conv(F.substring(h, 1 + 4 * i, 4), 16, 10).cast("long")
        total = total + piece * F.lit(weight)
    return total % modulus


def dedup_key(uri: Column, checksum: Column) -> Column:
    return F.sha2(F.concat(uri, F.lit(":"), checksum), 256)
