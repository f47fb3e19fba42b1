"""Fingerprints and vault values as column expressions.

Keys become literals of the plan, so a plan that holds them must not be logged; pass keys from a secret store.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


class MissingKey(ValueError):
    """No encryption key: storing a value that anyone could decrypt is refused."""


def fingerprint(value: Column, key: bytes) -> Column:
    """Keyed SHA-256 (HMAC) of a value, as hex."""
    block = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def _cipher_key(secret: bytes) -> Column:
    if not secret:
        raise MissingKey("an encryption key is required")
    return F.lit(bytearray(hashlib.sha256(secret).digest()))


def encrypt(value: Column, secret: bytes) -> Column:
    """AES-256-GCM, base64 of nonce, ciphertext and tag. Each call draws a fresh nonce."""
    return F.base64(F.aes_encrypt(F.encode(value, "UTF-8"), _cipher_key(secret), F.lit("GCM")))


def decrypt(stored: Column, secret: bytes) -> Column:
    """Clear text, or NULL for a row that cannot be decrypted."""
    is_base64 = stored.rlike(r"\A[A-Za-z0-9+/\r\n]*={0,2}\z")
    data = F.when(is_base64, F.unbase64(stored))
    long_enough = F.when(F.octet_length(data) >= 28, data)
    return F.decode(F.try_aes_decrypt(long_enough, _cipher_key(secret), F.lit("GCM")), "UTF-8")
