"""Value encryption: AES-256-GCM under a key derived by HKDF-SHA256 from a master key and a random salt for each value.

A token is ``ENC:v1:`` and three base-64 parts: salt, IV, ciphertext with tag. The type and position of a value are
authenticated with it, so a token can't be moved to another place. Values without the prefix pass decryption as they are.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "ENC:v1:"
INFO = b"tamis-value"
SALT_BYTES, IV_BYTES, BLOCK = 32, 12, 64


def _xor(data: Column, byte: int, n: int) -> Column:
    """The first n bytes of a binary, each xor a byte, missing ones as zero."""
    hexed = F.rpad(F.hex(data), 2 * n, "0")
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lpad(F.hex(F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(byte))), 2, "0"))
    return F.unhex(F.array_join(parts, ""))


def hmac_sha256(key: Column, message: Column) -> Column:
    """RFC 2104 for keys of at most 64 bytes."""
    inner = F.unhex(F.sha2(F.concat(_xor(key, 0x36, BLOCK), message), 256))
    return F.unhex(F.sha2(F.concat(_xor(key, 0x5C, BLOCK), inner), 256))


def derived_key(master: bytes, salt: Column) -> Column:
    """RFC 5869: one block of HKDF-SHA256, 32 bytes."""
    extracted = hmac_sha256(salt, F.lit(master))
    return hmac_sha256(extracted, F.lit(INFO + b"\x01"))


def _aad(pii_type: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("|", pii_type, start.cast("string"), end.cast("string"))


def encrypt(value: Column, pii_type: Column, start: Column, end: Column, master: bytes, salt: Column, iv: Column) -> Column:
    """The token of a value. Salt (32 bytes) and IV (12 bytes) have to be fresh for each; null stays null."""
    sealed = F.aes_encrypt(value.cast("binary"), derived_key(master, salt), F.lit("GCM"), F.lit("DEFAULT"), iv, _aad(pii_type, start, end).cast("binary"))
    body = F.substr(sealed, F.lit(IV_BYTES + 1))
    return F.when(value.isNotNull(), F.concat(F.lit(PREFIX), F.concat_ws(":", F.base64(salt), F.base64(iv), F.base64(body))))


def random_bytes(n: int) -> Column:
    """Fresh bytes of version 4 UUIDs, hashed."""
    return F.substring(F.unhex(F.sha2(F.concat(F.uuid(), F.uuid(), F.uuid()), 256)), 1, n)


def decrypt(token: Column, pii_type: Column, start: Column, end: Column, master: bytes) -> Column:
    """The value of a token; null if it was changed or moved."""
    part = lambda i: F.unbase64(F.get(F.split(F.substr(token, F.lit(len(PREFIX) + 1)), ":"), F.lit(i)))
    opened = F.try_aes_decrypt(F.concat(part(1), part(2)), derived_key(master, part(0)), F.lit("GCM"), F.lit("DEFAULT"), _aad(pii_type, start, end).cast("binary"))
    return F.when(token.startswith(PREFIX), opened.cast("string")).otherwise(token)


def master_key(text: str) -> bytes:
    """A key of 32 bytes in base 64."""
    key = base64.b64decode(text)
    if len(key) != 32:
        raise ValueError("the master key has to have 32 bytes")
    return key
