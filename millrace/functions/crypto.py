"""Column encryption and short digests."""

from __future__ import annotations

import base64
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F


def _one_line(c: Column) -> Column:
    return F.translate(c, "\r\n", "")


def encrypted(text: Column, key: Column) -> Column:
    """base64 of nonce, ciphertext and tag, by AES-256-GCM; ``key`` is base64 of 32 bytes."""
    return _one_line(F.base64(F.aes_encrypt(text.cast("binary"), F.unbase64(key), F.lit("GCM"))))


def decrypted(content: Column, key: Column) -> Column:
    """The text, or null where anything is wrong with content or key."""
    raw = F.try_to_binary(content, F.lit("base64"))
    return F.try_aes_decrypt(raw, F.unbase64(key), F.lit("GCM")).cast("string")


def short_digest(text: Column) -> Column:
    """The first ten characters of the URL-safe base64 of a SHA-256."""
    return F.substring(F.translate(_one_line(F.base64(F.unhex(F.sha2(text, 256)))), "+/=", "-_"), 1, 10)


def new_key() -> str:
    """32 random bytes of the system's generator as base64, made on the driver; store it at once."""
    return base64.b64encode(secrets.token_bytes(32)).decode()


#: Fixed values of the codes.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def code(length: int = 6) -> Column:
    """Random letters and digits, 62 symbols a place; differs for every row and evaluation."""
    place = lambda: F.substr(F.lit(SYMBOLS), F.floor(F.rand(secrets.randbits(31)) * len(SYMBOLS)).cast("int") + 1, F.lit(1))
    return F.concat(*[place() for _ in range(length)])
