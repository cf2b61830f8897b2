"""Identifiers: time-ordered ids and recovery phrases."""

from __future__ import annotations

import hashlib
import hmac
import secrets
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 12
#: Sixteen beginnings and sixteen endings make the 256 words of a phrase.
_HEADS = "ba be bi bo da de di do ka ke ki ko ma me mi mo".split()
_TAILS = "la le li lo na ne ni no ra re ri ro sa se si so".split()


def word(byte: int) -> str:
    return _HEADS[byte >> 4] + _TAILS[byte & 15]


_BYTE = {word(b): b for b in range(256)}


def uuid7(now_ms: int | None = None) -> str:
    """48 bits of milliseconds, then version, variant and random bits."""
    ms = time.time_ns() // 1_000_000 if now_ms is None else now_ms
    value = (ms & ((1 << 48) - 1)) << 80 | 7 << 76 | secrets.randbits(12) << 64 | 2 << 62 | secrets.randbits(62)
    h = f"{value:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def uuid7_millis(uuid: Column) -> Column:
    return F.conv(F.substring(F.replace(uuid, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")


def phrase(entropy: bytes | None = None) -> str:
    """Eleven random bytes and the first of their SHA-256, a word each."""
    raw = secrets.token_bytes(WORDS - 1) if entropy is None else entropy
    if len(raw) != WORDS - 1:
        raise ValueError(f"{WORDS - 1} bytes make a phrase")
    return " ".join(word(b) for b in raw + hashlib.sha256(raw).digest()[:1])


def parsed(text: str) -> bytes:
    """The random bytes of a phrase; a wrong count, word or checksum raises ValueError."""
    words = text.lower().replace(",", " ").split()
    if len(words) != WORDS:
        raise ValueError(f"a phrase has {WORDS} words")
    if unknown := [w for w in words if w not in _BYTE]:
        raise ValueError(f"no such word: {unknown[0]}")
    raw = bytes(_BYTE[w] for w in words)
    if hashlib.sha256(raw[:-1]).digest()[0] != raw[-1]:
        raise ValueError("the words don't belong together")
    return raw[:-1]


def digest(text: str, pepper: bytes) -> str:
    return hmac.new(pepper, parsed(text), hashlib.sha256).hexdigest()


def verified(text: str, pepper: bytes, known: str) -> bool:
    return hmac.compare_digest(digest(text, pepper), known)
