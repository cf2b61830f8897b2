"""Detection and conversion of text in a legacy Bengali font encoding.

The character table is small on purpose: text that meets the signature is
reported as detected, and comes back unchanged unless nearly all of it is in the
table."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.letters import BLOCK, CONSONANT, HASANTA, u

# Letters whose place in the font is certain, and characters that only such text is full of.
MAP = {"A": "আ", "v": "া", "w": "ি", "z": "ু", "g": "ম", "e": "ব", "s": "ং", "j": "ল", "Z": "ত"}
SIGNATURE = "‡†ÒÓ¸¯‹›„‰Œ˜™šœžŸ¡¢£¤¥¦§¨©ª«¬®°±²³´µ¶·¹º»¼½¾¿"
PRE_BASE = u("9BF 9C7 9C8")
MIN_HITS, MIN_SHARE, MIN_COVERAGE = 4, 0.08, 0.95
_SIGNS, _LETTERS = re.compile(f"[{re.escape(''.join(SIGNATURE))}]"), re.compile(f"[{BLOCK}]")
_ORDER = re.compile(f"([{PRE_BASE}])([{CONSONANT}](?:{HASANTA}[{CONSONANT}])*)")


def looks_like(text: str, min_hits: int = MIN_HITS) -> bool:
    hits = len(_SIGNS.findall(text))
    if hits < min_hits or _LETTERS.search(text):
        return False
    solid = len("".join(text.split()))
    return solid >= 4 and hits / solid >= MIN_SHARE


def coverage(text: str) -> float:
    solid = [c for c in text if not c.isspace() and not c.isdigit()]
    return sum(c in MAP for c in solid) / len(solid) if solid else 1.0


def reordered(text: str) -> str:
    """Vowel signs written before their consonants, moved after the cluster."""
    return _ORDER.sub(r"\2\1", text)


def convert(text: str) -> str:
    if coverage(text) < MIN_COVERAGE:
        return text
    return reordered(text.translate(str.maketrans(MAP)))


def _report(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for x in texts:
        x = x or ""
        found, share = looks_like(x), coverage(x)
        done = found and share >= MIN_COVERAGE
        note = "not detected" if not found else "converted" if done else "detected, not converted: coverage is too low"
        rows.append((x, found, round(share, 4), convert(x) if done else x, note))
    return pd.DataFrame(rows, columns=["text", "detected", "coverage", "converted", "note"])


def report(text: Column) -> Column:
    """A struct of what was found in a text, and its conversion."""
    return F.pandas_udf(_report, "struct<text:string,detected:boolean,coverage:double,converted:string,note:string>")(text)


def hits_column(text: Column) -> Column:
    """Signature characters, by built-ins."""
    return F.length(text) - F.length(F.translate(text, SIGNATURE, ""))
