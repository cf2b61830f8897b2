"""Classes of Bengali letters, by code points, since some spellings look alike."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def u(codes: str) -> str:
    """Characters by their code points, a-b for a range as in a regular expression."""
    return "".join("-".join(chr(int(x, 16)) for x in c.split("-")) for c in codes.split())


# Ranges of the Bengali block.
HASANTA, NUKTA_SIGN, CHANDRABINDU, ANUSVARA, VISARGA = u("9CD"), u("9BC"), u("981"), u("982"), u("983")
INDEPENDENT = u("985-98C 98F 990 993 994 9E0 9E1")
CONSONANT = u("995-9A8 9AA-9B0 9B2 9B6-9B9 9CE 9DC 9DD 9DF 9F0 9F1")
SIGN = u("9BE-9C4 9C7 9C8 9CB 9CC 9D7 9E2 9E3")
DEPENDENT = SIGN + u("981-983 9BC 9CD")
BLOCK = u("980-9FF")
DANDA, DOUBLE_DANDA = u("964"), u("965")


def expanded(ranges: str) -> str:
    """The characters of a class written as in a regular expression."""
    out, i = [], 0
    while i < len(ranges):
        if i + 2 < len(ranges) and ranges[i + 1] == "-":
            out += map(chr, range(ord(ranges[i]), ord(ranges[i + 2]) + 1))
            i += 3
        else:
            out.append(ranges[i])
            i += 1
    return "".join(out)


_DEPENDENT, _LETTER, _SIGN = frozenset(expanded(DEPENDENT)), frozenset(expanded(CONSONANT + INDEPENDENT)), frozenset(expanded(SIGN + INDEPENDENT))


@lru_cache(maxsize=1)
def _one_for_one() -> tuple[str, str]:
    """Letters that have an upper form of one letter, and these forms: where the full form has several, the title form or, of sharp s, U+1E9E."""
    pairs = {c: next((x for x in (c.upper(), c.title()) if len(x) == 1), c) for c in map(chr, range(sys.maxunicode + 1)) if c.upper() != c or c.title() != c}
    pairs[u("DF")] = u("1E9E")
    pairs = {c: x for c, x in pairs.items() if c != x}
    return "".join(pairs), "".join(pairs.values())


def upper_by_letter(text: Column) -> Column:
    """text in capitals, each letter for itself, so that its length stays; upper() makes two letters of a sharp s."""
    return F.translate(text, *_one_for_one())


def is_bengali(c: str) -> bool:
    return 0x980 <= ord(c) <= 0x9FF


def is_letter(c: str) -> bool:
    return c in _LETTER


def is_dependent(c: str) -> bool:
    return c in _DEPENDENT


def vowel_final(word: str) -> bool:
    return bool(word) and word[-1] in _SIGN


def has_letter(word: str) -> bool:
    return not _LETTER.isdisjoint(word)


def has_any_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def lettered(script: str) -> Callable[[str], bool]:
    """Whether a word has a letter of the script; of any, for scripts without classes here."""
    return has_letter if script == "bengali" else has_any_letter


def has_letter_column(text: Column) -> Column:
    return text.rlike(f"[{CONSONANT}{INDEPENDENT}]")


def vowel_final_column(text: Column) -> Column:
    return text.rlike(f"[{SIGN}{INDEPENDENT}]\\z")
