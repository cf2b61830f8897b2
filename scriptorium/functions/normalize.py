"""Unicode normalisation of Bengali text with an offset map, and spans mapped back.

Passes run in a fixed order, each giving the new text and its changes, over which the
map of breakpoints is carried; a pass that changes nothing isn't reported. The map gives
the place in the submitted text of each character, and the length of the submitted text
for the end.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import bijoy
from scriptorium.functions.letters import HASANTA, is_dependent, u
from scriptorium.functions.offsets import OFFSETS_DDL, Change, Offsets
from scriptorium.functions.pieces import of_series

# Code points of each pass.
INVISIBLE = u("200B 200E 200F 2060 FEFF AD")
SPACE_LIKE = u("A0 1680 2000 2001 2002 2003 2004 2005 2006 2007 2008 2009 200A 202F 205F 3000 9")
ZWJ, ZWNJ = u("200D"), u("200C")
KHANDA_TA = {u("9A4 9CD 200D"): u("9CE"), u("9CE 9CD"): u("9CE")}
NUKTA = {u("9A1 9BC"): u("9DC"), u("9A2 9BC"): u("9DD"), u("9AF 9BC"): u("9DF")}
VOWEL_SIGNS = {u("9C7 9BE"): u("9CB"), u("9BE 9C7"): u("9CB"), u("9C7 9D7"): u("9CC"), u("9D7 9C7"): u("9CC")}
PUNCTUATION = {u("2018"): "'", u("2019"): "'", u("201C"): '"', u("201D"): '"', u("2013"): "-", u("2014"): "-", u("2026"): "..."}
DIGITS = {chr(0x09E6 + i): str(i) for i in range(10)}

Changed = tuple[str, list[Change]]


def substituted(text: str, pattern: re.Pattern, table: dict[str, str]) -> Changed:
    """Left to right, longest source first; what replaces a source comes from its first character."""
    changes = [(m.start(), m.end(), (0,) * len(table[m.group()])) for m in pattern.finditer(text)]
    return (pattern.sub(lambda m: table[m.group()], text), changes) if changes else (text, [])


def dropped(text: str, pattern: re.Pattern) -> Changed:
    """Without the characters that match, one at a time."""
    changes: list[Change] = [(m.start(), m.end(), ()) for m in pattern.finditer(text)]
    return (pattern.sub("", text), changes) if changes else (text, [])


def clusters(text: str) -> list[tuple[int, int]]:
    """Spans of a base with what depends on it; a hasanta binds the next letter."""
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        bound = is_dependent(c) or unicodedata.combining(c) or (i and text[i - 1] == HASANTA and c.isalpha())
        if spans and bound:
            spans[-1] = (spans[-1][0], i + 1)
        else:
            spans.append((i, i + 1))
    return spans


def composed(text: str) -> Changed:
    """NFC by cluster; a cluster that changes keeps its places in order, the first for what is new."""
    if unicodedata.is_normalized("NFC", text):
        return text, []
    out, changes = [], []
    for a, b in clusters(text):
        new = unicodedata.normalize("NFC", text[a:b])
        out.append(new)
        if new != text[a:b]:
            changes.append((a, b, tuple(min(i, b - a - 1) if len(new) >= b - a else 0 for i in range(len(new)))))
    return "".join(out), changes


def _any(table: dict[str, str]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, sorted(table, key=lambda s: (-len(s), s)))))


def _tables(**tables: dict[str, str]) -> dict[str, Callable[[str], Changed]]:
    return {name: (lambda text, pattern=_any(table), table=table: substituted(text, pattern, table)) for name, table in tables.items()}


def _drops(**patterns: str) -> dict[str, Callable[[str], Changed]]:
    return {name: (lambda text, pattern=re.compile(p): dropped(text, pattern)) for name, p in patterns.items()}


#: In this order. A hasanta after another goes; a stray joiner is one that no hasanta precedes.
PASSES: dict[str, Callable[[str], Changed]] = {
    **_drops(strip_invisibles=f"[{INVISIBLE}]"),
    **_tables(space_like_to_space=dict.fromkeys(SPACE_LIKE, " "), khanda_ta=KHANDA_TA),
    **_drops(strip_zwj=ZWJ, strip_stray_zwnj=f"(?<!{HASANTA}){ZWNJ}"),
    "nfc": composed,
    **_tables(compose_nukta=NUKTA, compose_vowel_signs=VOWEL_SIGNS, punct_fold=PUNCTUATION),
    **_drops(collapse_hasanta=f"(?<={HASANTA}){HASANTA}"),
}
FOLD_DIGITS = _tables(fold_digits=DIGITS)
_NUKTA = _any(NUKTA)


def normalize(text: str | None, fold_digits: bool = False) -> tuple[str, Offsets, list[str]]:
    """(normalised text, offset map, names of the passes that changed it)."""
    original = text = text or ""
    offsets, rules = Offsets(len(text)), []
    if bijoy.looks_like(text):
        text = bijoy.convert(text)
        if text != original:  # a text that is detected only keeps its places
            offsets = Offsets.flat(len(text), len(original))
        rules.append("bijoy_to_unicode")
    if text.isascii() and "\t" not in text:  # no pass changes such a text
        return text, offsets, rules
    for name, change in (PASSES | FOLD_DIGITS if fold_digits else PASSES).items():
        text, changes = change(text)
        if changes:
            offsets = offsets.over(changes)
            rules.append(name)
    return text, offsets, rules


def folded_word(word: str) -> str:
    """A lexicon word as it is stored: NFC, with the three letters composed."""
    return substituted(unicodedata.normalize("NFC", word), _NUKTA, NUKTA)[0]


def _normalized(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in (part for b in batches for part in of_series(b)):
        rows = []
        for x in texts:
            t, o, r = normalize(x)
            rows.append((t, x or "", [{"place": p, "origin": q, "step": s} for p, q, s in o.rows()], r))
        yield pd.DataFrame(rows, columns=["text", "original", "offset_map", "applied_rules"])


def normalized(text: Column) -> Column:
    """A struct of the normalised text, the original, the offset map as breakpoints and the passes."""
    return F.pandas_udf(_normalized, f"struct<text:string,original:string,offset_map:{OFFSETS_DDL},applied_rules:array<string>>")(text)


def space_like_folded(text: Column) -> Column:
    return F.translate(text, SPACE_LIKE, " " * len(SPACE_LIKE))


def invisibles_stripped(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def punctuation_folded(text: Column) -> Column:
    single = {k: v for k, v in PUNCTUATION.items() if len(v) == 1}
    out = F.translate(text, "".join(single), "".join(single.values()))
    return F.replace(out, F.lit(u("2026")), F.lit("..."))


def digits_folded(text: Column) -> Column:
    return F.translate(text, "".join(DIGITS), "".join(DIGITS.values()))
