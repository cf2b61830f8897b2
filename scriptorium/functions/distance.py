"""Optimal string alignment distance, and phonetic keys of Bengali words."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.letters import CHANDRABINDU, HASANTA, NUKTA_SIGN, VISARGA, u


def osa(a: str, b: str, limit: int | None = None) -> int:
    """Insertions, deletions, replacements and swaps of neighbours, none touched twice; limit + 1 beyond limit."""
    if limit is not None and abs(len(a) - len(b)) > limit:
        return limit + 1
    width = max(len(a), len(b)) if limit is None else limit
    far = width + 1
    # Rows hold the columns at most `width` from the diagonal; all others are farther.
    two: dict[int, int] = {}
    one = {j: j for j in range(min(len(b), width) + 1)}
    for i, x in enumerate(a, 1):
        now: dict[int, int] = {}
        for j in range(max(0, i - width), min(len(b), i + width) + 1):
            if not j:
                now[0] = i
                continue
            y = b[j - 1]
            d = min(one.get(j, far) + 1, now.get(j - 1, far) + 1, one.get(j - 1, far) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two.get(j - 2, far) + 1)
            now[j] = d
        if limit is not None and min(now.values()) > limit:
            return limit + 1
        two, one = one, now
    return one[len(b)] if limit is None or one[len(b)] <= limit else limit + 1


#: Words of more letters are compared one by one.
WIDE = 64


def osa_many(xs: list[str], ys: list[str], limit: int) -> np.ndarray:
    """osa() of many pairs at a time: the rows of osa(), each a step over all pairs, a diagonal after another."""
    out = np.full(len(xs), limit + 1, dtype=np.int32)
    m, n = np.fromiter(map(len, xs), np.int64, len(xs)), np.fromiter(map(len, ys), np.int64, len(ys))
    for i in np.flatnonzero(np.maximum(m, n) > WIDE).tolist():
        out[i] = osa(xs[i], ys[i], limit)
    some = np.flatnonzero((np.maximum(m, n) <= WIDE) & (np.abs(m - n) <= limit))
    if not len(some):
        return out
    m, n = m[some], n[some]
    width = int(m.max())

    def letters(words: list[str], size: np.ndarray, columns: int, pad: int) -> np.ndarray:
        """A row for each place; what lies beyond a word equals no letter."""
        x = np.array([words[i] for i in some.tolist()], dtype=f"U{columns}").view(np.uint32).reshape(len(some), columns)
        return np.ascontiguousarray(np.where(np.arange(columns) < size[:, None], x, np.uint32(pad)).T)

    a, b = letters(xs, m, max(1, width), 0xFFFFFFFE), letters(ys, n, width + limit + 1, 0xFFFFFFFF)
    far = np.full(len(some), limit + 1, dtype=np.int8)
    # Diagonal k holds the columns j = i + k - limit; all others are farther.
    two = one = [far] * (2 * limit + 1)
    one = [far if k < limit else np.full(len(some), k - limit, dtype=np.int8) for k in range(2 * limit + 1)]
    found = np.full(len(some), limit + 1, dtype=np.int8)

    def ended(i: int, row: list[np.ndarray]) -> None:
        for k in range(2 * limit + 1):
            here = (m == i) & (n == i + k - limit)
            found[here] = row[k][here]

    ended(0, one)
    for i in range(1, width + 1):
        now: list[np.ndarray] = []
        for k in range(2 * limit + 1):
            j = i + k - limit
            if j <= 0:
                now.append(np.full(len(some), i, dtype=np.int8) if j == 0 else far)
                continue
            d = one[k] + (a[i - 1] != b[j - 1])
            if k < 2 * limit:
                d = np.minimum(d, one[k + 1] + 1)
            if k:
                d = np.minimum(d, now[k - 1] + 1)
            if i > 1 and j > 1:
                d = np.where((a[i - 1] == b[j - 2]) & (a[i - 2] == b[j - 1]), np.minimum(d, two[k] + 1), d)
            now.append(np.minimum(d, limit + 1).astype(np.int8))
        two, one = one, now
        ended(i, one)
    out[some] = found
    return out


def osa_column(a: Column, b: Column, limit: int) -> Column:
    """osa() of two columns; rows with too wide a gap in length should be filtered before."""

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        none = (xs.isna() | ys.isna()).to_numpy()
        found = osa_many(xs.where(~none, "").tolist(), ys.where(~none, "").tolist(), limit)
        return pd.Series(pd.arrays.IntegerArray(found, none))

    return F.pandas_udf(run, "int")(a, b)


# Signs that have no sound of their own in a key, and classes of letters that sound alike.
# The two Assamese letters (9F0, 9F1) are our own addition.
SILENT = HASANTA + CHANDRABINDU + NUKTA_SIGN + VISARGA + u("200C 200D")
SOUNDS = {
    u("9B6 9B7 9B8"): "S",
    u("9A3 9A8"): "N",
    u("9AE 982"): "M",
    u("999 99E"): "G",
    u("995 996"): "K",
    u("997 998"): "g",
    u("99A 99B"): "C",
    u("99C 99D 9AF"): "J",
    u("99F 9A0 9A4 9A5 9CE"): "T",
    u("9A1 9A2 9A6 9A7"): "D",
    u("9AA 9AB"): "P",
    u("9AC 9AD 9F1"): "B",
    u("9B0 9DC 9DD 9F0"): "R",
    u("9B2"): "L",
    u("9B9"): "H",
    u("9DF"): "Y",
}
VOWELS = {
    u("987 988 9BF 9C0"): "i",
    u("989 98A 9C1 9C2"): "u",
    u("98F 990 9C7 9C8"): "e",
    u("993 994 9CB 9CC"): "o",
    u("985 986 9BE"): "a",
    u("98B 9C3"): "r",
}
_FOLD = {c: k for chars, k in (SOUNDS | VOWELS).items() for c in chars}
_CLASS = {c: k for chars, k in SOUNDS.items() for c in chars} | {c: f"v{k}" for chars, k in VOWELS.items() for c in chars}


@lru_cache(maxsize=32_768)
def soundex(word: str) -> str:
    """Vowels count only at the very beginning; letters of one class in a row are one."""
    vowels = "".join(VOWELS)
    out: list[str] = []
    for i, c in enumerate(word):
        if c in SILENT or (c in vowels and i):
            continue
        k = _FOLD.get(c)
        if k is None:
            if c.isalnum():
                out.append(c.lower())
        elif not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def soundex_column(word: Column) -> Column:
    """soundex() by built-ins, for words of Bengali letters and signs."""
    vowels = "".join(VOWELS)
    rest = F.translate(F.substr(word, F.lit(2)), vowels, "")
    kept = F.translate(F.concat(F.substring(word, 1, 1), rest), SILENT, "")
    folded = F.translate(kept, "".join(_FOLD), "".join(_FOLD.values()))
    return F.regexp_replace(folded, r"([A-Zaegiour])\1+", "$1")


def homophone_substitution(a: str, b: str) -> bool:
    """Whether just one letter differs and both of its forms sound alike."""
    if len(a) != len(b):
        return False
    apart = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return len(apart) == 1 and _CLASS.get(apart[0][0]) is not None and _CLASS.get(apart[0][0]) == _CLASS.get(apart[0][1])


def homophone_column(a: Column, b: Column) -> Column:
    fold = "".join(_FOLD), "".join(_FOLD.values())
    x, y = F.split(a, ""), F.split(b, "")
    apart = F.filter(F.zip_with(x, y, lambda p, q: F.when(p != q, F.struct(p.alias("p"), q.alias("q")))), lambda s: s.isNotNull())
    known = re.escape("".join(_FOLD))
    one = F.get(apart, F.lit(0))
    same = F.translate(one["p"], *fold) == F.translate(one["q"], *fold)
    return (F.length(a) == F.length(b)) & (F.size(apart) == 1) & F.coalesce(same & one["p"].rlike(f"[{known}]") & one["q"].rlike(f"[{known}]"), F.lit(False))


# Latin key of our second pack: consonant classes, vowels only at the beginning.
LATIN_CLASSES = {"bfpv": "1", "cgjkqsxz": "2", "dt": "3", "l": "4", "mn": "5", "r": "6"}


def latin_key(word: Column) -> Column:
    """First letter, then classes of the consonants that follow; by built-ins only."""
    low = F.lower(word)
    source = "".join(LATIN_CLASSES) + "aeiouhwy"
    target = "".join(v * len(k) for k, v in LATIN_CLASSES.items())
    return F.concat(F.substring(low, 1, 1), F.translate(F.substr(low, F.lit(2)), source, target))


_LATIN = str.maketrans({c: k for chars, k in LATIN_CLASSES.items() for c in chars} | dict.fromkeys("aeiouhwy", ""))


@lru_cache(maxsize=32_768)
def latin_code(word: str) -> str:
    """latin_key() of one word."""
    low = word.lower()
    return low[:1] + low[1:].translate(_LATIN)


def never(a: str, b: str) -> bool:
    return False


@dataclass(frozen=True)
class Sounds:
    """How a language compares words by sound: a key, and whether one letter was taken for another of its sound; each also as columns."""

    key: Callable[[str], str]
    key_column: Callable[[Column], Column]
    alike: Callable[[str, str], bool] = never
    alike_column: Callable[[Column, Column], Column] | None = None


BENGALI_SOUNDS = Sounds(soundex, soundex_column, homophone_substitution, homophone_column)
LATIN_SOUNDS = Sounds(latin_code, latin_key)
