"""Readability of Bengali text from syllables, learned spellings and sentence lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.letters import CONSONANT, HASANTA, INDEPENDENT, expanded, has_letter, u
from scriptorium.functions.tokenize import BENGALI, Rules, sentences, tokens

# Weights of the parts there are, and letters and clusters of learned words.
WEIGHTS = {"syllables": 0.30, "tatsama": 0.35, "variance": 0.15}
MARKERS = ("ষ", "ণ", "ঋ", "ৃ", "ঃ", "ঞ", u("9DD"), "্য", "্র", "্ব", "ক্ষ", "জ্ঞ")
# What counts as easiest, and the range up to hardest, of syllables a word, share of learned words and variance.
EASIEST, RANGES = (2.0, 0.0, 0.0), (2.5, 0.45, 90.0)
# Decimal places.
PLACES = {"score": 1, "syllables_per_word": 3, "tatsama_density": 3, "sentence_length_variance": 2, "mean_sentence_length": 2}
FIELDS = (*PLACES, "words", "sentences")


_VOWELS = frozenset(expanded(INDEPENDENT))


def syllables_column(word: Column) -> Column:
    """Independent vowels, and consonants that no hasanta follows; at least one."""
    found = F.size(F.regexp_extract_all(word, F.lit(f"[{CONSONANT}](?!{HASANTA})|[{INDEPENDENT}]"), F.lit(0)))
    return F.greatest(found, F.lit(1))


def syllables(word: str) -> int:
    n = 0
    for i, c in enumerate(word):
        if has_letter(c) and (word[i + 1 : i + 2] != HASANTA or c in _VOWELS):
            n += 1
    return max(1, n)


def tatsama(word: str) -> bool:
    return any(m in word for m in MARKERS)


def score(text: str, rules: Rules = BENGALI) -> dict[str, float | None]:
    """The score, 100 for the easiest, its parts, and the words and sentences counted; without words all are 0, and the mean is null."""
    spans = sentences(text, rules)
    per = [[t for _, _, t, w in tokens(text[a:b], a, rules) if w] for a, b in spans]
    own = [w for ws in per for w in ws if has_letter(w)]
    if not own or not spans:
        return dict.fromkeys(FIELDS, 0.0) | {"mean_sentence_length": None}
    lengths = [len(ws) for ws in per]
    mean = sum(lengths) / len(lengths)
    parts = (sum(map(syllables, own)) / len(own), sum(map(tatsama, own)) / len(own), sum((x - mean) ** 2 for x in lengths) / len(lengths))
    hard = [max(0.0, min(1.0, (x - low) / width)) for x, low, width in zip(parts, EASIEST, RANGES, strict=True)]
    difficulty = sum(w * x for w, x in zip(WEIGHTS.values(), hard, strict=True)) / sum(WEIGHTS.values())
    values = ((1 - difficulty) * 100, *parts, mean)
    return {k: round(v, n) for (k, n), v in zip(PLACES.items(), values, strict=True)} | {"words": float(len(own)), "sentences": float(len(spans))}


def scored(text: Column, rules: Rules = BENGALI) -> Column:
    """A struct of what score() gives."""

    def run(xs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([score(x or "", rules) for x in xs], columns=list(FIELDS), dtype=float)

    return F.pandas_udf(run, f"struct<{','.join(f'{c}:double' for c in FIELDS)}>")(text)


def sentence_length_variance(lengths: Column) -> Column:
    """Population variance of an array of lengths, by built-ins; 0 for fewer than two."""
    n = F.size(lengths)
    total = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(n < 2, F.lit(0.0)).otherwise(square / n - (total / n) * (total / n))
