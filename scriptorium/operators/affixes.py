"""Affix analysis of words against a lexicon of any size, by joins on rests.

What a word may be an affixed form of depends on the affix tables alone, which are of a
language's size: a task walks a trie of reversed suffixes from the word's end and lists
the rests, each with the path of choices that leads to it. The lexicon stays a table:
known words are settled by a semi join first, and only the rests of the others are joined
with it. Of the rests that are words, the one of the least path is the analysis, which is
the one that a depth-first search with the lexicon at hand would meet first: longest
suffix first, a shorter path before what extends it, prefixes after all suffixes. Rests of
one depth that are equal are one, so a word has no more of them than its letters times the
depth, whatever the tables hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.letters import HASANTA, lettered, vowel_final
from scriptorium.packs.base import Pack

RESTS = "array<struct<form:string,path:string,stripped:array<string>>>"


class SuffixTrie:
    """Suffixes by their letters from the end."""

    def __init__(self, suffixes):
        self.root: dict = {}
        for s in suffixes:
            node = self.root
            for c in reversed(s):
                node = node.setdefault(c, {})
            node[""] = s

    def of(self, word: str) -> list[str]:
        """The suffixes that word ends in, longest first, found in one walk."""
        node, out = self.root, []
        for c in reversed(word):
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                out.append(node[""])
        return out[::-1]


class Affixes:
    """A pack's affix tables, without its lexicon."""

    def __init__(self, pack: Pack, depth: int = 4):
        order = lambda xs: sorted(set(xs), key=lambda s: (-len(s), s))
        self.suffixes, self.prefixes, self.guarded, self.depth = order(s for s in pack.suffixes if s), order(pack.prefixes), frozenset(pack.vowel_final_only), depth
        self.trie = SuffixTrie(self.suffixes)
        self.has_letter: Callable[[str], bool] = lettered(pack.script)

    def splits(self, word: str) -> Iterator[tuple[str, str]]:
        """(stem, suffix), longest suffix first; a stem has two letters at least."""
        for s in self.trie.of(word):
            if len(word) > len(s) + 1:
                stem = word[: -len(s)]
                if s not in self.guarded or vowel_final(stem):
                    yield stem, s

    def _levels(self, word: str, path: str, depth: int) -> Iterator[dict[str, tuple[str, tuple[str, ...]]]]:
        """By depth: the rests of word with their least path and what was stripped, outermost suffix last."""
        level: dict[str, tuple[str, tuple[str, ...]]] = {word: (path, ())}
        for _ in range(depth, self.depth):
            after: dict[str, tuple[str, tuple[str, ...]]] = {}
            for w, (p, stripped) in level.items():
                for n, (stem, s) in enumerate(self.splits(w)):
                    # A path is one character a choice, so that paths compare as the search goes on.
                    for k, form in enumerate((stem, stem[:-1]) if stem.endswith(HASANTA) else (stem,)):
                        found = (p + chr(33 + 2 * n + k), (s, *stripped))
                        after[form] = min(after.get(form, found), found)
            level = after
            yield level

    def rests(self, word: str) -> list[tuple[str, str, tuple[str, ...]]]:
        """(form, path, stripped) of what the word may be a form of, itself aside; the least path of each form."""
        best: dict[str, tuple[str, tuple[str, ...]]] = {}

        def seen(level: dict[str, tuple[str, tuple[str, ...]]]) -> None:
            for form, found in level.items():
                best[form] = min(best.get(form, found), found)

        for level in self._levels(word, "", 0):
            seen(level)
        for n, p in enumerate(self.prefixes):
            if word.startswith(p) and len(word) > len(p) + 1:
                bare, path = word[len(p) :], chr(0x10000 + n)  # after every path of suffixes
                seen({bare: (path, ())})
                for level in self._levels(bare, path, 1):
                    seen(level)
        return [(form, path, stripped) for form, (path, stripped) in best.items()]


def analysed(words: DataFrame, lexicon: DataFrame, pack: Pack, word: str = "word", depth: int = 4) -> DataFrame:
    """Distinct words with known, form and stripped, as Lexicon.lookup gives them; lexicon (word) may be of any size.

    An empty word, and one without a letter of the pack's script, is known as it is; a null word is unknown."""
    affixes = Affixes(pack, depth)
    has_letter, none = affixes.has_letter, F.array().cast("array<string>")
    entries = lexicon.select(F.col("word").alias("form")).distinct()
    rows = words.select(F.col(word).alias("word")).distinct()

    def rests(xs: pd.Series) -> pd.Series:
        # A rest without letters is known too, whatever the lexicon holds.
        return xs.map(lambda x: [{"form": f, "path": p, "stripped": list(s)} for f, p, s in (affixes.rests(x) if x else [])])

    def plain(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: x is not None and (not x or not has_letter(x)))

    asked = rows.withColumn("plain", F.pandas_udf(plain, "boolean")("word"))
    there = asked.join(entries.withColumnRenamed("form", "word").withColumn("listed", F.lit(True)), "word", "left")
    there = there.select("word", (F.col("plain") | F.coalesce("listed", F.lit(False))).alias("known"))
    each = there.filter(~F.col("known")).select("word", F.explode(F.pandas_udf(rests, RESTS)("word")).alias("r")).select("word", "r.*")
    bare = each.filter(F.pandas_udf(plain, "boolean")("form"))
    found = each.join(entries, "form", "left_semi").select(*each.columns).unionByName(bare)
    best = found.groupBy("word").agg(F.min_by(F.struct("form", "stripped"), "path").alias("b"))
    return there.join(best, "word", "left").select(
        "word", (F.col("known") | F.col("b").isNotNull()).alias("known"), F.when(F.col("known"), F.col("word")).otherwise(F.col("b.form")).alias("form"),
        F.when(F.col("known"), none).otherwise(F.coalesce("b.stripped", none)).alias("stripped"),
    )
