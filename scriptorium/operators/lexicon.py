"""Lexicons, lookups with affixes, candidates and their ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import FULL_LEXICON, SUGGEST_BUDGET
from scriptorium.functions.distance import latin_key, osa_column
from scriptorium.functions.letters import HASANTA
from scriptorium.functions.normalize import folded_word
from scriptorium.functions.tokenize import LATIN, words
from scriptorium.operators.affixes import Affixes
from scriptorium.operators.membership import strangers
from scriptorium.packs.base import Pack
from scriptorium.session import cut


@dataclass(frozen=True)
class Lookup:
    known: bool
    form: str | None = None
    stripped: tuple[str, ...] = ()


class Lexicon:
    """Words of a pack with affix stripping: the first way found, longest affix first, then by code point."""

    def __init__(self, pack: Pack, more: Iterator[str] | tuple[str, ...] = (), depth: int = 4):
        self.words = frozenset(map(folded_word, pack.lexicon)) | frozenset(more) | frozenset(pack.violations.values()) | frozenset(pack.standard_forms.values()) | frozenset(pack.register.values())
        self.affixes, self.depth = Affixes(pack, depth), depth
        self.has_letter, self.splits, self.prefixes = self.affixes.has_letter, self.affixes.splits, self.affixes.prefixes

    def lookup(self, word: str, depth: int = 0) -> Lookup:
        if not word or word in self.words or not self.has_letter(word):
            return Lookup(True, word)
        if depth < self.depth:
            for stem, s in self.splits(word):
                for form in (stem, stem[:-1]) if stem.endswith(HASANTA) else (stem,):
                    found = self.lookup(form, depth + 1)
                    if found.known:
                        return Lookup(True, found.form, (*found.stripped, s))
        if depth == 0:
            for p in self.prefixes:
                if word.startswith(p) and len(word) > len(p) + 1:
                    found = self.lookup(word[len(p) :], depth + 1)
                    if found.known:
                        return found
        return Lookup(False)


def lookups(rows: DataFrame, pack: Pack, word: str = "word") -> DataFrame:
    """rows with known, form and stripped. Distinct words first: pass distinct rows."""

    def run(xs: pd.Series) -> pd.DataFrame:
        lexicon = Lexicon(pack)
        found = [lexicon.lookup(x or "") for x in xs]
        return pd.DataFrame({"known": [f.known for f in found], "form": [f.form for f in found], "stripped": [list(f.stripped) for f in found]})

    f = F.pandas_udf(run, "struct<known:boolean,form:string,stripped:array<string>>")
    return rows.withColumn("l", f(word)).select(*rows.columns, "l.known", "l.form", "l.stripped")


def word_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """(pos, word): the entries of a word list; blank lines and comments are left out."""
    t = F.trim(F.col(value))
    return lines.withColumn("pos", F.monotonically_increasing_id()).filter((t != "") & ~t.startswith("#")).select("pos", t.alias("word"))


def frequency_proxy(entries: DataFrame) -> DataFrame:
    """(word, freq): earlier entries count as more frequent; of repeats, the last place counts.

    Places are counted in partitions of a sort, and on from what those before hold: a
    number a partition reaches the driver."""
    sorted_ = cut(entries.orderBy("pos", "word").select("word", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    sizes = sorted(map(tuple, sorted_.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect()))
    n, before = sum(k for _, k, _ in sizes), {}
    for part, k, first in sizes:
        before[part] = sum(x for p, x, _ in sizes if p < part) - first
    if not before:
        return entries.select("word", F.lit(0).cast("long").alias("freq"))
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    return sorted_.groupBy("word").agg((F.lit(n) - F.max(F.col("place") + offset[F.col("part")])).cast("long").alias("freq"))


def supplemented(lexicon: DataFrame, more: DataFrame) -> DataFrame:
    """The words of both; those only in more have no frequency."""
    extra = more.select("word").distinct().join(lexicon.select("word"), "word", "left_anti")
    return lexicon.unionByName(extra.withColumn("freq", F.lit(None).cast("long")))


def token_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, freq, docs): occurrences of lower-cased Latin words, and documents that hold them.

    A document's words are sorted, so that the first of equals stands for the
    document: both counts come from one aggregate with partial sums."""
    ws = F.array_sort(F.filter(words(F.lower(F.coalesce(text, F.lit(""))), LATIN), lambda w: w.rlike("^[a-z]")))
    marked = F.transform("ws", lambda w, i: F.struct(w.alias("word"), F.when(w == F.get("ws", i - 1), 0).otherwise(1).alias("first")))
    one = docs.select(ws.alias("ws")).select(F.explode(marked).alias("m"))
    return one.groupBy("m.word").agg(F.count("*").alias("freq"), F.sum("m.first").alias("docs"))


def corpus_lexicon(docs: DataFrame, least_docs: int = 3, text: str = "text") -> DataFrame:
    """(word, freq): words of at least least_docs documents."""
    return token_frequency(docs, text).filter(F.col("docs") >= least_docs).select("word", "freq")


def coverage_factor(size: Column) -> Column:
    return F.least(F.lit(1.0), size / F.lit(float(FULL_LEXICON)))


def unknown(found: DataFrame, lexicon: DataFrame, distinct: bool = False) -> DataFrame:
    """Distinct words without an entry. Where each of found's words comes once, which `distinct` says, only those that
    the lexicon's filter lets pass are shuffled."""
    if distinct:
        return strangers(found.select("word"), lexicon.select("word"))
    return found.select("word").distinct().join(lexicon.select("word"), "word", "left_anti")


def deletions(word: Column, most: int) -> Column:
    """The word and what is left of it without up to `most` of its characters."""

    def shorter(w: Column) -> Column:
        return F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))

    out = level = F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def pieces(word: Column, of: Column, most: int, shift: Column | int = 0) -> Column:
    """What stands in word, moved by shift, where a word of `of` characters has its 2 * most + 1 pieces: an array of strings with number and place."""
    n = 2 * most + 1
    at = lambda k: F.floor(of * k / n)
    part = lambda k: F.concat_ws(":", of.cast("string"), k.cast("string"), F.substr(word, (at(k) + shift + 1).cast("int"), (at(k + 1) - at(k)).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), part)


def shifted(word: Column, most: int) -> Column:
    """The pieces of every word that may be within `most` edits of word."""
    around = F.sequence(F.lit(-most), F.lit(most))
    each = F.transform(around, lambda d: F.flatten(F.transform(F.filter(around, lambda s: F.length(word) + d >= 0), lambda s: pieces(word, F.length(word) + d, most, s))))
    return F.array_distinct(F.flatten(each))


def candidates(unknown_words: DataFrame, lexicon: DataFrame, max_distance: int = 2, key=latin_key, long: int = 24) -> DataFrame:
    """(word, cand, freq, dist, same_key): all lexicon words within max_distance.

    Two words that near share what is left of both after at most max_distance
    deletions, so an equi-join on that finds every pair; rows grow with the
    length of words, not with the size of the lexicon. Words of more than `long`
    characters would have too many such rests. These are cut in 2 * max_distance + 1
    pieces instead: an edit touches two of them at most, so one piece of the candidate
    stands unchanged in the word, hardly moved; strings then stay in proportion to the
    word. The distance is computed once a pair."""
    size = F.length("word")
    short, far = unknown_words.filter(size <= long), unknown_words.filter(size > long)
    rest = lambda: F.explode(deletions(F.col("word"), max_distance)).alias("d")
    near = short.select("word", rest()).join(lexicon.filter(size <= long + max_distance).select(F.col("word").alias("cand"), "freq", rest()), "d")
    whole = lexicon.filter(size > long - max_distance).select(F.col("word").alias("cand"), "freq", F.explode(pieces(F.col("word"), size, max_distance)).alias("d"))
    wide = far.select("word", F.explode(shifted(F.col("word"), max_distance)).alias("d")).join(whole, "d")
    pool = near.union(wide).filter((F.col("word") != F.col("cand")) & (F.abs(F.length("word") - F.length("cand")) <= max_distance)).select("word", "cand", "freq").distinct()
    # A swap is two plain edits: beyond twice the distance, the built-in settles a pair without Python.
    pool = pool.filter(F.levenshtein("word", "cand", 2 * max_distance) >= 0)
    pool = pool.withColumn("dist", osa_column(F.col("word"), F.col("cand"), max_distance)).filter(F.col("dist") <= max_distance)
    return pool.withColumn("same_key", key(F.col("word")) == key(F.col("cand")))


def ranked(pool: DataFrame, limit: int = 5, preferred: Column | None = None) -> DataFrame:
    """The best candidates of each word: by distance, preference, length gap, key, frequency, then code point."""
    w = Window.partitionBy("word").orderBy(
        "dist", F.when(preferred, 0).otherwise(1) if preferred is not None else F.lit(1), F.abs(F.length("word") - F.length("cand")),
        F.when(F.col("same_key"), 0).otherwise(1), F.desc(F.coalesce("freq", F.lit(0))), "cand",
    )
    return pool.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def stem_reconstructions(unknown_words: DataFrame, lexicon: DataFrame, pack: Pack, most_splits: int = 4, per_split: int = 5) -> DataFrame:
    """(word, cand): for unknown words with a suffix on an unknown stem, near words of the stem's key with the suffix again."""
    table = Lexicon(pack)

    def parts(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: [{"stem": a, "suffix": s} for a, s in table.splits(x) if not table.lookup(a).known][:most_splits])

    f = F.pandas_udf(parts, "array<struct<stem:string,suffix:string>>")
    s = unknown_words.select("word", F.explode(f("word")).alias("s")).select("word", "s.stem", "s.suffix")
    # The nearest two edits away at most: the candidates of stems, of which those of the stem's key stay.
    near = candidates(s.select(F.col("stem").alias("word")).distinct(), lexicon, 2, pack.sounds.key_column).filter("same_key")
    j = s.join(near.select(F.col("word").alias("stem"), F.col("cand").alias("near"), "freq", "dist"), "stem")
    alike = pack.sounds.alike_column
    preferred = [F.when(alike(F.col("stem"), F.col("near")), 0).otherwise(1)] if alike else []
    w = Window.partitionBy("word", "stem", "suffix").orderBy("dist", *preferred, F.abs(F.length("stem") - F.length("near")), F.desc(F.coalesce("freq", F.lit(0))), "near")
    return j.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_split).select("word", F.concat("near", "suffix").alias("cand"))


def budgeted(unknown_tokens: DataFrame, id_col: str = "doc_id", budget: int = SUGGEST_BUDGET) -> DataFrame:
    """Tokens of unknown words with within_budget: the first `budget` of a document get suggestions."""
    w = Window.partitionBy(id_col).orderBy("start")
    return unknown_tokens.withColumn("within_budget", F.row_number().over(w) <= budget)
