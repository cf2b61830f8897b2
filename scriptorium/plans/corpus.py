"""Spelling of a corpus against its own lexicon, as joins of distinct words.

A pack without a word list takes the words that enough documents of the corpus share.
The others, each once, get their candidates by the lexicon's word graph, or by join where
the lexicon is too large to send; documents then find their own
unknown words by a join on words, and only these occurrences travel. Places are those
of the submitted text. What a document has beyond that, its marks, comes from the
detectors, which stay where the document lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import lru_cache
from itertools import compress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.config import CONFIDENCE, EDIT_DDL, GRAPH_WORDS, SUGGEST_BUDGET, PipelineConfig
from scriptorium.functions.distance import osa_column
from scriptorium.functions.pieces import of_series
from scriptorium.operators.detect import Checker, edits
from scriptorium.operators.lexicon import budgeted, candidates, coverage_factor, ranked, stem_reconstructions, token_frequency
from scriptorium.operators.membership import MemberFilter, member_filter, power_of
from scriptorium.operators.resolve import edit_rows, resolved
from scriptorium.packs.base import get_pack
from scriptorium.session import cut


def occurrences(docs: DataFrame, code: str = "la", id_col: str = "doc_id", text: str = "text", among: MemberFilter | None = None) -> DataFrame:
    """(row, id, word, start, end, original): the words of each text with their places; row tells rows of one id apart.

    With a filter, only words that it lets pass: those of its list, and a few others."""
    rules = get_pack(code).rules
    sent = among and docs.sparkSession.sparkContext.broadcast((among.power, among.blocks))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        members = sent and MemberFilter(*sent.value)

        pattern = rules.tokens

        for xs in (part for b in batches for part in of_series(b)):
            found = [[(m.group().lower(), m) for m in pattern.finditer(x or "") if m.group()[0].isalpha()] for x in xs]
            if members:  # each word of a piece is looked up once
                words = list({w for one in found for w, _ in one})
                known = set(compress(words, members.passes(words)))
                found = [[t for t in one if t[0] in known] for one in found]
            yield pd.Series([[{"word": w, "start": m.start(), "end": m.end(), "original": m.group()} for w, m in one] for one in found], dtype=object)

    f = F.pandas_udf(run, "array<struct<word:string,start:int,end:int,original:string>>")
    return docs.select("row", id_col, F.explode(f(text)).alias("t")).select("row", id_col, "t.*")


def vocabulary(docs: DataFrame, least_docs: int = 3, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(word, freq) of words that enough documents share, and of the others."""
    freq = cut(token_frequency(docs, text))
    return tuple(freq.filter(c).select("word", "freq") for c in (F.col("docs") >= least_docs, F.col("docs") < least_docs))


def filter_of(words: DataFrame) -> MemberFilter | None:
    """The filter of a list of words, if it may be sent to all tasks."""
    power = power_of(words.count())
    return None if power is None else member_filter(words, power)


@lru_cache(maxsize=2)
def _checker(code: str, words: tuple[str, ...]) -> Checker:
    """A checker by these words, most frequent first; made once a Python process."""
    return Checker(replace(get_pack(code), lexicon=words))


def suggestions(unknown: DataFrame, lexicon: DataFrame, code: str = "la", limit: int = 5, most_words: int = GRAPH_WORDS) -> DataFrame:
    """(word, suggestions): each unknown word once, with its nearest words of the lexicon, best first; at most `limit`.

    A lexicon of up to most_words goes to all tasks, which walk its word graph; a larger one is joined. Both rank alike."""
    rules = get_pack(code)
    unknown = unknown.select("word")
    if lexicon.limit(most_words + 1).count() <= most_words:
        ordered = lexicon.select("word", F.coalesce("freq", F.lit(0)).alias("freq")).collect()
        sent = unknown.sparkSession.sparkContext.broadcast(tuple(r["word"] for r in sorted(ordered, key=lambda r: (-r["freq"], r["word"]))))

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            suggest = _checker(code, sent.value)._suggest
            for xs in batches:
                yield xs.map(lambda x: suggest(x, limit))

        # Walks take about a millisecond a word: words are dealt to all tasks.
        dealt = unknown.repartition(unknown.sparkSession.sparkContext.defaultParallelism * 4, "word")
        return dealt.select("word", F.pandas_udf(run, "array<string>")("word").alias("suggestions"))
    pool = candidates(unknown, lexicon, 2, rules.sounds.key_column)
    if rules.suffixes:
        stems = stem_reconstructions(unknown, lexicon, rules).join(pool.select("word", "cand"), ["word", "cand"], "left_anti")
        near = osa_column(F.col("word"), F.col("cand"), 2)
        same = rules.sounds.key_column(F.col("word")) == rules.sounds.key_column(F.col("cand"))
        freq = lexicon.select(F.col("word").alias("cand"), "freq")
        pool = pool.unionByName(stems.distinct().withColumn("dist", near).filter("dist <= 2").join(freq, "cand", "left").withColumn("same_key", same))
    alike = rules.sounds.alike_column
    best = ranked(pool, limit, alike(F.col("word"), F.col("cand")) if alike else None)
    found = best.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand"))), lambda s: s["cand"]).alias("suggestions"))
    return unknown.join(found, "word", "left").select("word", F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))


def spelling(docs: DataFrame, code: str = "la", least_docs: int = 3, coverage: float | None = None, id_col: str = "doc_id", text: str = "text", budget: int = SUGGEST_BUDGET) -> DataFrame:
    """(row, id, edits) of rows (row, id, text) with unknown words: an edit for each, of which the first `budget` of a
    row have suggestions. coverage: how far the lexicon is trusted; by its size if not given."""
    lexicon, rare = vocabulary(docs, least_docs, text)
    if coverage is None:
        coverage = lexicon.agg(coverage_factor(F.count("*")).alias("c")).first()["c"]
    known = cut(suggestions(rare, lexicon, code))
    found = budgeted(occurrences(docs, code, id_col, text, filter_of(known)).join(known, "word"), "row", budget)
    none = F.array().cast("array<string>")
    found = found.withColumn("suggestions", F.when(F.col("within_budget"), F.col("suggestions")).otherwise(none))
    rule = F.when(F.size("suggestions") > 0, "unknown_with_suggestions").otherwise("unknown_alone")
    confidence = F.when(F.size("suggestions") > 0, CONFIDENCE["unknown_with_suggestions"]).otherwise(CONFIDENCE["unknown_alone"]) * coverage
    fields = {"error_class": F.lit("NON_WORD"), "confidence": confidence, "stage": F.lit(1), "rule": rule, "seq": F.lit(0)}
    e = F.struct(*[fields.get(c, F.col(c)).cast(t).alias(c) for c, t in (p.rsplit(" ", 1) for p in EDIT_DDL.split(", "))])
    # At most the unknown words of one text are gathered.
    return found.groupBy("row", id_col).agg(F.sort_array(F.collect_list(e)).alias("edits"))


def check_corpus(docs: DataFrame, code: str = "la", config: PipelineConfig = PipelineConfig(), least_docs: int = 3, coverage: float | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Edits (id, start, ..., surfaced) of every text: unknown words by the corpus's own lexicon, and what the pack's detectors find.

    Rows of one id, or without id, are told apart. Spelling comes first where edits are equally good."""
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), id_col, F.col(text).alias("text")))
    words = spelling(rows, code, least_docs, coverage, id_col).select("row", F.col("edits").alias("words"))
    marks = edits(rows, get_pack(code), "row")
    both = marks.join(words, "row", "left").withColumn("all", F.concat(F.coalesce("words", F.slice("edits", 1, 0)), "edits"))
    numbered = both.select("row", F.transform("all", lambda e, i: e.withField("seq", i.cast("int"))).alias("edits"))
    found = edit_rows(resolved(numbered, config, "row"), "row")
    return rows.select("row", id_col).join(found, "row").drop("row")
