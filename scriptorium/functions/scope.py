"""Spans of text in another script than the pack's."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.letters import BLOCK, CONSONANT, INDEPENDENT, expanded
from scriptorium.functions.pieces import of_series
from scriptorium.functions.tokenize import BENGALI, Rules, sentences, tokens


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsLatin}"), "latin").when(text.rlike(f"[{BLOCK}]"), "bengali").otherwise("other")


_OWN = frozenset(expanded(CONSONANT + INDEPENDENT))


def foreign_runs(text: str, rules: Rules = BENGALI) -> list[tuple[int, int, int, str]]:
    """(start, end, words, first word) of runs of foreign words.

    A word with a letter but none of the pack's is foreign. Runs go on until a
    word that isn't foreign, a number included, or a gap with a letter of the
    pack; a run of one character is left out. Runs go on over sentences."""
    out: list[list] = []
    open_ = False
    for a, b in sentences(text, rules):
        for s, e, t, is_word in tokens(text[a:b], a, rules):
            own = not _OWN.isdisjoint(t)
            if is_word and not own and any(map(str.isalpha, t)):
                if open_:
                    out[-1][1:3] = [e, out[-1][2] + 1]
                else:
                    out.append([s, e, 1, t])
                open_ = True
            elif is_word or own:
                open_ = False
    return [tuple(r) for r in out if r[1] - r[0] >= 2]


def out_of_scope(docs: DataFrame, rules: Rules = BENGALI, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, end, n_tokens, script) of runs of foreign words; found where the document lies, without a shuffle."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in (part for b in batches for part in of_series(b)):
            yield xs.map(lambda x: [{"start": a, "end": b, "n_tokens": n, "first": t} for a, b, n, t in foreign_runs(x or "", rules)])

    f = F.pandas_udf(run, "array<struct<start:int,end:int,n_tokens:bigint,first:string>>")
    spans = docs.select(id_col, F.explode(f(text)).alias("r"))
    return spans.select(id_col, "r.start", "r.end", "r.n_tokens", script_of(F.col("r.first")).alias("script"))


def shown_spaces(text: Column) -> Column:
    return F.translate(text, "\t ", "→·")
