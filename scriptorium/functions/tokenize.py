"""Sentences and tokens with offsets, and counts by built-ins where no offset is needed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.letters import BLOCK, DANDA, DOUBLE_DANDA, u
from scriptorium.functions.pieces import of_series


@dataclass(frozen=True)
class Rules:
    """What ends a sentence, what closes after an end, and the words of a pack."""

    terminators: str
    word: str
    closers: str = "\"')]"

    @property
    def tokens(self) -> re.Pattern:
        return re.compile(self.word)


# What ends a sentence, and the pattern of words. Bengali: a period ends nothing. Latin: our own second pack.
BENGALI = Rules(DANDA + DOUBLE_DANDA + "?!", f"[{BLOCK}{u('200C 200D')}]+|[A-Za-z]+(?:['{u('2019')}][A-Za-z]+)*|[0-9{u('9E6-9EF')}]+(?:[.,][0-9{u('9E6-9EF')}]+)*")
LATIN = Rules(".?!", r"[A-Za-z]+(?:['’][A-Za-z]+)*|[0-9]+(?:[.,][0-9]+)*")


def sentences(text: str, rules: Rules = BENGALI) -> list[tuple[int, int]]:
    """Spans: a run of terminators with closing marks ends one, and so does a blank line.
    Spaces and tabs after an end belong to none; blank spans are left out."""
    end = re.compile(f"[{re.escape(rules.terminators)}]+(?:[{re.escape(rules.terminators + rules.closers)}])*[ \\t]*|\\n\\n+")
    out, at = [], 0
    for m in end.finditer(text):
        stop = m.start() if m.group()[0] == "\n" else m.end() - (len(m.group()) - len(m.group().rstrip(" \t")))
        if text[at:stop].strip():
            out.append((at, stop))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def tokens(text: str, offset: int = 0, rules: Rules = BENGALI) -> list[tuple[int, int, str, bool]]:
    """(start, end, text, is_word) in order; what lies between words, unless blank, is no word."""
    out, done = [], 0
    for m in rules.tokens.finditer(text):
        if text[done : m.start()].strip():
            out.append((offset + done, offset + m.start(), text[done : m.start()], False))
        out.append((offset + m.start(), offset + m.end(), m.group(), True))
        done = m.end()
    if text[done:].strip():
        out.append((offset + done, offset + len(text), text[done:], False))
    return out


def sentence_rows(docs: DataFrame, rules: Rules = BENGALI, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sent_idx, start, end, text)"""

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in (part for b in batches for part in of_series(b)):
            yield xs.map(lambda x: [{"start": a, "end": b, "text": (x or "")[a:b]} for a, b in sentences(x or "", rules)])

    f = F.pandas_udf(cut, "array<struct<start:int,end:int,text:string>>")
    return docs.select(id_col, F.posexplode(f(text)).alias("sent_idx", "s")).select(id_col, "sent_idx", "s.start", "s.end", "s.text")


def token_rows(docs: DataFrame, rules: Rules = BENGALI, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sent_idx, tok_idx, start, end, text, is_word)"""

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x: str) -> list[dict]:
            return [
                {"sent_idx": n, "tok_idx": i, "start": s, "end": e, "text": t, "is_word": w}
                for n, (a, b) in enumerate(sentences(x, rules))
                for i, (s, e, t, w) in enumerate(tokens(x[a:b], a, rules))
            ]

        for xs in (part for b in batches for part in of_series(b)):
            yield xs.map(lambda x: one(x or ""))

    f = F.pandas_udf(cut, "array<struct<sent_idx:int,tok_idx:int,start:int,end:int,text:string,is_word:boolean>>")
    return docs.select(id_col, F.explode(f(text)).alias("t")).select(id_col, "t.*")


def words(text: Column, rules: Rules = LATIN) -> Column:
    """The word tokens of a text, by built-ins: no offsets, no Python."""
    return F.regexp_extract_all(text, F.lit(rules.word), F.lit(0))


def ui_word_count(text: Column) -> Column:
    """Words between white space; 0 for blank text."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+\z", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def sentence_count(text: Column, rules: Rules = LATIN) -> Column:
    """Sentences that hold a letter or digit, by built-ins; close to, but simpler than, sentences()."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{rules.terminators}]+|\\n\\n+")
    return F.size(F.filter(parts, lambda p: p.rlike("[A-Za-z0-9]"))).cast("long")
