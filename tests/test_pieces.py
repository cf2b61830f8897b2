"""Texts in pieces of bounded size, and edits of some rules only."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from scriptorium.functions import pieces, tokenize
from scriptorium.operators.detect import RULES, Checker, edits
from scriptorium.packs.base import get_pack


def test_pieces_are_bounded_and_whole():
    texts = ["", None, "x" * 500, "é" * 90, None, "y" * 5, "z" * 3000, "", "w" * 100]
    parts = list(pieces.of_series(pd.Series(texts, dtype=object), 200))
    assert [x for p in parts for x in p] == texts
    assert all(len(p) == 1 or sum(len(x or "") for x in p) <= 200 for p in parts if p.iloc[0])
    batch = pa.RecordBatch.from_pydict({"t": texts})
    cut = list(pieces.of_batch(batch, 0, 200))
    assert [x for p in cut for x in p.column(0).to_pylist()] == texts and len(cut) > 3
    assert list(pieces.of_batch(batch.slice(0, 0), 0)) == []


@pytest.mark.parametrize("find", [lambda d: edits(d, get_pack("la")).select(F.size("edits")), lambda d: tokenize.sentence_rows(d, tokenize.LATIN).groupBy("doc_id").count().select("count")])
def test_a_batch_isn_t_held_whole(spark, find):
    """5,000 texts of a batch: no more than a few of their pieces' results are there at once, and none is lost."""
    docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a ,b. "), 200).alias("text"))
    assert {r[0] for r in find(docs).collect()} == {200}


def test_edits_go_on_in_pieces(spark, monkeypatch):
    """What a task sends on at a time is of some texts, not of all that Spark hands it at once."""
    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = edits(docs, get_pack("la"))
    sent = [b.num_rows for b in run(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": ["a ,b" * 1000] * 1000})]))]
    assert sum(sent) == 1000 and max(sent) * 4000 <= pieces.PIECE


def test_edits_of_some_rules():
    checker, text = Checker(get_pack("bn")), "কারন  অনেক বইগুলো ,আমি বই করছো।।"
    whole = checker.check(text)
    for rule in {e.rule for e in whole} | {r for own in RULES.values() for r in own}:
        assert checker.check(text, frozenset({rule})) == [e for e in whole if e.rule == rule]


def test_words_without_a_trait_are_passed_over():
    """Words that no detector looks for are looked up once, and leave the detectors alone."""
    checker = Checker(get_pack("bn"))
    word = next(w for w in get_pack("bn").lexicon if checker.traits_of(w) == 0)
    checker.spelling = checker.collocation = checker.classifier = checker.standard = checker.register = lambda *_: (1 / n for n in (0,))
    assert checker.check(f"{word} {word}") == []
