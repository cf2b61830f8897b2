"""The word graph against plain distances, and the suggestions that come from it."""

import random
import time
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from scriptorium.functions.distance import homophone_substitution, latin_code, latin_key, osa, soundex
from scriptorium.functions.wordgraph import Graph, WordGraph
from scriptorium.operators.detect import Checker
from scriptorium.packs.base import get_pack
from scriptorium.plans import corpus

SOME = st.lists(st.text("abc", max_size=9), max_size=40)


@settings(max_examples=150, deadline=None)
@given(SOME, st.text("abcz", max_size=10), st.integers(0, 3))
def test_near_is_every_word_within_the_distance(words, word, most):
    graph = WordGraph(words)
    assert graph.near(word, most) == {w: osa(word, w) for w in words if osa(word, w) <= most}
    assert (word in graph) == (word in words) and all(w in graph for w in words)


def test_two_edits_anywhere_about_the_middle():
    """Swaps across the middle, and both edits on one side, are found by one walk or the other."""
    rng = random.Random(4)
    for _ in range(400):
        word = "".join(rng.choice("abcdef") for _ in range(rng.randint(4, 9)))
        other = list(word)
        for _ in range(2):
            i = rng.randrange(len(other) - 1)
            kind = rng.randrange(4)
            if kind == 0:
                other[i], other[i + 1] = other[i + 1], other[i]
            elif kind == 1:
                other[i] = rng.choice("abcdefg")
            elif kind == 2:
                other.insert(i, rng.choice("abcdefg"))
            elif len(other) > 2:
                del other[i]
        x = "".join(other)
        d = osa(word, x)
        assert WordGraph([x, "unrelated"]).near(word) == ({x: d} if d <= 2 else {})


def test_equal_endings_are_one():
    graph = Graph(["tap", "taps", "top", "tops"])
    assert len(graph.edges) == 5 and graph.farthest[graph.root] == 4 and graph.nearest[graph.root] == 3


def test_no_words():
    assert WordGraph([]).near("a") == {} and "" not in WordGraph([]) and WordGraph([""]).near("ab") == {"": 2}


def plain_suggestions(checker, word, limit=5):
    """As from the whole lexicon, word by word."""
    words, lexicon, key = checker.lexicon.words, checker.lexicon, checker.pack.sounds.key

    def best(target, pool):
        near = [(d, not checker.pack.sounds.alike(target, w), abs(len(w) - len(target)), key(w) != key(target), -checker.frequency.get(w, 0), w) for w in pool if w != target and (d := osa(target, w, 2)) <= 2]
        return [x[-1] for x in sorted(near)[:limit]]

    splits = [(a, s) for a, s in lexicon.splits(word) if not lexicon.lookup(a).known][:4]
    pool = set(words) | {w + s for a, s in splits for w in best(a, [w for w in words if key(w) == key(a)])}
    return best(word, pool)


def spoilt(rng, word, letters):
    out = list(word)
    for _ in range(rng.randint(1, 2)):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([[], [rng.choice(letters)], [rng.choice(letters), out[i]], out[i : i + 2][::-1]])
        if not out:
            return word
    return "".join(out)


def test_suggestions_equal_those_of_the_whole_lexicon():
    checker = Checker(get_pack("bn"))
    rng = random.Random(11)
    words = sorted(checker.lexicon.words)
    letters = sorted(set("".join(words)))
    for _ in range(300):
        word = spoilt(rng, rng.choice(words) + rng.choice(["", *checker.pack.suffixes[:8]]), letters)
        if word not in checker.lexicon.words:
            assert checker._suggest(word) == plain_suggestions(checker, word), word


def test_a_large_lexicon_is_walked_in_about_a_millisecond():
    rng = random.Random(5)
    parts = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(2)) for _ in range(400)]
    words = {rng.choice(parts) + rng.choice(parts) + rng.choice(["", "s", "ing", "ed", rng.choice(parts)]) for _ in range(230_000)}
    words = sorted(words)[:150_000]
    graph = WordGraph(words)
    asked = [spoilt(rng, w, "abcdefghijklmnoprstu") for w in rng.sample(words, 1000)]
    graph.near(asked[0])
    began = time.process_time()
    found = sum(len(graph.near(w)) for w in asked)
    assert found > 1000 and (time.process_time() - began) / len(asked) < 0.005  # about 0.001 on a machine at rest


@pytest.mark.parametrize("code", ["la", "bn"])
def test_graph_and_join_give_the_same_suggestions(spark, code):
    rng = random.Random(6)
    if code == "la":
        words = sorted({"".join(rng.choice("abcdr") for _ in range(rng.randint(2, 8))) for _ in range(150)})
        letters = "abcdr"
    else:
        pack = get_pack("bn")
        words = sorted(set(pack.lexicon[:150]))
        letters = sorted(set("".join(words)))
    freq = {w: rng.randint(1, 5) for w in words}
    unknown = sorted({spoilt(rng, rng.choice(words) + rng.choice(["", *get_pack(code).suffixes[:4]]), letters) for _ in range(120)} - set(words))
    u = spark.createDataFrame([(w,) for w in unknown], "word string")
    x = spark.createDataFrame(list(freq.items()), "word string, freq long")
    if code == "bn":  # the pack's tables add words of their own to a checker's lexicon, which a joined one hasn't
        more = Checker(replace(get_pack("bn"), lexicon=())).lexicon.words - set(words)
        x = x.union(spark.createDataFrame([(w, 0) for w in sorted(more)], "word string, freq long"))
    walked, joined = ({r["word"]: r["suggestions"] for r in corpus.suggestions(u, x, code, most_words=n).collect()} for n in (10_000, 10))
    assert walked == joined and sum(map(bool, walked.values())) > 20


def test_latin_key_of_one_word(spark):
    words = ["Apple", "bfpv", "", "x", "straße", "don't", "hwy", "Ächz"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    from pyspark.sql import functions as F

    assert [r["k"] for r in rows.select("w", latin_key(F.col("w")).alias("k")).collect()] == list(map(latin_code, words))
    assert soundex("মানুষ") == soundex("মানুশ") and homophone_substitution("মানুষ", "মানুশ")
