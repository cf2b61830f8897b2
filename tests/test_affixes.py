"""Affix analysis by joins against Lexicon.lookup, and membership by a filter against plain sets."""

import random
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from scriptorium.operators import affixes, lexicon, membership
from scriptorium.packs.base import get_pack

LATIN = replace(get_pack("la"), suffixes=("s", "es", "ed", "d", "ing", "ings", "ss"), prefixes=("un", "u", "re"))


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.lists(st.text("abc", min_size=1, max_size=3), max_size=6))
def test_trie_finds_every_suffix_longest_first(word, suffixes):
    want = sorted({s for s in suffixes if word.endswith(s)}, key=len, reverse=True)
    assert affixes.SuffixTrie(suffixes).of(word) == want


def compared(spark, pack, words, depth=4):
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    entries = spark.createDataFrame([(w,) for w in lexicon.Lexicon(pack).words], "word string")
    got = {r["word"]: (r["known"], r["form"], tuple(r["stripped"])) for r in affixes.analysed(rows, entries, pack, depth=depth).collect()}
    plain = lexicon.Lexicon(pack, depth=depth)
    for w in set(words):
        found = plain.lookup(w)
        # A word whose prefix was cut shows the suffixes of the rest.
        assert got[w] == (found.known, found.form, found.stripped), w
    return got


def test_latin_words(spark):
    rng = random.Random(3)
    parts = ["walk", "bed", "red", "sing", "und", "ass", "es", "a"]
    words = ["".join([rng.choice(["", "un", "re", "u"]), rng.choice(parts), *(rng.choice(LATIN.suffixes) for _ in range(rng.randint(0, 5)))]) for _ in range(400)] + ["", "12", "1s", "-", "unun", "sssssssssss"]
    got = compared(spark, replace(LATIN, lexicon=("walk", "bed", "sing", "ass", "und", "ed", "s")), words)
    assert sum(k for k, _, _ in got.values()) > 50 and sum(not k for k, _, _ in got.values()) > 50
    compared(spark, replace(LATIN, lexicon=("walk", "bed")), words[:100], depth=2)


def test_bengali_words(spark):
    pack = get_pack("bn")
    rng = random.Random(4)
    words = [rng.choice(pack.lexicon) + "".join(rng.choice(pack.suffixes) for _ in range(rng.randint(0, 3))) for _ in range(300)]
    words += [rng.choice(pack.prefixes) + w for w in words[:60]] + [w[:-1] for w in words[:60] if len(w) > 2]
    compared(spark, pack, words)


def test_null_words_are_unknown_and_the_lexicon_stays_a_table(spark):
    rows = spark.createDataFrame([(None,), ("walks",), ("walks",)], "word string")
    entries = spark.createDataFrame([("walk",), ("walk",), (None,)], "word string")
    df = affixes.analysed(rows, entries, LATIN)
    assert sorted(map(tuple, df.collect()), key=repr) == [("walks", True, "walk", ["s"]), (None, False, None, [])]


def test_rests_stay_few():
    """A word of nothing but suffixes has no more rests than letters."""
    found = affixes.Affixes(replace(LATIN, prefixes=(), suffixes=("s", "ss", "sss")), depth=40).rests("s" * 60)
    assert len(found) <= 60


@pytest.fixture(scope="module")
def listed(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(0, 7))) for _ in range(3000)})
    return words, spark.createDataFrame([(w,) for w in words], "word string").repartition(4)


def test_filter_lets_every_member_pass_and_few_others(spark, listed):
    words, df = listed
    f = membership.member_filter(df, membership.power_of(len(words)))
    assert f.passes(words).all()
    others = [f"x{i}" for i in range(4000)]
    assert f.passes(others).mean() < 0.02
    assert f.passes([]).tolist() == []


def test_filters_of_parts_add_up(spark, listed):
    words, df = listed
    whole, a, b = (membership.member_filter(x, 16) for x in (df, df.filter("word < 'c'"), df.filter("word >= 'c'")))
    assert np.array_equal((a | b).blocks, whole.blocks) and not np.array_equal(a.blocks, whole.blocks)
    with pytest.raises(ValueError):
        a | membership.member_filter(df, 12)


@pytest.mark.parametrize("most_bytes", [1 << 20, 10])
def test_members_and_strangers(spark, listed, most_bytes):
    """With the filter, and beyond its size by join alone; nulls are in no list."""
    words, df = listed
    rng = random.Random(6)
    asked = [rng.choice(words) if rng.random() < 0.5 else f"{rng.choice(words)}z" for _ in range(500)] + [None, ""]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(asked)], "i int, w string")
    got = {r["i"] for r in membership.members(rows, df, "w", most_bytes).collect()}
    assert got == {i for i, w in enumerate(asked) if w in set(words)}
    got = {r["i"] for r in membership.strangers(rows, df, "w", most_bytes).collect()}
    assert got == {i for i, w in enumerate(asked) if w not in set(words)}


def test_empty_list(spark, listed):
    _, df = listed
    assert membership.members(df, df.filter("false")).count() == 0
    assert membership.strangers(df, df.filter("false")).count() == df.count()


def written(spark) -> int:
    """Bytes that the application's tasks wrote for shuffles so far."""
    return sum(x.totalShuffleWrite() for x in scala(spark._jsc.sc().statusStore().executorList(False)))


def scala(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_less_is_shuffled(spark, listed):
    """A thousandth of the rows are members; what making the filter shuffles counts too, so that only the list travels."""
    from pyspark.sql import functions as F

    words, df = listed
    rows = spark.range(0, 60_000, numPartitions=3).select("id", F.when(F.col("id") % 1000 == 0, F.lit(words[7])).otherwise(F.concat(F.lit("no-such-word-"), F.col("id").cast("string"))).alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        took = {}
        for most in (1 << 20, 10):
            before = written(spark)
            assert membership.members(rows, df, "w", most).count() == 60
            took[most] = written(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert took[1 << 20] * 3 < took[10], took
