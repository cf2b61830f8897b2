"""Distances of many pairs at a time against those of one."""

import random
import time

import pandas as pd
from scriptorium.functions.distance import osa, osa_many


def pairs(n, rng):
    for _ in range(n):
        a = [rng.choice("abcé\0😀") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 2)] = rng.choice([b[i : i + 2][::-1], [rng.choice("abc")], []])
        yield "".join(a), "".join(b)


def test_many_pairs_are_each_as_one():
    rng = random.Random(5)
    given = [*pairs(4000, rng), ("", ""), ("a" * 70, "a" * 69 + "b"), ("a" * 70, "b"), ("ab" * 32, "ba" + "ab" * 31), ("a\0", "a"), ("", "ab"), ("ca", "abc")]
    xs, ys = map(list, zip(*given, strict=True))
    for limit in (0, 1, 2, 3):
        assert osa_many(xs, ys, limit).tolist() == [osa(x, y, limit) for x, y in given]
    assert osa_many([], [], 2).tolist() == [] and osa_many(["abc"], [""], 2).tolist() == [3]


def test_null_words_have_no_distance(spark):
    from scriptorium.functions.distance import osa_column

    rows = spark.createDataFrame(pd.DataFrame({"a": ["ab", None, "ab"], "b": ["ba", "x", None]}))
    assert [r[0] for r in rows.select(osa_column(rows["a"], rows["b"], 2)).collect()] == [1, None, None]


def test_many_pairs_take_less_time_than_one_by_one():
    given = list(pairs(20_000, random.Random(6)))
    xs, ys = map(list, zip(*given, strict=True))
    began = time.process_time()
    osa_many(xs, ys, 2)
    many = time.process_time() - began
    began = time.process_time()
    for x, y in given:
        osa(x, y, 2)
    assert many * 3 < time.process_time() - began
