"""The sweep against comparing every span with every edit."""

import random
import time

import pytest
from scriptorium.operators import evaluate
from scriptorium.operators.spans import hits


def brute(spans, edits):
    out = []
    for n, (i, c, a, z) in enumerate(spans):
        near = [q for j, d, s, e, q in edits if i is not None and c is not None and (i, c) == (j, d) and s is not None and (a is None or s < z and a < e)]
        out.append((n, min(near, default=None)))
    return out


def swept(spark, spans, edits):
    s = spark.createDataFrame([(n, *x) for n, x in enumerate(spans)], "n int, id string, error_class string, start int, end int").repartition(3)
    e = spark.createDataFrame(edits, "id string, error_class string, start int, end int, seq int").repartition(2)
    return sorted((r["n"], r["hit_seq"]) for r in hits(s, e).collect())


@pytest.mark.parametrize("seed", range(4))
def test_every_overlap(spark, seed):
    """Nested, touching, empty and repeated spans, spans without places, and nulls in keys."""
    rng = random.Random(seed)

    def span():
        a = rng.randrange(30)
        return a, a + rng.choice([0, 0, 1, 2, 5, 20])

    key = lambda: (rng.choice(["x", "y", "z", None]), rng.choice(["A", "B", None]) if rng.random() < 0.2 else "A")
    spans = [(*key(), *(span() if rng.random() < 0.9 else (None, None))) for _ in range(150)]
    edits = [(*key(), *span(), rng.randrange(50)) for _ in range(40)] + [("x", "A", None, None, 0)]
    assert swept(spark, spans, edits) == brute(spans, edits)


def test_no_edits_and_no_spans(spark):
    assert swept(spark, [("x", "A", 0, 5), ("x", "A", None, None)], []) == [(0, None), (1, None)]
    assert swept(spark, [], [("x", "A", 0, 5, 1)]) == []


def test_ten_thousand_spans_in_one_text(spark):
    """All open at once at the worst, and all edits within all spans; compared pairs would be a hundred million."""
    spans = [("x", "A", i, 20_000 - i) for i in range(9_000)] + [("x", "A", 10 * i, 10 * i + 5) for i in range(1_000)]
    edits = [("x", "A", 9_000 + i % 1_000, 9_001 + i % 1_000, 10_000 - i) for i in range(10_000)]
    began = time.time()
    got = dict(swept(spark, spans, edits))
    assert time.time() - began < 60
    least = {}
    for _, _, s, _, q in edits:
        least[s] = min(q, least.get(s, q))
    for n in (0, 1, 4_500, 8_999, 9_000, 9_905, 9_999):
        a, z = spans[n][2:]
        assert got[n] == min((q for s, q in least.items() if s < z and a < s + 1), default=None)


def test_matched_cases(spark):
    cases = spark.createDataFrame([("c1", "a bad word", "A", "bad"), ("c2", "none", "A", None), ("c3", "x", "B", "y")], "id string, text string, error_class string, wrong string")
    edits = spark.createDataFrame([("c1", "A", 0, 1, 0), ("c1", "A", 3, 9, 1), ("c2", "A", 7, 8, 4), ("c2", "B", 7, 8, 0)], "id string, error_class string, start int, end int, seq int")
    got = {(r["id"], r["error_class"]): r["hit_seq"] for r in evaluate.matched(evaluate.gold_spans(cases), edits).collect()}
    assert got == {("c1", "A"): 1, ("c2", "A"): 4, ("c3", "B"): None}
