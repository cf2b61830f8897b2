import math
import zlib
from collections import Counter
from itertools import combinations

import pytest
from scriptorium.llm import lattice
from scriptorium.llm.queries import op8_lattice_scores

from tests.llm.brute import split

PATH = lattice.vocabulary_path()


def brute_marginal(model, word):
    """Sum over all ways to cut the word, one by one."""
    s = lattice.BEGIN + word
    total = 0.0
    for k in range(len(s)):
        for cuts in combinations(range(1, len(s)), k):
            edges = [0, *cuts, len(s)]
            p = 1.0
            for a, b in zip(edges, edges[1:], strict=False):
                i = model.text.get(s[a:b])
                if i is not None:
                    p *= math.exp(model.logs[i])
                elif b == a + 1:
                    p *= math.exp(sum(model.logs[model.byte[x]] for x in s[a:b].encode()))
                else:
                    p = 0.0
            total += p
    return math.log10(total)


@pytest.mark.parametrize("word", ["a", "the", "therhean", "quête", "漢\U0001f600x", "zzzzzz"])
def test_forward_recursion(word):
    model = lattice.Lattice(PATH)
    assert abs(model.log10(word) - brute_marginal(model, word)) < 1e-9


def test_expected_counts_are_those_of_all_cuts():
    model, into = lattice.Lattice(PATH), {}
    model.expected("there", 2.0, into)
    back = {i: s for s, i in model.text.items()}
    letters = sum(e * len(back[i]) for i, e in into.items())
    assert abs(letters - 2 * len(lattice.BEGIN + "there")) < 1e-9


def test_prior_sums_to_one():
    assert abs(sum(math.exp(x) for x in lattice.pieces(PATH)[2]) - 1) < 1e-6


def brute_learned(counts, prior_tokens=1000.0):
    """Pieces' logarithms after one step, from counts of pieces in every cut weighted by its probability."""
    model, into = lattice.Lattice(PATH), Counter()
    for word, c in counts.items():
        if word == "\n":
            continue
        s = lattice.BEGIN + word
        before = [1.0] + [0.0] * len(s)  # in plain probabilities
        steps = [(a, b, brute_step(model, s[a:b])) for a in range(len(s)) for b in range(a + 1, len(s) + 1) if brute_step(model, s[a:b])]
        for b in range(1, len(s) + 1):
            before[b] = math.fsum(before[a] * p for a, e, (p, _) in steps if e == b)
        after = [0.0] * len(s) + [1.0]
        for a in range(len(s) - 1, -1, -1):
            after[a] = math.fsum(after[b] * p for x, b, (p, _) in steps if x == a)
        for a, b, (p, ids) in steps:
            for i in ids:
                into[i] += c * before[a] * p * after[b] / before[-1]
    total = math.fsum(into.values()) + counts["\n"] + 1 + prior_tokens
    prior = lattice.pieces(PATH)[2]
    return [math.log((into[i] + prior_tokens * math.exp(p)) / total) if p > -math.inf else p for i, p in enumerate(prior)], math.log((counts["\n"] + 1) / total)


def brute_step(model, part):
    """Probability and pieces of one arc; None where there is none."""
    if part in model.text:
        return math.exp(model.logs[model.text[part]]), [model.text[part]]
    if len(part) == 1:
        ids = [model.byte[x] for x in part.encode()]
        return math.exp(sum(model.logs[i] for i in ids)), ids
    return None


def brute_log10(model, word):
    s = lattice.BEGIN + word
    before = [1.0]
    for b in range(1, len(s) + 1):
        steps = [(a, brute_step(model, s[a:b])) for a in range(b)]
        before.append(math.fsum(before[a] * x[0] for a, x in steps if x))
    return math.log10(before[-1])


def brute_rows(docs, learn=True):
    counts = Counter()
    for i, t in docs:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update([*split(t, lower=True), "\n"])
    n, v = sum(counts.values()), len(counts)
    logs, end = brute_learned(counts) if learn else (lattice.pieces(PATH)[2], math.log((counts["\n"] + 1) / (n + 1)))
    model = lattice.Lattice(PATH, logs)
    known = {}
    out = []
    for i, t in docs:
        tokens = [*split(t, lower=True), "\n"]
        for w in tokens[:-1]:
            if w not in known:
                known[w] = brute_log10(model, w)
        base = math.fsum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        score = math.fsum(known[w] for w in tokens[:-1]) + end / math.log(10)
        out.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, len(tokens), sum(counts[w] > 0 for w in tokens), n, base, score))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[2]))


def same_rows(got, want):
    got = sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert abs(a[5] - b[5]) <= 1e-9 * max(1, abs(b[5])) and abs(a[6] - b[6]) <= 1e-9 * max(1, abs(b[6])), a[0]


@pytest.mark.parametrize("learn", [True, False])
def test_scores(spark, sf, learn):
    """Whole rows, the learned score included, against sums over cuts in plain probabilities."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [docs[k] for k in range(len(docs)) if len(docs[k][1]) < 900][:80] + [(None, "a b"), (None, None), (3, ""), (3, ""), (9, "Ünï漢字😀 x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, c string")
    same_rows(lattice.scores(df, PATH, learn=learn).collect(), brute_rows(rows, learn))


def test_query_scores_all(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, op8_lattice_scores(spark, sf).collect()))
    assert [r[0] for r in got] == sorted(r["doc_id"] for r in docs.collect())
    assert got == sorted(map(tuple, lattice.scores(docs, PATH).collect())) and all(r[6] < 0 and math.isfinite(r[6]) for r in got)


def test_long_words_are_taken_end_by_end():
    """Above the bound and below it the results are the same, and a very long word passes."""
    model, other = lattice.Lattice(PATH), lattice.Lattice(PATH)
    other.LONG = 3
    for word in ("there", "quêteétranger漢😀", "abc" * 40):
        a, b = {}, {}
        model.expected(word, 1.0, a)
        other.expected(word, 1.0, b)
        assert abs(model.log10(word) - other.log10(word)) < 1e-9 and a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    into = {}
    model.expected("xyz" * 60_000, 1.0, into)
    assert model.log10("xyz" * 60_000) < -100_000 and sum(into.values()) > 50_000


def test_learning_helps_held_out_text(spark, sf):
    """The learned pieces give held-out documents more than the prior's do."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = lattice.counted(docs).cache()
    logs, _ = lattice.learned(counts, PATH)
    held = [t for i, t in ((r["doc_id"], r["text"]) for r in docs.collect()) if lattice.held_out(i)]
    prior, model = lattice.Lattice(PATH), lattice.Lattice(PATH, logs)
    words = [w for t in held for w in split(t, lower=True)][:20_000]
    assert sum(map(model.log10, words)) > sum(map(prior.log10, words))


@pytest.mark.parametrize("common", [0, 10, 10**9])
def test_common_words_change_nothing(spark, sf, common):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    a = {r["doc_id"]: r for r in lattice.scores(docs, PATH, common=common).collect()}
    b = {r["doc_id"]: r for r in lattice.scores(docs, PATH).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["n_known"] == b[k]["n_known"] and abs(a[k]["score"] - b[k]["score"]) < 1e-6 and abs(a[k]["base_score"] - b[k]["base_score"]) < 1e-6


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (None, "a b"), (2, "")], "doc_id long, text string")
    got = lattice.scores(df, PATH).collect()
    assert sorted((r["n_tokens"] for r in got)) == [1, 1, 1, 3, 3]
