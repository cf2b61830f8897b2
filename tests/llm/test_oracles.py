"""Queries with SQL give the same rows as DuckDB, on the small tables and on hard rows."""

import duckdb
import pyarrow.parquet as pq
import pytest
from scriptorium.llm.queries import ORACLE_SQL, QUERIES

NAMES = sorted(ORACLE_SQL)


def both(spark, name, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: repr(r)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=key), sorted(found.fetchall(), key=key)


@pytest.mark.parametrize("name", NAMES)
def test_small_tables(spark, sf, name):
    got, want = both(spark, name, sf)
    assert got and got == want


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """Nulls, empty and long texts, ties, repeated rows, and columns that clash."""
    d = tmp_path_factory.mktemp("hard")
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n\x0b ", "en", None), (4, long, "en", "a"), (5, long, "en", "a"), (6, passage, "de", "b"), (7, "x " + passage + " y", "de", "b"),
        (7, "x " + passage + " y", "de", "b"), (8, "same line\n" * 9, "en", "a"), (9, "#$% |" * 40, "en", "a"), (10, "Ä ö ß " * 20, "de", "b"), (11, "A B c D e f g h i j k", "en", "a"),
        (12, "end\r\nend\r\nEnd", "en", "a"), (13, " ".join(f"p{i}" for i in range(12)), "de", "b"), (14, passage.upper(), "de", "b"),
    ] + [(100 + i, f"a clean text of number {i} that has no window in common with the others at {i * i}", "en", "a") for i in range(250)]
    spark.createDataFrame([(*r, len(r[1] or ""), "z", 1) for r in docs], "doc_id long, text string, lang string, source string, n_chars long, n_words string, __bucket int").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, passage), (3, "a b c"), (4, None), (5, ""), (6, "end"), (10, "Ä ö ß Ä ö ß Ä ö ß Ä ö ß")], "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    page = "<p>" + "text " * 40
    pages = [(1, "u", page), (2, None, page), (2, None, page), (3, "u\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "ü", "ä" * 50_000), (8, "u", "ä" * 50_000), (9, "u", "é" * 49), (10, "u", "é" * 49)]
    spark.createDataFrame([(*r, "c") for r in pages], "page_id long, url string, html string, payload string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (2, 0, "user", "alone"), (3, 0, "assistant", "x"), (3, 1, "assistant", "x"), (4, 0, None, None),
        (4, 1, "assistant", None), (5, None, "user", "first"), (5, 0, "user", "t"), (5, 0, "user", "t"), (None, 0, "user", "lost"), (6, 0, "assistant", "ü😀"), (6, 1, "user", "z" * 9000), (6, 2, "assistant", "q"), (6, 3, "user", "end"),
    ]
    spark.createDataFrame([(*t, "c") for t in turns], "conv_id long, turn long, role string, text string, turns string").coalesce(1).write.parquet(f"{d}/conversations.parquet")
    for t in ("documents", "benchmark", "pages", "conversations"):
        part = next((d / f"{t}.parquet").glob("part-*"))
        data = pq.read_table(part)
        for x in (d / f"{t}.parquet").iterdir():
            x.unlink()
        (d / f"{t}.parquet").rmdir()
        pq.write_table(data, d / f"{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_hard_rows(spark, hard, name):
    got, want = both(spark, name, hard)
    assert got and got == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, sf, tmp_path, name):
    for t in ("documents", "pages", "benchmark", "conversations"):
        pq.write_table(pq.read_table(f"{sf}/{t}.parquet").slice(0, 0), tmp_path / f"{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def hard_docs(hard):
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{hard}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


def test_hard_fingerprints(spark, hard):
    from itertools import combinations

    from tests.llm.brute import connected
    from tests.llm.test_simhash import brute_fingerprint

    docs = hard_docs(hard)
    prints = {t: brute_fingerprint(t) for _, t in docs}
    nodes = sorted(set(prints.values()))
    root = connected(nodes, [(x, y) for x, y in combinations(nodes, 2) if (x ^ y).bit_count() <= 2])
    least = {}
    for i, t in docs:
        least[root[prints[t]]] = min(i, least.get(root[prints[t]], i))
    want = sorted((i, f"{prints[t]:016x}", least[root[prints[t]]]) for i, t in docs)
    assert sorted(map(tuple, QUERIES["op1_simhash_near_duplicates"](spark, hard).collect())) == want


def test_hard_licences(spark, hard):
    from scriptorium.llm import licenses

    from tests.llm.test_licenses import brute_scan

    docs = spark.read.parquet(f"{hard}/documents.parquet").select("doc_id", "text")
    model = licenses.fit(licenses.negatives(docs))
    found = [(i, brute_scan(model, t)) for i, t in hard_docs(hard)]
    want = sorted((i, len(x), ",".join(sorted({f for f, _, _ in x})), ",".join(f"{f}:{a}:{b}" for f, a, b in x)) for i, x in found)
    assert sorted(map(tuple, QUERIES["op3_license_scan"](spark, hard).collect())) == want


def test_hard_tokens(spark, hard):
    from hashlib import sha256

    from scriptorium.llm import bpe
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation()
    want = []
    for i, t in hard_docs(hard):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op4_bpe"](spark, hard).collect())) == sorted(want)


def test_hard_secrets(spark, hard):
    from tests.llm.test_secrets import brute

    got = sorted((r["doc_id"], r["spans"]) for r in QUERIES["op7_secret_scan"](spark, hard).collect())
    assert got == sorted((i, ",".join(brute(t))) for i, t in hard_docs(hard))


def test_hard_scores(spark, hard):
    from tests.llm.test_lattice import brute_rows, same_rows

    same_rows(QUERIES["op8_lattice_scores"](spark, hard).collect(), brute_rows(hard_docs(hard)))
