import random
from hashlib import sha256

import pytest
from scriptorium.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def same(library, text):
    codec = bpe.codec(bpe.vocabulary_path())
    raw = codec.encode(text)
    ids = library.encode(text, add_special_tokens=False).ids
    assert raw == b"".join(i.to_bytes(4, "little") for i in ids), text[:80]
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


TEXTS = [
    "", " ", "Hello, World's 'LL don't", "Ünïcödé ÀÉ ΣΑΣ İstanbul ǅ", "a<|endoftext|>b <|startoftext|>", "123 4５ ①②", "x" * 3000, "ab" * 500,
    "日本語 テスト 　 \x1c\x1d \x85   end", "é 가 ﬁ क़", "👩‍👩‍👧 🇩🇪!?..", "\x00\x01\t\n\r", "'s't're've'm'll'd'",
]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(library, text):
    same(library, text)


def test_random_texts(library):
    rng = random.Random(3)
    alphabet = "abcdeinst '.,-!<|>12 \n\t" + "éßñüΣσİ٣²½€…—“”漢字カ" + "̀́ ​"
    for _ in range(300):
        same(library, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))))


def test_documents(library, spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = {}
    for r in df.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    from scriptorium.llm.queries import op4_bpe

    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op4_bpe(spark, sf).collect()} == want


def test_segment_tree_root_is_leftmost_least():
    tree = bpe.PairTree([5 << 4 | 0, 3 << 4 | 1, 3 << 4 | 2])
    assert tree.root() & 15 == 1
    tree.put(1, 9 << 4 | 1)
    assert tree.root() & 15 == 2


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "n"), (1, None, "n"), (None, "Hello", "n"), (3, "", "n")], "doc_id long, text string, __note string")
    got = sorted(((r["doc_id"], r["__sc_n"], list(r["__sc_ids"]), r["__sc_text"]) for r in bpe.decoded(bpe.encoded(df, bpe.vocabulary_path(), arrays=True), bpe.vocabulary_path(), "__sc_ids").collect()), key=repr)
    assert [g[1] for g in got] == [0, 0, 0, 1]
    assert got[3][3] == "hello</w>"
    back = bpe.decoded(spark.createDataFrame([([got[3][2][0]],), (None,)], "ids array<int>"), bpe.vocabulary_path()).collect()
    assert [r["__sc_text"] for r in back] == ["hello</w>", None]
    assert bpe.encoded(df.limit(0), bpe.vocabulary_path()).count() == 0
