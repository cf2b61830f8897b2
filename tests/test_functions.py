import random

import pytest
from pyspark.sql import functions as F
from scriptorium.functions import bijoy, identity, normalize, readability, tokenize
from scriptorium.functions.distance import homophone_substitution, osa, soundex, soundex_column
from scriptorium.functions.letters import BLOCK, CONSONANT, expanded, u
from scriptorium.functions.scope import out_of_scope
from scriptorium.packs.base import Pack, get_pack, languages, register

CORPUS = [
    u("986 9AE 9BF 20 9AD 9BE 9A4 20 996 9BE 987 964"), u("9A1 9BC 9A2 9BC 9AF 9BC"), u("9A4 9CD 200D"), u("9CE 9CD"), u("995 9C7 9BE"), u("995 9BE 9C7"), u("995 9C7 9D7"), "a" + u("200B") + "b", u("FEFF") + "x",
    u("995 9CD 9CD 9A4"), "", "   ", "plain English", u("9E7 9E8 9E9"), "!!" + u("964 964"), u("995 200C 9CD 200C 200C"), u("2018") + "q" + u("2019 2026 2014"), u("65 301 A0 3000"), u("995 9BC 9C7 9BE 301"),
]


@pytest.mark.parametrize("text", CORPUS)
def test_normalize_contract(text):
    out, offsets, _ = normalize.normalize(text)
    places = offsets.expanded()
    assert len(places) == len(out) + 1
    assert places == sorted(places) and all(0 <= p <= len(text) for p in places)
    assert normalize.normalize(out)[0] == out


def test_random_text_keeps_the_contract():
    rng = random.Random(1)
    alphabet = expanded(BLOCK) + u("200B 200C 200D 2018 2026 A0 301 65") + " ab"
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))
        out, offsets, _ = normalize.normalize(text)
        places = offsets.expanded()
        assert len(places) == len(out) + 1 and places == sorted(places) and places[-1] == len(text)


def test_dotted_letters_are_composed():
    assert normalize.normalize(u("9A1 9BC"))[0].encode() == bytes.fromhex("e0a79c")
    assert normalize.normalize(u("9A4 9CD 200D"))[0] == u("9CE")
    assert normalize.normalize(u("995 9CD 200C 200C 9A4"))[0] == u("995 9CD 200C 9A4")
    assert normalize.normalize(u("9E7 9E8"), fold_digits=True)[0] == "12"


def test_double_danda_is_not_folded():
    assert normalize.normalize(u("965"))[0] == u("965")


def test_sentences():
    cut = lambda t, r=tokenize.BENGALI: [t[a:b] for a, b in tokenize.sentences(t, r)]
    d = u("964")
    assert cut(f"a{d}\" b. c?!  \n\nd") == [f"a{d}\"", "b. c?!", "d"]
    assert cut("  ") == [] and cut("") == []
    assert cut("One. Two.) three", tokenize.LATIN) == ["One.", "Two.)", "three"]


def test_tokens():
    got = [(t, w) for _, _, t, w in tokenize.tokens("it's 1,000.5 " + u("9E7 2E 9E8") + " é " + u("9F3 9EB"))]
    assert got == [("it's", True), ("1,000.5", True), (u("9E7"), True), (".", False), (u("9E8"), True), (" é ", False), (u("9F3 9EB"), True)]
    text = "a, b"
    assert all(text[a:b] == t for a, b, t, _ in tokenize.tokens(text))


def test_osa():
    assert osa("ab", "ba") == 1 and osa("CA", "ABC") == 3 and osa("", "abc", 2) == 3 and osa("abcd", "badc") == 2


def test_soundex_column_is_soundex(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice(expanded(CONSONANT) + u("9BE 9BF 9C0 9CD 981 986 987")) for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", soundex_column(F.col("w")).alias("k")).collect()
    assert [r["k"] for r in rows] == [soundex(r["w"]) for r in rows]


def test_homophones():
    assert homophone_substitution(u("9B6 9AC"), u("9B8 9AC"))
    assert not homophone_substitution(u("995 9AC"), u("9B8 9AC")) and not homophone_substitution(u("9B6"), u("9B6"))


def test_bijoy_is_detected_and_not_converted():
    text = "Avgvi †mvbvi ‡ Š evsjv ‹ Œ"
    assert bijoy.looks_like(text) and bijoy.convert(text) == text
    assert not bijoy.looks_like("plain text") and bijoy.coverage("  12") == 1.0
    assert [bijoy.convert(x) for x in ("evsjv", "Zzwg")] == ["বাংলা", "তুমি"] and bijoy.reordered(u("9BF 995 9CD 9A4")) == u("995 9CD 9A4 9BF")


def test_syllables(spark):
    words = [u("986 9AE 9BF"), u("9AC 9CD 9AF 9BE"), u("995"), u("9CD")]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(readability.syllables_column(F.col("w"))).collect()]
    assert got == [readability.syllables(w) for w in words] == [2, 1, 1, 1]


def test_readability(spark):
    empty = readability.score("English only.")
    assert empty == dict.fromkeys(readability.FIELDS, 0.0) | {"mean_sentence_length": None}
    easy, hard = readability.score(u("986 9AE 9BF 20 9AF 9BE 987 964")), readability.score(u("995 9CD 9B7 9A3 9BF 995 9A4 9BE 20 9AC 9BF 9B6 9C7 9B7 9A3 964"))
    assert 0 <= hard["score"] < easy["score"] <= 100
    assert spark.createDataFrame([("x",)], "t string").select(readability.scored(F.col("t")).alias("r")).first()["r"]["mean_sentence_length"] is None


def test_scope(spark):
    text = u("986 9AE 9BF") + " hello big world " + u("9AC 987") + " a 12 ok go"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [text[r["start"] : r["end"]] for r in out_of_scope(docs).orderBy("start").collect()]
    assert got == ["hello big world", "ok go"]


def test_identity():
    p = identity.phrase(bytes(range(11)))
    assert identity.parsed(p.upper().replace(" ", ", ")) == bytes(range(11))
    for bad in (p.rsplit(" ", 1)[0], "zzz " + p.split(" ", 1)[1], p.rsplit(" ", 1)[0] + " " + ("bala" if not p.endswith("bala") else "bale")):
        with pytest.raises(ValueError):
            identity.parsed(bad)
    assert identity.verified(p, b"k", identity.digest(p, b"k")) and not identity.verified(p, b"j", identity.digest(p, b"k"))
    assert identity.uuid7(1)[14] == "7" and int(identity.uuid7(1700000000000).replace("-", "")[:12], 16) == 1700000000000


def test_registry():
    assert languages()[:2] == ["bn", "la"] and get_pack("la") is get_pack("la")
    with pytest.raises(KeyError):
        get_pack("xx")
    register("yy", lambda: Pack(code="other", rules=tokenize.LATIN))
    with pytest.raises(ValueError):
        get_pack("yy")


def test_native_folds_are_the_kernel(spark):
    text = "a" + u("A0 3000 200B") + u("2018 2026")
    row = spark.createDataFrame([(text,)], "t string").select(normalize.punctuation_folded(normalize.space_like_folded(normalize.invisibles_stripped(F.col("t"))))).first()
    assert row[0] == normalize.normalize(text)[0]


def test_readability_keys_and_rounding():
    """Two words of 2 and 3 syllables, one learned, and one word: places as documented."""
    got = readability.score("আমি লক্ষণ। যাই।")
    assert set(got) == set(readability.FIELDS) and (got["words"], got["sentences"]) == (3.0, 2.0)
    assert got["syllables_per_word"] == 2.333 and got["tatsama_density"] == 0.333 and got["sentence_length_variance"] == 0.25
    for w in ("বিষয়", "কারণ", "ঋণ", "কৃষক", "দুঃখ", "বাক্য", "প্রাণ", "বিশ্ব", "রক্ষা", "জ্ঞান"):
        assert readability.tatsama(w), w
    assert not any(map(readability.tatsama, ("আমি", "ভাত", "উৎস", "মা")))


def brute_osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_osa_within_a_band():
    import random
    import time

    from scriptorium.functions.distance import osa

    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        want = brute_osa(a, b)
        assert osa(a, b) == want
        for limit in (0, 1, 2, 3):
            assert osa(a, b, limit) == min(want, limit + 1), (a, b, limit)
    began = time.process_time()
    assert osa("ab" * 50_000, "ba" * 50_000, 2) == 2
    assert time.process_time() - began < 5


def test_keys_of_long_words(spark):
    from scriptorium.functions.distance import latin_key

    n = (1 << 20) + 5
    row = spark.createDataFrame([("b" + "t" * n + "l",)], "w string").select(latin_key(F.col("w")).alias("k")).first()
    assert len(row["k"]) == n + 2 and row["k"][-1] == "4"
