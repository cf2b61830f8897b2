"""Breakpoint maps against an origin for every character, and the one pass against the columns."""

import random
import re
import unicodedata
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from scriptorium.config import PipelineConfig
from scriptorium.functions import normalize as n
from scriptorium.functions.letters import BLOCK, HASANTA, expanded, u
from scriptorium.functions.normalize import normalized
from scriptorium.functions.offsets import Offsets, remapped
from scriptorium.operators.detect import Checker, edits
from scriptorium.operators.resolve import edit_rows, resolved
from scriptorium.packs.base import get_pack
from scriptorium.plans.check import accept_all, check


def plain(text):
    """The passes with an origin for every character."""
    origin = [*range(len(text) + 1)]

    def table(t, o, entries):
        out, places, i = "", [], 0
        keys = sorted(entries, key=lambda s: -len(s))
        while i < len(t):
            k = next((k for k in keys if t.startswith(k, i)), None)
            out += entries[k] if k else t[i]
            places += [o[i]] * (len(entries[k]) if k else 1)
            i += len(k) if k else 1
        return out, [*places, o[-1]]

    def keep(t, o, stays):
        at = [i for i in range(len(t)) if stays(t, i)]
        return "".join(t[i] for i in at), [o[i] for i in at] + [o[-1]]

    def nfc(t, o):
        out, places = "", []
        for a, b in n.clusters(t):
            new = unicodedata.normalize("NFC", t[a:b])
            own = o[a:b]
            places += own if new == t[a:b] else [own[min(i, len(own) - 1)] if len(new) >= len(own) else own[0] for i in range(len(new))]
            out += new
        return out, [*places, o[-1]]

    for step in (
        lambda t, o: keep(t, o, lambda t, i: t[i] not in n.INVISIBLE), lambda t, o: table(t, o, dict.fromkeys(n.SPACE_LIKE, " ")), lambda t, o: table(t, o, n.KHANDA_TA),
        lambda t, o: keep(t, o, lambda t, i: t[i] != n.ZWJ), lambda t, o: keep(t, o, lambda t, i: t[i] != n.ZWNJ or (i > 0 and t[i - 1] == HASANTA)), nfc,
        lambda t, o: table(t, o, n.NUKTA), lambda t, o: table(t, o, n.VOWEL_SIGNS), lambda t, o: table(t, o, n.PUNCTUATION),
        lambda t, o: keep(t, o, lambda t, i: not (i and t[i] == HASANTA == t[i - 1])),
    ):
        text, origin = step(text, origin)
    return text, origin


def some_texts(seed, k, size=40):
    rng = random.Random(seed)
    alphabet = expanded(BLOCK) + u("200B 200C 200D 2018 2026 2014 A0 301 65 9CD 9CD 9BC 9C7 9BE") * 3 + " ab\t"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(size))) for _ in range(k)]


def test_equal_origins_on_random_texts():
    for text in some_texts(1, 800):
        new, offsets, _ = n.normalize(text)
        assert (new, offsets.expanded()) == plain(text)


def test_size_follows_changes():
    text = ("word " * 2000 + u("2026")) * 5
    new, offsets, rules = n.normalize(text)
    assert rules == ["punct_fold"] and len(new) == len(text) + 10 and len(offsets) <= 3 * 5 + 2
    assert len(n.normalize("plain " * 10_000)[1]) == 1


@pytest.mark.parametrize("seed", range(30))
def test_changes_compose(seed):
    rng = random.Random(seed)
    size, origin, offsets = 50, [*range(51)], Offsets(50)
    for _ in range(4):
        cuts = sorted(rng.sample(range(size + 1), 2 * rng.randint(0, 4)))
        changes = [(a, b, tuple(sorted(rng.randrange(b - a) for _ in range(rng.randint(0, 4))))) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        new, at = [], 0
        for a, b, local in changes:
            new += origin[at:a] + [origin[a + i] for i in local]
            at = b
        origin = new + origin[at:]
        offsets = offsets.over(changes)
        size = len(origin) - 1
        assert offsets.size == size and offsets.expanded() == origin
    assert offsets[10**6] == origin[-1]


def test_flat_map_of_a_converted_text():
    assert Offsets.flat(4, 9).expanded() == [0, 0, 0, 0, 9] and Offsets.flat(0, 3).expanded() == [3]
    assert Offsets.flat(4, 9).over([(1, 3, ())]).expanded() == [0, 0, 9]


def test_text_that_is_detected_and_not_converted_keeps_its_places():
    """Spanish capitals hold a sign of the legacy font; as nothing is converted, nothing moves."""
    text = "OSÓ DOÑA\nMIÓÓ !! CIÓN,, " + u("200B") + "DÓ!!"
    new, offsets, rules = n.normalize(text)
    assert rules == ["bijoy_to_unicode", "strip_invisibles"] and new == text.replace(u("200B"), "")
    assert offsets.expanded() == [i for i, c in enumerate(text) if c != u("200B")] + [len(text)]
    # A text that is converted comes from its first character.
    assert n.normalize("evsjv" + u("B2") * 4)[1].expanded() == [0] * 9 + [9]


def test_column_form_searches_alike(spark):
    rows = [(i, t) for i, t in enumerate(some_texts(2, 60))]
    docs = spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", normalized(F.col("text")).alias("n"))
    places = F.explode(F.sequence(F.lit(0), F.length("n.text") + 2)).alias("p")
    got = docs.select("doc_id", "n", places).select("doc_id", "p", remapped(F.col("p"), F.col("n.offset_map"), F.length("n.text")).alias("q")).collect()
    want = {i: n.normalize(t)[1] for i, t in rows}
    assert got and all(r["q"] == want[r["doc_id"]][r["p"]] for r in got)


def bengali(seed, k):
    rng = random.Random(seed)
    words = ["সে", "কারন", "জানে", "না", "বাড়ী", "ভালো", "অনেক", "বইগুলো", "একটা", "শিক্ষক", "তাহারা", "করছে", "মানুশ", u("2026"), "আমি", u("200B"), "ক" + u("9CD 9CD") + "ষ", "  ", "।", " ,", "!!", u("A0"), "x"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(k)]


@pytest.mark.parametrize("config", [PipelineConfig(), PipelineConfig(min_confidence=0.8, max_edits=3, max_suggestions=1), PipelineConfig(enabled_classes=("PUNCTUATION", "NON_WORD"))])
def test_one_pass_equals_detectors_then_resolver(spark, config):
    docs = spark.createDataFrame([*bengali(3, 40), (1, "ভালো ,আমি"), (None, "ভালো ,আমি"), (90, None), (91, "")], "doc_id int, text string")
    fields = ("doc_id", "start", "end", "original", "suggestions", "error_class", "confidence", "stage", "rule", "seq", "surfaced")
    one = sorted(map(repr, check(docs, "bn", config)["edits"].select(*fields).collect()))
    texts = [(r["doc_id"], n.normalize(r["text"])) for r in docs.collect()]
    maps = {}
    for i, (t, o, _) in texts:
        maps.setdefault((i, t), o)
    plain_docs = spark.createDataFrame([(k, i, t) for k, (i, (t, _, _)) in enumerate(texts)], "k int, doc_id int, text string")
    found = edit_rows(resolved(edits(plain_docs, get_pack("bn"), "k"), config, "k"), "k").collect()
    two = []
    for r in found:
        i, (_, o, _) = texts[r["k"]]
        d = r.asDict() | {"doc_id": i, "start": o[r["start"]], "end": o[r["end"]]}
        two.append([d[f] for f in fields])
    back = spark.createDataFrame(two, check(docs, "bn")["edits"].select(*fields).schema)
    assert one == sorted(map(repr, back.collect())) and len(one) > 20


def test_packs_with_own_columns_go_the_other_way(spark):
    from scriptorium.packs import base

    none = lambda text: F.lit(None).cast(f"array<struct<{','.join(x.replace(' ', ':', 1) for x in __import__('scriptorium.config', fromlist=['EDIT_DDL']).EDIT_DDL.split(', '))}>>")
    base.register("zz_bn", lambda: replace(get_pack("bn"), code="zz_bn", detectors=(none,)))
    docs = spark.createDataFrame(bengali(4, 25), "doc_id int, text string")
    a, b = (sorted(map(repr, check(docs, c)["edits"].collect())) for c in ("bn", "zz_bn"))
    assert a == b and a
    a, b = (sorted(map(repr, accept_all(docs, c).collect())) for c in ("bn", "zz_bn"))
    assert a == b


def test_a_pack_without_words_is_checked_for_marks_only():
    assert [e.rule for e in Checker(get_pack("la")).check("a ,b  c!!")] == ["space_before", "repeated_mark", "multiple_spaces"]
    assert re.search(r"\S", "a")
