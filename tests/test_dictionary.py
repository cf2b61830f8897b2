"""Affix dictionaries of our own: rules, conditions, crossing, two levels, flags of three kinds, and the choice of word lists."""

import warnings

import pytest
from scriptorium.config import FULL_LEXICON
from scriptorium.packs.base import get_pack
from scriptorium.sources import tables
from scriptorium.sources.dictionary import affix_table, dictionary

AFF = """SET UTF-8
# own table
NEEDAFFIX !
FORBIDDENWORD ~
SFX A Y 3$
SFX A 0 s [^sy]
SFX A y ies [^aeiou]y
SFX A 0 s [aeiou]y
SFX B N 1
SFX B e ing e
PFX U Y 1
PFX U 0 un .
SFX D Y 1
SFX D 0 er/A [^e]
PFX R N 1
PFX R 0 re [a-m].*
""".replace("[a-m].*", "[abcdefghijklm]")


def forms(entry, aff=AFF):
    t = affix_table(aff.splitlines())
    stem, _, flags = entry.partition("/")
    return t.forms(stem, t.flags(flags))


@pytest.mark.parametrize(
    ("entry", "want"),
    [
        ("cat/A", {"cat", "cats"}), ("city/A", {"city", "cities"}), ("day/A", {"day", "days"}), ("bus/A", {"bus"}), ("make/B", {"make", "making"}), ("do/B", {"do"}),
        ("do/U", {"do", "undo"}), ("lock/AU", {"lock", "locks", "unlock", "unlocks"}), ("tie/BU", {"tie", "tiing", "untie"}),  # B doesn't cross
        ("farm/D", {"farm", "farmer", "farmers"}), ("farm/DU", {"farm", "farmer", "farmers", "unfarm", "unfarmer", "unfarmers"}), ("farm/RA", {"farm", "farms", "refarm"}), ("zoo/R", {"zoo"}),
        ("root/A!", {"roots"}), ("never/A~", set()), ("plain", {"plain"}), ("odd/XYZ", {"odd"}), ("y/A", {"y"}),
    ],
)
def test_forms(entry, want):
    assert forms(entry) == want


def test_kinds_of_flags():
    assert forms("cat/10,7", "FLAG num\nSFX 10 Y 1\nSFX 10 0 s .\nPFX 7 Y 1\nPFX 7 0 re .") == {"cat", "cats", "recat", "recats"}
    assert forms("cat/AaBb", "FLAG long\nSFX Aa Y 1\nSFX Aa 0 s .\nSFX Bb Y 1\nSFX Bb 0 ed .") == {"cat", "cats", "cated"}


def test_signs_in_conditions_stand_for_themselves():
    assert forms("a-/A", "SFX A Y 1\nSFX A 0 x [-+]") == {"a-", "a-x"} and forms("ab/A", "SFX A Y 1\nSFX A 0 x [-+]") == {"ab"}
    assert forms("a^/A", "SFX A Y 1\nSFX A 0 x [b^]") == {"a^", "a^x"}


@pytest.mark.parametrize("aff", ["SFX A Y 2\nSFX A 0 s .", "SFX A 0 s ."])
def test_tables_that_lie_are_refused(aff):
    with pytest.raises(ValueError):
        affix_table(aff.splitlines())


def test_dictionary_as_a_table(spark, tmp_path):
    (tmp_path / "d.aff").write_text(AFF)
    (tmp_path / "d.dic").write_text("6\ncat/A\tpo:noun\nmake/B\ncats\n\nkm\\/h/A\nroot/A!\nnever/~\n")
    got = sorted(r["word"] for r in dictionary(spark, str(tmp_path / "d.aff"), str(tmp_path / "d.dic")).collect())
    assert got == ["cat", "cats", "km/h", "km/hs", "make", "making", "roots"]


def test_choice_of_word_lists(spark, tmp_path):
    """A dictionary after the list and its supplement; the list alone; the pack's own. What fails is said and leaves the next best."""
    base, folder = get_pack("la"), str(tmp_path)
    with pytest.warns(UserWarning, match="no word list"):
        assert tables.pack_from(spark, base, folder).lexicon == ()
    (tmp_path / "lexicon.txt").write_text("# list\nzebra\nant\n")
    (tmp_path / "extra_words.txt").write_text("ant\nowl\n")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert tables.pack_from(spark, base, folder).lexicon == ("zebra", "ant", "owl")
    (tmp_path / "dictionary.dic").write_text("1\ncat/A\n")
    with pytest.warns(UserWarning, match="can't be read"):  # no table of affixes
        assert tables.pack_from(spark, base, folder).lexicon == ("zebra", "ant", "owl")
    (tmp_path / "dictionary.aff").write_text(AFF)
    pack = tables.pack_from(spark, base, folder)
    assert pack.lexicon == ("zebra", "ant", "owl", "cat", "cats") and pack.coverage == 5 / FULL_LEXICON
    with pytest.warns(UserWarning, match="stays a table"):
        assert tables.lexicon_from(spark, base, folder, most=1) == ("zebra", "ant", "owl")
