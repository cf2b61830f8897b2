import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from scriptorium.config import ERROR_CLASSES
from scriptorium.sources import tables

ROOT = Path(__file__).resolve().parent.parent / "scriptorium"


def test_texts_and_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    assert [r["text"] for r in tables.texts(spark, str(tmp_path)).collect()] == ["x\ny"]
    assert tables.lines(spark, str(tmp_path)).count() == 2


def test_gold(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"id": "1", "text": "a b", "error_class": "NON_WORD", "wrong": "b"}\n')
    assert tables.gold(spark, str(tmp_path / "g.json")).first()["wrong"] == "b"
    (tmp_path / "h.json").write_text('{"id": "1"}\n{"id": "1"}\n')
    with pytest.raises(ValueError):
        tables.gold(spark, str(tmp_path / "h.json"))


def test_specs(spark):
    rows = [(c, "l", "t", "n", "r", 3) for c in ERROR_CLASSES]
    assert tables.class_specs(spark.createDataFrame(rows, tables.SPEC)).count() == 12
    for bad in (rows[1:], [*rows[1:], (rows[0][0], "l", "t", "n", "r", 2)], [*rows[1:], (rows[0][0], "", "t", "n", "r", 3)]):
        with pytest.raises(ValueError):
            tables.class_specs(spark.createDataFrame(bad, tables.SPEC))


def test_baseline_and_events(spark, tmp_path):
    df = spark.createDataFrame([("A", 0.5)], "error_class string, f05 double")
    tables.write_baseline(df, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b")).first()["f05"] == 0.5
    tables.append_events(df, str(tmp_path / "e"))
    tables.append_events(df, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    tables.clear_events(spark, "error_class string, f05 double", str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 0


def test_affix_headers(spark):
    rows = spark.createDataFrame([("SFX A Y 12$",), ("SFX A Y 12",), ("SFX A 0 x$ .",)], "l string")
    got = [r[0] for r in rows.select(tables.affix_header_repaired(F.col("l"))).collect()]
    assert got == ["SFX A Y 12", "SFX A Y 12", "SFX A 0 x$ ."]


def test_core_names_no_language():
    for p in (ROOT / "operators").glob("*.py"):
        found = {c for c in p.read_text(encoding="utf-8") if 0x980 <= ord(c) <= 0x9FF}
        assert not found, p


def test_pack_words_are_composed():
    from scriptorium.packs.bn import PACK

    dotted = re.compile("[ডঢয]়")
    for name, value in vars(PACK).items():
        if name not in ("rules", "code"):
            assert not dotted.search(repr(value)), name


def test_nothing_else_imports_llm():
    for p in ROOT.rglob("*.py"):
        if "llm" not in p.parts:
            assert "scriptorium.llm" not in p.read_text(encoding="utf-8"), p


def test_gold_folders(spark, tmp_path):
    """A file for each class; one file without them; an id that two files share raises."""
    import json

    row = lambda i, c: json.dumps({"id": i, "text": "teh", "error_class": c, "wrong": "teh", "right": "the", "review": "human", "source": "own"})
    (tmp_path / "a" / "errors").mkdir(parents=True)
    (tmp_path / "a" / "errors" / "homonym.json").write_text(row("1", "HOMONYM"))
    (tmp_path / "a" / "errors" / "non_word.json").write_text(row("2", "NON_WORD") + "\n" + row("3", "NON_WORD"))
    assert tables.gold(spark, str(tmp_path / "a")).count() == 3
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "errors.json").write_text(row("1", "HOMONYM"))
    assert tables.gold(spark, str(tmp_path / "b")).count() == 1
    (tmp_path / "a" / "errors" / "z.json").write_text(row("2", "HOMONYM"))
    with pytest.raises(ValueError, match="'2' is there twice"):
        tables.gold(spark, str(tmp_path / "a"))


def test_packs_from_files(spark, tmp_path):
    """Tables and word lists of a folder replace the pack's; without a word list there is a warning, and unknown words stay damped."""
    from scriptorium.operators.detect import Checker
    from scriptorium.packs.base import get_pack

    (tmp_path / "violations.csv").write_text("wrong,right\nকখগ,গখক\n", encoding="utf-8")
    (tmp_path / "standard_forms.jsonl").write_text('{"wrong": "খখ", "right": "গগ"}\n', encoding="utf-8")
    with pytest.warns(UserWarning, match="no word list"):
        pack = tables.pack_from(spark, get_pack("bn"), str(tmp_path))
    assert pack.violations == {"কখগ": "গখক"} and pack.standard_forms == {"খখ": "গগ"} and pack.coverage < 0.01
    assert all(e.confidence < 0.55 for e in Checker(pack).check("ঘঘঘঝ") if e.rule.startswith("unknown"))
    (tmp_path / "lexicon.txt").write_text("# words\n" + "\n".join(["আমি", "তুমি"]) + "\n", encoding="utf-8")
    pack = tables.pack_from(spark, get_pack("bn"), str(tmp_path))
    assert pack.lexicon == ("আমি", "তুমি") and 0 < pack.coverage < 1
    (tmp_path / "violations.csv").write_text("wrong,right\nক,খ\nক,গ\n", encoding="utf-8")
    with pytest.raises(ValueError, match="two values"):
        tables.pack_from(spark, get_pack("bn"), str(tmp_path))


def test_eval_command(spark, tmp_path, capsys):
    """Cases of three classes and clean sentences: the report, the headline, the baseline and the gate."""
    import json

    from scriptorium import cli

    (tmp_path / "errors").mkdir()
    row = lambda i, t, c, w, r: json.dumps({"id": i, "text": t, "error_class": c, "wrong": w, "right": r, "review": "human", "source": "own"}, ensure_ascii=False)
    (tmp_path / "errors" / "a.json").write_text("\n".join([row("1", "সে কারন জানে না।", "NOTVA_SHOTVA", "কারন", "কারণ"), row("2", "সে লবণ জানে।", "NOTVA_SHOTVA", "লবণ", "x")]), encoding="utf-8")
    (tmp_path / "errors" / "b.json").write_text(row("3", "ভালো ,আমি।", "PUNCTUATION", " ,", ","), encoding="utf-8")
    (tmp_path / "clean.txt").write_text("আমি ভালো।\n", encoding="utf-8")
    assert cli.main(["eval", str(tmp_path), "--update-baseline", str(tmp_path / "base")]) == 0
    out = capsys.readouterr()
    assert "| NOTVA_SHOTVA | 2 | 1 | 0 | 1 |" in out.out and '"gold_total":3' in out.out and "no_baseline" in out.err
    assert cli.main(["eval", str(tmp_path), "--baseline", str(tmp_path / "base")]) == 0
    assert cli.main(["eval", str(tmp_path), "--baseline", str(tmp_path / "base"), "--strict"]) == 1


def test_a_baseline_has_all_its_classes(spark, tmp_path):
    df = spark.createDataFrame([("A", 0.5), ("B", 0.25), ("C", 0.0)], "error_class string, f05 double")
    tables.write_baseline(df, str(tmp_path / "b"))
    assert sorted(map(tuple, tables.read_baseline(spark, str(tmp_path / "b")).select("error_class", "f05").collect())) == [("A", 0.5), ("B", 0.25), ("C", 0.0)]
