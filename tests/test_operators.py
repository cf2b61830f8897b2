import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from scriptorium.config import ERROR_CLASSES, Gates, PipelineConfig
from scriptorium.functions.normalize import normalize
from scriptorium.operators import evaluate, lexicon, limits, resolve, store, usage
from scriptorium.operators.detect import Checker, Edit, edits
from scriptorium.packs.base import get_pack
from scriptorium.plans.check import accept_all, check


@pytest.fixture(scope="module")
def checker():
    return Checker(get_pack("bn"))


def rules(checker, text):
    return [(e.rule, e.original, e.suggestions[:1]) for e in checker.check(normalize(text)[0]) if not e.rule.startswith("unknown")]


POSITIVE = [
    ("সে কারন জানে না।", "violation"), ("বাড়ী ভালো।", "standard_form"), ("দিন দুঃখী মানুষ।", "collocation"), ("নদীর কুল ভালো।", "collocation"), ("অনেক বইগুলো।", "double_plural"), ("অনেক ভালো বইগুলো।", "double_plural"),
    ("একটা শিক্ষক।", "animacy"), ("একজন ভালো বই।", "animacy"), ("বইরা ভালো।", "animate_plural"), ("তারা তার কাজ জানে।", "possessive"), ("ছাত্ররা তার কাজ জানে।", "possessive"), ("তাহারা কাজ করছে।", "register_clash"),
    ("আমি ভাত করছে।", "verb_person"), ("তুমি কাজ করছি।", "verb_person"), ("আপনি বই পড়ছো।", "verb_person"), ("ভালো ,আমি।", "space_before"), ("ভালো,আমি।", "missing_space"), ("ভালো!!", "repeated_mark"), ("ভালো  আমি।", "multiple_spaces"), ("আমি ভালো.", "latin_period"),
]
NEGATIVE = [
    "সে কারণ জানে না।", "বাড়ি ভালো।", "দিন ভালো।", "নদীর কূল ভালো।", "অনেক বই।", "বইগুলো ভালো।", "একটি বই।", "একজন শিক্ষক।", "শিক্ষকরা ভালো।", "তারা তাদের কাজ জানে।", "সে তার কাজ জানে।", "তারা কাজ করছে।",
    "আমি কাজ করছি।", "তুমি কাজ করছো।", "আমি এবং তুমি কাজ করছে।", "ভালো, আমি।", "ভালো! আমি?", "3.5 a.b", "a  ",
]


@pytest.mark.parametrize(("text", "rule"), POSITIVE)
def test_rule_fires(checker, text, rule):
    assert rule in [r for r, *_ in rules(checker, text)], rules(checker, text)


@pytest.mark.parametrize("text", NEGATIVE)
def test_nothing_fires(checker, text):
    assert rules(checker, text) == []


def test_unknown_words_and_budget(checker):
    out = [e for e in checker.check("ঘঘঘঝ " * 30) if e.error_class == "NON_WORD"]
    assert len(out) == 30
    near = [e for e in checker.check(normalize("মানুশ।")[0]) if e.error_class == "NON_WORD"]
    assert near and "মানুষ" in near[0].suggestions and near[0].confidence == 0.72


def test_drift(checker):
    modern, archaic = "আমি কাজ করছি। ", "তাহারা কাজ জানে। "
    found = [e for e in checker.check(normalize(modern * 4 + archaic)[0]) if e.rule == "register_drift"]
    assert len(found) == 1 and found[0].end - found[0].start == 1 and found[0].original == ""
    assert not [e for e in checker.check(normalize(modern * 2 + archaic)[0]) if e.rule == "register_drift"]


def test_edit_is_validated():
    for bad in ((-1, 0, 0.5), (2, 1, 0.5), (0, 1, 1.5)):
        with pytest.raises(ValueError):
            Edit(bad[0], bad[1], "", (), "NON_WORD", bad[2], "r")


def test_kept_edits_never_overlap(spark):
    rng = random.Random(4)
    ddl = "doc_id int, edits array<struct<start:int,end:int,original:string,suggestions:array<string>,error_class:string,confidence:double,stage:int,rule:string,seq:int>>"
    docs = []
    for d in range(30):
        es = []
        for n in range(rng.randrange(25)):
            a = rng.randrange(60)
            es.append((a, a + rng.randrange(8), "o", ["s"] * 7, rng.choice(["NON_WORD", "HOMONYM"]), rng.choice([0.4, 0.55, 0.7, 0.9]), rng.choice([0, 1]), "r", n))
        docs.append((d, es))
    got = {r["doc_id"]: r for r in resolve.resolved(spark.createDataFrame(docs, ddl), PipelineConfig(max_edits=6)).collect()}
    for d, es in docs:
        kept, rest = [], []
        for e in sorted(es, key=lambda e: (-e[5], -e[6], e[1] - e[0], e[0], e[8])):
            ok = e[5] >= 0.55 and not any(e[0] < k[1] and k[0] < e[1] for k in kept)
            (kept if ok else rest).append(e)
        kept.sort(key=lambda e: (e[0], e[8]))
        assert [k["seq"] for k in got[d]["kept"]] == [k[8] for k in kept[:6]]
        assert sorted(k["seq"] for k in got[d]["suppressed"]) == sorted(k[8] for k in rest + kept[6:])
        assert all(len(k["suggestions"]) == 5 for k in got[d]["kept"])
    only = resolve.resolved(spark.createDataFrame(docs, ddl), PipelineConfig(enabled_classes=("HOMONYM",)))
    assert {e["error_class"] for r in only.collect() for e in (*r["kept"], *r["suppressed"])} == {"HOMONYM"}


def test_check_maps_back_to_the_submitted_text(spark):
    text = "​আমি “ভাত” কারন  জানি।"
    docs = spark.createDataFrame([(1, text), (2, "x" * 200_001), (3, None)], "doc_id int, text string")
    assert check(docs)["too_long"].count() == 0 and check(docs)["readability"].count() == 3
    out = check(docs, config=PipelineConfig(max_text=200_000))
    rows = [r for r in out["edits"].collect() if r["rule"] == "violation"]
    assert [text[r["start"] : r["end"]] for r in rows] == ["কারন"]
    assert [r["doc_id"] for r in out["too_long"].collect()] == [2]
    assert out["sentences"].filter("doc_id = 1").count() == 1
    assert out["stage_report"].collect()[0]["edits_emitted"] >= 2
    assert out["readability"].count() == 2 and out["out_of_scope"].count() == 0


def test_accept_all(spark):
    docs = spark.createDataFrame([(1, "ভালো , আমি!!")], "doc_id int, text string")
    assert accept_all(docs).first()["text"] == normalize("ভালো, আমি!")[0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_check_is_one_pass(spark):
    """Repeated and null ids keep their own edits; no exchange, no join, and one pass of Python over the text."""
    docs = spark.createDataFrame([(1, "ক , খ!!  গ"), (1, "ক , খ!!  গ"), (None, "ঘ!!"), (2, "ঙ")], "doc_id int, text string")
    out = check(docs, "la")
    found = [r["doc_id"] for r in out["edits"].filter("error_class = 'PUNCTUATION'").collect()]
    assert sorted(found, key=repr) == [1] * 6 + [None]
    for df in (out["edits"], out["out_of_scope"], out["readability"], accept_all(docs), check(docs)["edits"]):
        assert "Exchange" not in plan_of(df) and "Join" not in plan_of(df)
    assert plan_of(out["edits"]).count("MapInArrow") == 1 and "ArrowEvalPython" not in plan_of(out["edits"])
    assert sorted((r["doc_id"], r["text"]) for r in accept_all(docs, "la").collect() if r["doc_id"]) == [(1, "ক, খ! গ"), (1, "ক, খ! গ"), (2, "ঙ")]
    assert accept_all(docs).count() == 4


def test_many_edits_in_one_text(spark):
    import time

    docs = spark.createDataFrame([(1, "ক !!  " * 20_000)], "doc_id int, text string")
    began = time.time()
    kept = resolve.resolved(edits(docs, get_pack("la")), PipelineConfig(max_edits=1 << 30)).select(F.size("kept").alias("n"), F.size("suppressed").alias("m")).first()
    assert kept["n"] >= 39_000 and time.time() - began < 60


def test_suggestions_are_ranked(checker):
    """By distance, a letter of the same sound, length gap, key, place in the list; reconstructed stems are among them."""
    w = normalize
    assert checker.ranked("কাশ", [("কাল", 1), ("কাজ", 1), ("কাস", 1), ("কাশি", 1)], 5)[0] == "কাস"
    assert checker.ranked("কাশ", [("কাশা", 1), ("কাত", 1)], 5) == ["কাত", "কাশা"]
    first, later = checker.pack.lexicon[0], checker.pack.lexicon[-1]
    assert checker.frequency[first] > checker.frequency[later]
    got = checker.suggest(w("মানুশকে")[0])
    assert got[0] == w("মানুষকে")[0]
    assert checker.suggest(w("মানুশ")[0])[0] == w("মানুষ")[0]


def test_a_word_that_its_neighbour_marks(checker):
    a, b = normalize("জামা পরে")[0].split()
    assert checker.register_of(b, a) == "modern" and checker.register_of(b, None) is None and checker.register_of(b, "বই") is None
    assert checker.counterpart(b, "modern") == normalize("পরিয়া")[0]


def test_counterparts_come_from_the_longest_ending(checker):
    assert checker.counterpart(normalize("করিতেছেন")[0], "archaic") == "করছেন"
    from dataclasses import replace

    less = Checker(replace(checker.pack, derived={k: v for k, v in checker.pack.derived.items() if k != "িতেছেন"}, archaic_endings=(*checker.pack.archaic_endings, "েন")))
    assert less.counterpart("করিতেছেন", "archaic") is None


def test_animacy_takes_in_a_bare_classifier(checker):
    for text, span, right in (("একটা জন শিক্ষক।", "একটা জন", "একজন"), ("দুটি ছাত্র।", "দুটি", "দুজন"), ("একজন টা বই।", "একজন টা", "একটি")):
        found = [e for e in checker.check(normalize(text)[0]) if e.rule == "animacy"]
        assert [(e.original, e.suggestions) for e in found] == [(normalize(span)[0], (normalize(right)[0],))]
        assert normalize(text)[0][found[0].start : found[0].end] == normalize(span)[0]


def test_candidates_of_long_words(spark):
    """Each side of the bound, against every pair; and a word of 50,000 letters."""
    from scriptorium.functions.distance import osa

    rng = random.Random(9)
    words = {"".join(rng.choice("ab") for _ in range(n)) for n in (1, 2, 3, 5, 7, 8, 9, 10, 11) for _ in range(6)}
    for w in list(words):
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randrange(1, 3)):
                k = rng.randrange(len(x) + 1)
                x[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "c"])
            words.add("".join(x))
    words = sorted(w for w in words if w)
    df = spark.createDataFrame([(w, 1) for w in words], "word string, freq int")
    for most in (1, 2):
        for long in (0, 5, 8, 100):
            got = {(r["word"], r["cand"], r["dist"]) for r in lexicon.candidates(df.select("word"), df, most, long=long).collect()}
            assert got == {(a, b, osa(a, b)) for a in words for b in words if a != b and osa(a, b) <= most}, (most, long)
    huge = "xyz" * 17_000
    got = lexicon.candidates(spark.createDataFrame([(huge,)], "word string"), spark.createDataFrame([(huge[:-1], 1), (huge[1:] + "q", 1), ("xyz", 1)], "word string, freq int"), 2).select("dist").collect()
    assert sorted(r["dist"] for r in got) == [1, 2]


def test_core_names_no_language():
    """Operators, plans, sources and streams hold no letter of the pack's script: those are in the pack and in functions of its letters."""
    from pathlib import Path

    import scriptorium

    root = Path(scriptorium.__file__).parent
    for folder in ("operators", "plans", "sources", "streaming"):
        for p in (root / folder).glob("*.py"):
            assert not [c for c in p.read_text(encoding="utf-8") if 0x980 <= ord(c) <= 0x9FF], p
    for p in (root / "config.py", root / "session.py", root / "packs" / "base.py"):
        assert not [c for c in p.read_text(encoding="utf-8") if 0x980 <= ord(c) <= 0x9FF], p


def test_ids_and_ignored(spark):
    docs = spark.createDataFrame([(1, "কারন কারন")], "doc_id int, text string")
    rows = resolve.with_ids(resolve.edit_rows(resolve.resolved(edits(docs, get_pack("bn")))))
    assert rows.select("edit_id").distinct().count() == rows.count() == 2
    skip = spark.createDataFrame([("NOTVA_SHOTVA", "কারন", "কারণ")], "error_class string, original string, first string")
    assert resolve.ignored(rows, skip).count() == 0
    json = rows.select(resolve.as_json(rows).alias("j")).first()["j"]
    assert '"errorClass":"NOTVA_SHOTVA"' in json and "debug" not in json


def test_templates(spark):
    row = spark.createDataFrame([("{wrong} -> {right} {x}", "a", "")], "t string, w string, r string")
    out = row.select(resolve.rendered(F.col("t"), {"wrong": F.col("w"), "right": F.col("r")}, F.lit("{wrong}?")).alias("o")).first()["o"]
    assert out == "a?"


def test_evaluation(spark):
    cases = evaluate.gold_spans(spark.createDataFrame([("1", "a bad c", "NON_WORD", "bad"), ("2", "x", "HOMONYM", "zz"), ("3", "q", "PUNCTUATION", None)], "id string, text string, error_class string, wrong string"))
    found = spark.createDataFrame([("1", "NON_WORD", 3, 9, 0), ("1", "NON_WORD", 3, 9, 1), ("2", "CLASSIFIER", 0, 1, 0), ("3", "PUNCTUATION", 0, 1, 0)], "id string, error_class string, start int, end int, seq int")
    clean = spark.createDataFrame([("9", "NON_WORD")], "id string, error_class string")
    m = {r["error_class"]: r for r in evaluate.metrics(evaluate.confusion(cases, found, clean, evaluate.classes(spark))).collect()}
    assert len(m) == len(ERROR_CLASSES)
    assert (m["NON_WORD"]["tp"], m["NON_WORD"]["fp"], m["NON_WORD"]["fn"]) == (1, 2, 0)
    assert (m["CLASSIFIER"]["fp"], m["PUNCTUATION"]["tp"], m["HOMONYM"]["fn"]) == (1, 1, 1)
    assert m["WORD_ORDER"]["f05"] == 0.0 and m["PUNCTUATION"]["f05"] == 1.0


def test_gate(spark):
    head = spark.createDataFrame([(0.05, 100, 90, 0.3)], "clean_rate double, gold_total int, human int, stage4_share double")
    classes = spark.createDataFrame([("A", 0.5), ("B", 0.9), ("NEW", 0.1)], "error_class string, f05 double")
    base = spark.createDataFrame([("A", 0.53), ("B", 0.92), ("GONE", 0.9)], "error_class string, f05 double")
    got = {(r["severity"], r["code"]) for r in evaluate.gate(head, classes, base, Gates(), strict=True).collect()}
    assert got == {("blocker", "clean_fp"), ("warning", "gold_total"), ("warning", "stage4_share"), ("blocker", "human_verified"), ("blocker", "f05_A")}
    assert ("warning", "no_baseline") in {(r["severity"], r["code"]) for r in evaluate.gate(head, classes, None).collect()}


def test_nearest_rank(spark):
    for values in ([1, 2, 3, 4], [5], [3, 1, 2], list(range(101))):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        got = evaluate.nearest_rank(df, "v", (0.5, 0.95)).first()
        s = sorted(values)
        assert [got["p50"], got["p95"]] == [s[min(len(s) - 1, round(p * (len(s) - 1)))] for p in (0.5, 0.95)]


def test_limits(spark):
    rng = random.Random(6)
    t0 = datetime(2024, 1, 1)
    rows = [(i, rng.randrange(3), t0 + timedelta(seconds=rng.randrange(600))) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    got = {r["event_id"]: r["accepted"] for r in limits.limited(df, 5, 60).collect()}
    logs = {}
    for i, who, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        log = [t for t in logs.get(who, []) if t >= ts - timedelta(seconds=60)]
        assert got[i] == (len(log) < 5)
        logs[who] = [*log, ts] if len(log) < 5 else log


def test_stream_limits(spark, tmp_path):
    from scriptorium.streaming.limits import limited_stream, upsert_sink, windowed_counts

    t0 = datetime(2024, 1, 1)
    rows = [(i, i % 2, t0 + timedelta(seconds=10 * i), "view") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = limited_stream(stream, 2, 60).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = {r["event_id"]: r["accepted"] for r in limits.limited(df, 2, 60).collect()}
    assert {r["event_id"]: r["accepted"] for r in spark.table("limited").collect()} == want
    q = windowed_counts(stream, "1 minute", "1 minute").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert all(r["n"] == 6 for r in spark.table("counts").collect()) and spark.table("counts").count() >= 5
    q = stream.writeStream.foreachBatch(upsert_sink(str(tmp_path / "dev"))).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["device_id"]: r["last_seen_at"] for r in store.devices_log(spark, str(tmp_path / "dev")).read().collect()}
    assert got == {"0": t0 + timedelta(seconds=380), "1": t0 + timedelta(seconds=390)}


def test_store(spark):
    tables = {n: spark.createDataFrame([], d) for n, d in store.TABLES.items()}
    seen = spark.createDataFrame([("d1", datetime(2024, 1, 1), datetime(2024, 1, 2))], "device_id string, created_at timestamp, last_seen_at timestamp")
    tables = store.ensure_devices(store.ensure_devices(tables, seen), seen)
    assert [t.count() for t in (tables["devices"], tables["entitlements"], tables["streaks"])] == [1, 1, 1]
    tables, n = store.upgraded(tables, "d1", "u1")
    assert n == 3 and store.upgraded(tables, "d1", "u1")[1] == 0
    with pytest.raises(PermissionError):
        store.upgraded(tables, "d1", "u2")
    with pytest.raises(KeyError):
        store.upgraded(tables, "dx", "u1")
    devices = store.attach_recovery(tables["devices"], "d1", "h")
    assert store.device_for_recovery(devices, "h").first()["device_id"] == "d1"
    assert store.tier_for(tables["entitlements"], "d1") == store.FREE_TIER


def test_lexicon_lists(spark):
    lines = spark.createDataFrame([("# list",), ("b",), ("",), (" a ",), ("b",)], "value string").coalesce(1)
    got = {r["word"]: r["freq"] for r in lexicon.frequency_proxy(lexicon.word_list(lines)).collect()}
    assert got == {"b": 1, "a": 2}
    more = lexicon.supplemented(spark.createDataFrame([("a", 2)], "word string, freq long"), spark.createDataFrame([("a",), ("c",)], "word string"))
    assert {r["word"]: r["freq"] for r in more.collect()} == {"a": 2, "c": None}


def test_candidates_are_all_near_words(spark):
    from scriptorium.functions.distance import osa

    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(120)})
    u = spark.createDataFrame([(w,) for w in words[::3]], "word string")
    x = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, freq long")
    for d in (1, 2):
        got = {(r["word"], r["cand"], r["dist"]) for r in lexicon.candidates(u, x, d).collect()}
        assert got == {(a, b, osa(a, b)) for a in words[::3] for b in words if a != b and osa(a, b) <= d}
    best = lexicon.ranked(lexicon.candidates(u, x), 3).collect()
    assert max(r["rank"] for r in best) == 3


def test_stem_reconstruction(spark):
    u = spark.createDataFrame([("মানুশকে",)], "word string")
    x = spark.createDataFrame([("মানুষ", 5), ("বই", 9)], "word string, freq long")
    assert [r["cand"] for r in lexicon.stem_reconstructions(u, x, get_pack("bn")).collect()] == ["মানুষকে"]


def test_usage(spark):
    rows = [("check", "2024-01-01", 1, 10, 2, 1, None), ("check", "2024-01-01", 1, 30, 1, 0, None), ("accept", "2024-01-02", 1, None, None, None, "A"), ("ignore", "2024-01-02", 1, None, None, None, "A"), ("check", "2024-01-02", 1, 5, 0, 0, None)]
    e = spark.createDataFrame(rows, "type string, day string, user_id int, words long, issues long, out_of_scope long, error_class string").withColumn("day", F.to_date("day"))
    s = usage.summary(usage.daily(e)).first()
    assert (s["checks"], s["words"], s["issues"], s["accept_rate"]) == (3, 35, 3, 0.5)
    assert {r["bucket"]: r["checks"] for r in usage.rolling(e).collect()} == {"today": 1, "week": 3, "month": 3}
    assert usage.last_days(e).count() == 14


def test_udtf(spark):
    from scriptorium.plans.check import register_udtf

    register_udtf(spark)
    rows = spark.sql("SELECT * FROM check_text('ab!!', 'bn')").collect()
    assert [(r["start"], r["end"], r["rule"]) for r in rows] == [(2, 4, "repeated_mark")]


def test_cli(capsys, tmp_path):
    from scriptorium.cli import main

    assert main(["languages"]) == 0 and "bn" in capsys.readouterr().out
    assert main(["classes"]) == 0 and capsys.readouterr().out.count("\n") == 12
    (tmp_path / "t").write_text("x")
    assert main(["readability", str(tmp_path / "t")]) == 0
    assert main(["identity", "verify", "no"]) == 1


def test_share_text(spark):
    assert [r[0] for r in spark.createDataFrame([(0.155,), (0.5,)], "s double").select(resolve.share_text(F.col("s"))).collect()] == ["16%", "50%"]


def test_packs_can_be_extended(spark):
    """A pack's own detector, corrector and readability run in the plan; the pack keeps its protocol."""
    from dataclasses import replace as replaced

    from scriptorium.config import EDIT_DDL
    from scriptorium.packs import base

    ddl = "array<struct<" + ",".join(f"{n}:{t}" for n, t in (p.rsplit(" ", 1) for p in EDIT_DDL.split(", "))) + ">>"

    def loud(text):
        e = F.struct(*[v.alias(n) for n, v in dict(start=F.lit(0), end=F.lit(1), original=F.left(text, F.lit(1)), suggestions=F.array(F.lit("?")), error_class=F.lit("WORD_ORDER"), confidence=F.lit(0.99), stage=F.lit(2), rule=F.lit("loud"), seq=F.lit(0)).items()])
        return F.when(text == F.upper(text), F.array(e)).cast(ddl)

    def shout(text, edits):
        return F.transform(edits, lambda e: e.withField("suggestions", F.transform(e["suggestions"], lambda s: F.concat(s, F.lit("!")))))

    base.register("xx", lambda: replaced(get_pack("la"), code="xx", detectors=(loud,), correctors=(shout,), readability=lambda text: F.struct(F.length(text).alias("size"))))
    assert isinstance(get_pack("xx"), base.LanguagePack) and isinstance(loud, base.Detector) and isinstance(get_pack("xx").rules, base.SentenceTokenizer)
    docs = spark.createDataFrame([(1, "ABC !!"), (2, "abc"), (None, "x")], "doc_id int, text string")
    out = check(docs, "xx")
    got = sorted((r["doc_id"], r["rule"], list(r["suggestions"])) for r in out["edits"].filter("surfaced").collect())
    assert got == [(1, "loud", ["?!"]), (1, "space_before", ["!!"])]
    assert sorted(r["size"] for r in out["readability"].collect()) == [1, 3, 6]
    base._FACTORIES.pop("xx")


def test_corpus_spelling(spark):
    """Words of three documents are the lexicon; the others are flagged at their places, with the nearest words; rows of one id are apart."""
    from scriptorium.plans.corpus import check_corpus

    rows = [(1, "house garden river"), (2, "River house, garden"), (3, "the house by the river; garden"), (4, "Huose graden xyzzyq , rivers"), (4, "Huose graden xyzzyq , rivers"), (None, "huosee"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = check_corpus(docs, coverage=1.0).collect()
    one = [(r["start"], r["end"], r["original"], list(r["suggestions"]), r["rule"]) for r in got if r["doc_id"] == 4 and r["surfaced"]]
    assert sorted(one) == sorted(2 * [(0, 5, "Huose", ["house"], "unknown_with_suggestions"), (6, 12, "graden", ["garden"], "unknown_with_suggestions"), (19, 21, " ,", [","], "space_before"), (22, 28, "rivers", ["river"], "unknown_with_suggestions")])
    assert [r["original"] for r in got if r["doc_id"] is None] == ["huosee"]
    assert [r["surfaced"] for r in got if r["original"] == "xyzzyq"] == [False, False]
    assert {r["original"] for r in got if r["doc_id"] == 3} == {"the", "by"}
    budget = check_corpus(spark.createDataFrame([(1, " ".join(f"w{c}w" for c in "abcdefghijklmnopqrstuvwxyz") + " zz")], "doc_id int, text string"), coverage=1.0)
    assert budget.count() == 27 and not budget.filter("surfaced").count()


def test_store_versions(spark, tmp_path):
    """An empty store opens; a version counts as a whole, and one without its mark not at all."""
    path = f"{tmp_path}/store"
    tables_ = store.opened(spark, path)
    assert set(tables_) == set(store.TABLES) and not any(t.count() for t in tables_.values())
    seen = spark.createDataFrame([("d1", datetime(2024, 1, 1), datetime(2024, 1, 2))], "device_id string, created_at timestamp, last_seen_at timestamp")
    assert store.saved(spark, store.ensure_devices(tables_, seen), path) == 1
    back = store.opened(spark, path)
    assert back["devices"].count() == back["streaks"].count() == 1 and back["users"].count() == 0
    later = spark.createDataFrame([("d2", datetime(2024, 1, 1), datetime(2024, 1, 2))], "device_id string, created_at timestamp, last_seen_at timestamp")
    assert store.saved(spark, store.ensure_devices(back, later), path) == 2
    store.ensure_devices(back, later)["devices"].limit(0).write.parquet(f"{path}/v3/devices")
    assert store.opened(spark, path)["devices"].count() == 2
