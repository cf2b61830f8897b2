"""Scans and sinks: word lists, gold cases, class specs, baselines, text."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.config import ERROR_CLASSES, FULL_LEXICON
from scriptorium.functions.normalize import folded_word as folded
from scriptorium.functions.normalize import NUKTA, normalized
from scriptorium.operators.lexicon import word_list
from scriptorium.packs.base import Pack
from scriptorium.sources.files import exists

#: A count line of an affix table that ends with `$`.
HEADER_REPAIR = re.compile(r"^((?:SFX|PFX)[ \t]+\S+[ \t]+[YN][ \t]+[0-9]+)[ \t]*\$[ \t]*\Z")
GOLD = "id string, text string, error_class string, wrong string, right string, review string, source string, note string"
SPEC = "error_class string, label string, template string, no_fix_template string, rule_reference string, gold_cases int"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a file a row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold cases from JSON lines: of the folder `errors` in path, a file for each class, or, without it, of
    `errors.json` there or of path itself; an id that repeats in any of them raises."""
    found = [x for x in (f"{path}/errors", f"{path}/errors.json") if exists(spark, x)]
    rows = spark.read.schema(GOLD).json(found[0] if found else path)
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"gold case {twice[0][0]!r} is there twice")
    return rows


def clean(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, text): sentences without mistakes, a line each, of `clean.txt` in path."""
    lines_ = spark.read.text(f"{path}/clean.txt").filter(F.trim("value") != "")
    return lines_.select(F.xxhash64("value").alias("sent_id"), F.col("value").alias("text"))


def rule_table(spark: SparkSession, path: str, wrong: str = "wrong", right: str = "right") -> dict[str, str]:
    """A rule table from JSON lines or CSV with a header, folded as text is; a key that comes twice with other values
    raises. Rule tables are of a language's size and live on the driver."""
    rows = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.option("header", True).csv(path)
    out: dict[str, str] = {}
    for r in rows.select(wrong, right).toLocalIterator():
        k, v = folded(r[0] or ""), folded(r[1] or "")
        if out.setdefault(k, v) != v:
            raise ValueError(f"{path}: {k!r} has two values, {out[k]!r} and {v!r}")
    return out


def pack_from(spark: SparkSession, base: Pack, folder: str) -> Pack:
    """base with the tables that folder holds: <field>.jsonl or .csv for its maps, <field>.txt for its word lists.

    Without a word list, base keeps its own and says so: unknown words then are hardly ever confident enough to surface."""
    from dataclasses import fields, replace

    new: dict[str, object] = {}
    for f in fields(base):
        for end in {"dict[str, str]": (".jsonl", ".csv"), "tuple[str, ...]": (".txt",)}.get(str(f.type), ()):
            path = f"{folder}/{f.name}{end}"
            if not exists(spark, path):
                continue
            if end == ".txt":
                new[f.name] = tuple(folded(r["word"]) for r in word_list(lines(spark, path)).orderBy("pos").toLocalIterator())
            else:
                new[f.name] = rule_table(spark, path)
    words = lexicon_from(spark, base, folder)
    new["lexicon"], new["coverage"] = words, min(1.0, len(words) / FULL_LEXICON)
    return replace(base, **new)  # type: ignore[arg-type]


def lexicon_from(spark: SparkSession, base: Pack, folder: str, most: int = FULL_LEXICON * 4) -> tuple[str, ...]:
    """The best word list of folder, in order: the forms of an affix dictionary (`dictionary.aff`, `dictionary.dic`) after the
    list of words (`lexicon.txt`) and its supplement (`extra_words.txt`); the list alone; the words that base has.

    What is there and can't be read, or isn't there, is said, as without a dictionary unknown words are hardly ever confident
    enough to surface. A pack's words live on the driver: a dictionary of more than `most` forms stays a table, for
    operators.affixes and plans.corpus."""
    from scriptorium.sources.dictionary import dictionary

    listed = lambda name: [folded(r["word"]) for r in word_list(lines(spark, f"{folder}/{name}")).orderBy("pos").toLocalIterator()] if exists(spark, f"{folder}/{name}") else []
    own = [*listed("lexicon.txt")]
    words = [*(own or base.lexicon), *listed("extra_words.txt")]
    aff, dic = f"{folder}/dictionary.aff", f"{folder}/dictionary.dic"
    if exists(spark, dic):
        try:
            found = dictionary(spark, aff, dic)
            if found.limit(most + 1).count() > most:
                warnings.warn(f"{dic} has more than {most} forms and stays a table: read it with sources.dictionary", stacklevel=3)
            else:
                words += sorted(r["word"] for r in found.toLocalIterator())
                return tuple(dict.fromkeys(words))
        except Exception as e:  # a dictionary that can't be read leaves a weaker checker, never none
            warnings.warn(f"{dic} can't be read ({e}): {len(words)} words are used instead", stacklevel=3)
    elif not own:
        warnings.warn(f"no word list in {folder}: the pack's own {len(base.lexicon)} words are used, and unknown words won't surface", stacklevel=3)
    return tuple(dict.fromkeys(words))


def class_specs(specs: DataFrame) -> DataFrame:
    """specs, if every class is there with its four keys and at least three cases; else ValueError.

    There are twelve classes, so the checks run on the driver."""
    found = {r["error_class"]: r for r in specs.collect()}
    missing = sorted(set(ERROR_CLASSES) - set(found))
    bad = sorted(k for k, r in found.items() if not all(r[c] for c in ("label", "template", "no_fix_template", "rule_reference")) or (r["gold_cases"] or 0) < 3)
    if missing or bad:
        raise ValueError(f"classes without spec: {missing}; incomplete: {bad}")
    return specs


def read_baseline(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """What write_baseline wrote, a class a line; or, with whole_file, one JSON value a file."""
    return spark.read.option("multiLine", whole_file).json(path)


def write_baseline(per_class: DataFrame, path: str) -> None:
    """Twelve rows, in one file."""
    per_class.coalesce(1).write.mode("overwrite").json(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def clear_events(spark: SparkSession, schema: str, path: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def affix_header_repaired(line: Column) -> Column:
    """Count lines of an affix table without the `$` that some files end them with."""
    return F.regexp_replace(line, HEADER_REPAIR.pattern.replace("\\Z", "\\z"), "$1")


def canonical_lines(rows: DataFrame, value: str = "value") -> DataFrame:
    """Lines of data files, normalised as text is."""
    return rows.withColumn(value, normalized(F.col(value))["text"])


def nukta_lint(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose text spells one of the three dotted letters as two characters, with n_undotted: data files must not."""
    found = F.regexp_count(F.col(value), F.lit("|".join(NUKTA)))
    return rows.withColumn("n_undotted", found.cast("long")).filter("n_undotted > 0")


def markdown(per_class: DataFrame) -> str:
    """The report of an evaluation: twelve classes, a row each."""
    out = ["| class | n | tp | fp | fn | P | R | F0.5 |", "|-|-|-|-|-|-|-|-|"]
    for r in per_class.orderBy("error_class").collect():
        out.append(f"| {r['error_class']} | {r['support']} | {r['tp']} | {r['fp']} | {r['fn']} | {r['precision']:.4f} | {r['recall']:.4f} | {r['f05']:.4f} |")
    return "\n".join(out)
