"""The checker's whole plan: normalise, cut, detect, resolve, map back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields, replace
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from scriptorium.config import EDIT_DDL, PipelineConfig
from scriptorium.functions.normalize import normalize, normalized
from scriptorium.functions.offsets import remapped
from scriptorium.functions.readability import scored
from scriptorium.functions.scope import out_of_scope
from scriptorium.functions.tokenize import sentence_rows
from scriptorium.operators.detect import Checker, checked, normalized_edits, resolved_text
from scriptorium.operators.resolve import accepted, edit_rows, resolved
from scriptorium.packs.base import get_pack, languages

#: Stages that are declared and have no detector.
SKIPPED = {2: "not part of this engine", 3: "not part of this engine", 4: "not part of this engine"}


def _found(docs: DataFrame, code: str, config: PipelineConfig, id_col: str, submitted: bool) -> DataFrame:
    """(id, text, kept, suppressed): what was found in each row's normalised text, resolved; nothing leaves its row.

    One pass over the text, unless the pack has detectors or correctors of its own: these are columns, which stand
    between the checker's own and the resolver, or after it."""
    pack = get_pack(code)
    if not pack.detectors and not pack.correctors:
        return checked(docs, pack, config, id_col, submitted)
    text, found = F.col("__sc_found.text"), F.col("__sc_found.edits")
    if pack.detectors:
        all_ = F.concat(found, *[F.coalesce(d(text), F.slice(found, 1, 0)) for d in pack.detectors])
        found = F.transform(all_, lambda e, i: e.withField("seq", i.cast("int")))
    n = normalized_edits(docs.select(id_col, "text"), replace(pack, detectors=(), correctors=(), readability=None)).withColumn("edits", found)
    out = resolved(n, config, id_col, keep=("__sc_found",))
    for c in pack.correctors:
        out = out.withColumn("kept", c(text, F.col("kept")))
    if submitted:
        places, size = F.col("__sc_found.offset_map"), F.length(text)
        origin = lambda place: F.coalesce(remapped(place, places, size), place)
        back = lambda c: F.transform(c, lambda e: e.withField("start", origin(e["start"])).withField("end", origin(e["end"])))
        out = out.withColumns({"kept": back("kept"), "suppressed": back("suppressed")})
    return out.select(id_col, text.alias("text"), "kept", "suppressed")


def check(docs: DataFrame, code: str = "bn", config: PipelineConfig = PipelineConfig(), id_col: str = "doc_id") -> dict[str, DataFrame]:
    """DataFrames by name: normalized, sentences, edits (in places of the submitted text), out_of_scope,
    readability, stage_report and too_long.

    Each is one pass over docs without a shuffle, but for the counts of stage_report; rows with equal or null ids
    keep their own edits. Texts beyond config.max_text, where that is set, are only in too_long."""
    pack = get_pack(code)
    fits = F.lit(True) if config.max_text is None else F.length(F.coalesce("text", F.lit(""))) <= config.max_text
    given = docs.filter(fits)
    n = given.select(id_col, normalized(F.col("text")).alias("n"))
    plain = n.select(id_col, F.col("n.text").alias("text"))
    found = edit_rows(_found(given, code, config, id_col, True), id_col)
    report = found.filter("surfaced").groupBy("stage").agg(F.count("*").alias("edits_emitted"))
    return {
        "normalized": n.select(id_col, "n.*"),
        "sentences": sentence_rows(plain, pack.rules, id_col),
        "edits": found,
        "out_of_scope": out_of_scope(given, pack.rules, id_col),
        "readability": plain.select(id_col, (pack.readability(F.col("text")) if pack.readability else scored(F.col("text"), pack.rules)).alias("r")).select(id_col, "r.*"),
        "stage_report": report,
        "too_long": docs.filter(~fits).select(id_col),
    }


def accept_all(docs: DataFrame, code: str = "bn", config: PipelineConfig = PipelineConfig(), id_col: str = "doc_id") -> DataFrame:
    """(id, text), a row for each of docs: normalised texts with the first suggestion of every kept edit."""
    return _found(docs, code, config, id_col, False).select(id_col, accepted(F.col("text"), F.col("kept")).alias("text"))


class CheckTable:
    """SQL: SELECT * FROM check_table(TABLE(documents), 'la', min_confidence => 0.5).

    Takes any table with a column `text`, however it is partitioned. A row for each edit: the other columns of its row,
    whatever they are, then those of check()'s edits. Columns of the table that are named like these are left out.
    Options are the fields of PipelineConfig that are numbers. The pack's tables are made once a task."""

    _KINDS = {"int": T.IntegerType(), "string": T.StringType(), "array<string>": T.ArrayType(T.StringType()), "double": T.DoubleType()}
    #: Made without the JVM, which tasks don't have.
    EDIT = T.StructType([*(T.StructField(c, k[t]) for k in [_KINDS] for c, t in (x.split(" ") for x in EDIT_DDL.split(", "))), T.StructField("surfaced", T.BooleanType())])

    @staticmethod
    def analyze(table: AnalyzeArgument, code: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or "text" not in table.dataType.names:
            raise ValueError("check_table asks for a table with a column `text`")
        if code.value not in languages():
            raise ValueError(f"no language pack {code.value!r}; there are {', '.join(languages())}")
        if unknown := set(options) - {f.name for f in fields(PipelineConfig)}:
            raise ValueError(f"check_table has no option {', '.join(sorted(unknown))}")
        kept = [f for f in table.dataType.fields if f.name != "text" and f.name not in CheckTable.EDIT.names]
        return AnalyzeResult(schema=T.StructType([*kept, *CheckTable.EDIT.fields]))

    def __init__(self, analyze_result: AnalyzeResult):
        self.columns = [f.name for f in analyze_result.schema.fields[: -len(self.EDIT.fields)]]
        self.checker: Checker | None = None

    def eval(self, row: Row, code: str, **options: Any) -> Iterator[tuple]:
        if self.checker is None:
            self.checker = Checker(get_pack(code))
            self.config = replace(PipelineConfig(), **{k: v if isinstance(v, int) else float(v) for k, v in options.items()})
        own = [row[c] for c in self.columns]
        if self.config.max_text is not None and len(row["text"] or "") > self.config.max_text:
            return
        _, kept, other = resolved_text(self.checker, row["text"], self.config)
        for found, surfaced, most in ((kept, True, self.config.max_suggestions), (other, False, 1 << 30)):
            for n, e in found:
                yield *own, e.start, e.end, e.original, list(e.suggestions[:most]), e.error_class, e.confidence, 1, e.rule, n, surfaced


def register_table_function(spark, name: str = "check_table") -> None:
    """Makes SQL `check_table(TABLE(<any table>), '<pack>')`: the edits of check(), for every row of the table."""
    spark.udtf.register(name, udtf(CheckTable))


class CheckText:
    """SQL: SELECT * FROM check_text('a text', 'bn'): the edits of one text, before overlaps are resolved."""

    def __init__(self):
        self.checkers: dict[str, Checker] = {}

    def eval(self, text: str, code: str) -> Iterator[tuple]:
        if code not in self.checkers:
            self.checkers[code] = Checker(get_pack(code))
        for e in self.checkers[code].check(normalize(text)[0]):
            yield e.start, e.end, e.original, e.suggestions[0] if e.suggestions else None, e.error_class, e.confidence, e.rule


def register_udtf(spark, name: str = "check_text") -> None:
    """Makes SQL `SELECT * FROM check_text(text, 'bn')`."""
    spark.udtf.register(name, udtf(CheckText, returnType="start int, end int, original string, suggestion string, error_class string, confidence double, rule string"))
