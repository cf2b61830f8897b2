"""Greedy choice among overlapping edits, per document."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import ERROR_CLASSES, PipelineConfig


def overlaps(a: Column, b: Column) -> Column:
    """Half-open spans; an empty span inside another overlaps it."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


class Taken:
    """Spans that don't overlap. In order of place their ends are in order too, so only the last one
    that begins before a span's end can overlap it."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def fits(self, start: int, end: int) -> bool:
        """Whether the span overlaps none that was taken; if so, it is taken."""
        k = bisect_left(self.spans, (end, -1))
        if k and self.spans[k - 1][1] > start:
            return False
        insort(self.spans, (start, end))
        return True


def _greedy(starts: pd.Series, ends: pd.Series, good: pd.Series) -> pd.Series:
    """Which spans of each row are taken, in order: those that are good and overlap none taken before."""

    def one(a, b, ok) -> list[bool]:
        taken = Taken()
        return [bool(fine) and taken.fits(int(s), int(e)) for s, e, fine in zip(a, b, ok, strict=True)]

    return pd.Series([None if a is None else one(a, b, ok) for a, b, ok in zip(starts, ends, good, strict=True)], dtype=object)


def chosen(found: list, config: PipelineConfig = PipelineConfig()) -> tuple[list[tuple], list[tuple]]:
    """(kept, suppressed) of one text's edits, each with its place in order of emission: as resolved() does it for rows."""
    some = [(n, e) for n, e in enumerate(found) if config.enabled_classes is None or e.error_class in config.enabled_classes]
    some.sort(key=lambda x: (-x[1].confidence, x[1].end - x[1].start, x[1].start, x[0]))  # all are of stage 1
    taken = Taken()
    kept, suppressed = [], []
    for x in some:
        (kept if x[1].confidence >= config.min_confidence and taken.fits(x[1].start, x[1].end) else suppressed).append(x)
    kept.sort(key=lambda x: (x[1].start, x[0]))
    return kept[: config.max_edits], suppressed + kept[config.max_edits :]


def resolved(docs: DataFrame, config: PipelineConfig = PipelineConfig(), id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, kept, suppressed) of rows (id, keep, edits).

    Edits of classes that aren't enabled go. The rest is taken by confidence,
    stage, span length, place and order of emission; one that overlaps no kept
    edit and is confident enough is kept. At most max_edits are kept, by place.
    Only places leave the JVM; the time is that of sorting a document's edits."""
    edits = F.coalesce(F.col("edits"), F.slice("edits", 1, 0))
    if config.enabled_classes is not None:
        edits = F.filter(edits, lambda e: e["error_class"].isin(*config.enabled_classes))
    keyed = F.transform(
        edits, lambda e: F.struct((-e["confidence"]).alias("k1"), (-e["stage"]).alias("k2"), (e["end"] - e["start"]).alias("k3"), e["start"].alias("k4"), e["seq"].alias("k5"), e.alias("e"))
    )
    done = docs.withColumn("__o", F.transform(F.array_sort(keyed), lambda k: k["e"]))
    good = F.transform("__o", lambda e: e["confidence"] >= config.min_confidence)
    done = done.withColumn("__t", F.pandas_udf(_greedy, "array<boolean>")(F.col("__o.start"), F.col("__o.end"), good))
    part = lambda which: F.filter("__o", lambda e, i: F.get("__t", i) == F.lit(which))
    done = done.withColumns({"__k": by_place(part(True)), "__s": part(False)})
    short = F.transform(
        F.slice("__k", 1, config.max_edits), lambda e: e.withField("suggestions", F.slice(e["suggestions"], 1, config.max_suggestions))
    )
    over = F.slice(F.col("__k"), F.lit(config.max_edits + 1), F.greatest(F.size("__k"), F.lit(0)))
    return done.select(id_col, *keep, short.alias("kept"), F.concat(F.col("__s"), over).alias("suppressed"))


def by_place(edits: Column) -> Column:
    keyed = F.transform(edits, lambda e: F.struct(e["start"].alias("a"), e["seq"].alias("b"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


def edit_rows(res: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each edit, with surfaced."""
    kept = F.transform("kept", lambda e: F.struct(e.alias("e"), F.lit(True).alias("surfaced")))
    other = F.transform("suppressed", lambda e: F.struct(e.alias("e"), F.lit(False).alias("surfaced")))
    return res.select(id_col, F.explode(F.concat(kept, other)).alias("x")).select(id_col, "x.e.*", "x.surfaced")


def with_ids(edits: DataFrame) -> DataFrame:
    """edits with an id from their content; equal content has an equal id, no content a random one."""
    parts = F.concat_ws("\x00", "error_class", F.col("start").cast("string"), F.col("end").cast("string"), "original", F.array_join("suggestions", "\x00"))
    content = (F.col("original") != "") | (F.size("suggestions") > 0)
    return edits.withColumn("edit_id", F.when(content, F.left(F.sha2(parts, 256), F.lit(16))).otherwise(F.expr("uuid()")))


def ignored(edits: DataFrame, ignore: DataFrame) -> DataFrame:
    """edits without those whose class, original and first suggestion the user ignored."""
    keyed = edits.withColumn("first", F.coalesce(F.get("suggestions", F.lit(0)), F.lit("")))
    i = ignore.select(F.col("error_class").alias("ic"), F.col("original").alias("io"), F.coalesce("first", F.lit("")).alias("if"))
    return keyed.join(i, (keyed["error_class"] == i["ic"]) & (keyed["original"] == i["io"]) & (keyed["first"] == i["if"]), "left_anti").drop("first")


def accepted(text: Column, edits: Column) -> Column:
    """text with the first suggestion of every edit; edits are in order and don't overlap.

    Each part of the text is taken once: what lies between an edit and the one before it, then its suggestion."""
    some = F.filter(edits, lambda e: F.size(e["suggestions"]) > 0)
    end = lambda i: F.when(i > 0, F.get(some, i - 1)["end"]).otherwise(0)
    parts = F.transform(some, lambda e, i: F.concat(F.substring(text, end(i) + 1, e["start"] - end(i)), F.get(e["suggestions"], F.lit(0))))
    rest = F.substring(text, end(F.size(some)) + 1, F.length(text))
    return F.concat(F.array_join(parts, ""), rest)


def stage_distribution(edits: DataFrame) -> DataFrame:
    return edits.filter("surfaced").groupBy("stage").agg(F.count("*").alias("n"))


def class_counts(edits: DataFrame) -> DataFrame:
    return edits.filter("surfaced").groupBy("error_class").agg(F.count("*").alias("n"))


def as_json(edits: DataFrame) -> Column:
    """Wire form: camel case, confidence to four places, no debug."""
    return F.to_json(F.struct(
        F.col("start"), F.col("end"), F.col("original"), F.col("suggestions"), F.col("error_class").alias("errorClass"), F.bround("confidence", 4).alias("confidence"), F.col("stage")))


def rendered(template: Column, values: dict[str, Column], no_fix: Column | None = None) -> Column:
    """template with {key} replaced; keys without a value stay. no_fix is used where `right` is empty."""
    t = template if no_fix is None else F.when(F.coalesce(values["right"], F.lit("")) == "", F.coalesce(no_fix, template)).otherwise(template)
    for k, v in values.items():
        t = F.replace(t, F.lit(f"{{{k}}}"), v)
    return t


def explained(edits: DataFrame, specs: DataFrame) -> DataFrame:
    """edits with explanation_en, explanation_bn, category and rule_reference; specs has a row for each class."""
    right = F.coalesce(F.get("suggestions", F.lit(0)), F.lit(""))
    values = {"wrong": F.col("original"), "right": right}
    j = edits.join(F.broadcast(specs), "error_class", "left")  # twelve rows
    category = F.create_map(*[F.lit(x) for c, (k, _) in ERROR_CLASSES.items() for x in (c, k)])
    return j.select(
        *[F.col(c) for c in edits.columns], rendered(F.col("template"), values, F.col("no_fix_template")).alias("explanation_en"),
        rendered(F.col("template_bn"), values, F.col("no_fix_template_bn")).alias("explanation_bn"), category[F.col("error_class")].alias("category"), "rule_reference",
    )


def share_text(share: Column) -> Column:
    """A ratio as whole percent."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))
