"""Quality rules with adaptive thresholds, as DataFrame operations only.

Every document gets counts. Some ratios of these counts go, as integers, into a
histogram sketch per language and source: a bucket keeps the seven leading bits
of a value, so that a quantile is off by less than 1/64 of itself, the number of
buckets is bounded, and sketches merge by adding counts. The fences that reject
outliers come from the quartiles of a group's own sketch, drawn by weight towards
those of its language, and those of a language towards all documents': n documents
count n times, the wider group `prior` times. So a group of any size has fences of
its own, and none hangs on a bound that it reaches or not. Quartiles, rather than
tail quantiles, since up to a quarter of a group may be junk and yet not move them.
The fences, a few numbers a group, are joined to the documents.

Defined results: a null or empty text has no words and fails the base rule; a
null lang or source is a group of its own; repeated rows each get their row and
each count in the sketch; an empty table gives no rows; other columns are
ignored, or kept as they are by `keep`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import cut, written

BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A ratio, and how far outside the quartiles it may lie.

    The upper fence is q75 + spread * gap, gap being q75 - q50, but a sketch's
    resolution (q50 / 64, and 1) at least. No group has it below `floor`, as ratios
    that are nearly always 0 have no spread of their own. The lower one, if any, is
    q25 - spread * gap, gap being q50 - q25."""

    name: str
    over: str
    under: str
    scale: int
    spread: int = 16
    floor: int = 0
    low: bool = False


RULES = (
    Rule("symbols", "n_symbols", "n_words", 1000, floor=100),
    Rule("word_length", "word_chars", "n_words", 100, low=True),
    Rule("dup_lines", "n_dup_lines", "n_lines", 1000, floor=500),
    Rule("stutter", "n_stutter", "n_words", 1000, floor=100),
)


def counts(text: Column) -> dict[str, Column]:
    """Column expressions that need no intermediate column."""
    words = F.expr("__sc_words")
    lines = F.expr("__sc_lines")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_stutter": F.size(F.filter(words, lambda x, i: x == F.get(words, i - 1))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def measured(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """docs with one more column, __sc_q: a struct of the counts.

    Words in windows found twice are counted from 64-bit window hashes: only
    where a text has equal hashes are these sorted with their places, so that
    the work stays at n log n for texts of any length."""
    kept = docs.columns
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    trimmed = F.btrim(t, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    out = docs.withColumns({"__sc_words": words, "__sc_lines": lines})
    windows = F.expr(
        f"transform(slice(__sc_words, 1, greatest(size(__sc_words) - {window - 1}, 0)), (x, i) -> xxhash64(x, "
        + ", ".join(f"get(__sc_words, i + {k})" for k in range(1, window))
        + "))"
    )
    out = out.withColumns({f"__sc_{k}": v for k, v in counts(t).items()} | {"__sc_hashes": windows})
    out = out.withColumn(
        "__sc_placed",
        F.expr(
            "CASE WHEN size(array_distinct(__sc_hashes)) < size(__sc_hashes) "
            "THEN array_sort(transform(__sc_hashes, (h, i) -> struct(h AS h, i AS i))) END"
        ),
    )
    out = out.withColumn(
        "__sc_starts",
        F.expr(
            "CASE WHEN __sc_placed IS NOT NULL THEN array_sort(transform(filter(__sc_placed, (p, k) -> "
            "coalesce(get(__sc_placed, k - 1).h = p.h, false) OR coalesce(get(__sc_placed, k + 1).h = p.h, false)), p -> p.i)) END"
        ),
    )
    repeats = F.expr(
        f"CASE WHEN __sc_starts IS NULL THEN 0L ELSE aggregate(transform(__sc_starts, (p, k) -> "
        f"CAST(least({window}, coalesce(get(__sc_starts, k + 1) - p, {window})) AS BIGINT)), 0L, (a, x) -> a + x) END"
    )
    out = out.withColumn("__sc_n_repeat_words", repeats)
    q = F.struct(*[F.col(f"__sc_{k}").alias(k) for k in COUNTS])
    # One row for one row: a filter on the counts isn't pushed below this, where
    # it would hold a copy of all expressions for every count it names.
    return out.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(q)).alias("__sc_q"))


def base_failed(q: str = "__sc_q") -> Column:
    return (F.col(f"{q}.n_words") < 10) | (F.col(f"{q}.n_repeat_words") * 100 > F.col(f"{q}.n_words") * 20)


def ratio(rule: Rule, q: str = "__sc_q") -> Column:
    under = F.greatest(F.col(f"{q}.{rule.under}"), F.lit(1))
    return F.floor(F.col(f"{q}.{rule.over}") * rule.scale / under).cast("long")


def bucket(value: Column, bits: int = 7) -> Column:
    """value with its leading bits only."""
    unit = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - bits, F.lit(0))).cast("long")
    return (F.floor(value / unit) * unit).cast("long")


def sketch(rows: DataFrame, q: str = "__sc_q") -> DataFrame:
    """(lang, source, rule, bucket, n) over rows that pass the base rule."""
    values = F.array(*[F.struct(F.lit(r.name).alias("rule"), bucket(ratio(r, q)).alias("bucket")) for r in RULES])
    one = rows.filter(~base_failed(q)).select("lang", "source", F.explode(values).alias("v"))
    return one.groupBy("lang", "source", "v.rule", "v.bucket").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


QUARTILES = ("q25", "q50", "q75")


def quartiles(parts: DataFrame, *by: str) -> DataFrame:
    """(by, rule, docs, q25, q50, q75) of sketches with columns by, rule, bucket and n."""
    keys = ", ".join(["rule", *by])
    run = parts.selectExpr(
        "*",
        f"sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS __sc_run",
        f"sum(n) OVER (PARTITION BY {keys}) AS __sc_all",
    )
    at = lambda p: F.min(F.when(F.col("__sc_run") * 100 >= F.col("__sc_all") * p, F.col("bucket")))
    return run.groupBy(*by, "rule").agg(F.first("__sc_all").alias("docs"), *[at(int(q[1:])).alias(q) for q in QUARTILES])


def fences(parts: DataFrame, prior: int = 10) -> DataFrame:
    """(lang, source, <rule>_hi, <rule>_lo): one row per language and source."""
    fine = quartiles(parts, "lang", "source").alias("f")
    mid = quartiles(merged(parts, "lang"), "lang").alias("m")
    top = quartiles(merged(parts)).alias("t")
    j = fine.join(mid, (F.col("m.lang").eqNullSafe(F.col("f.lang"))) & (F.col("m.rule") == F.col("f.rule")))
    j = j.join(top, F.col("t.rule") == F.col("f.rule"))

    def drawn(own: Column, docs: str, wider: Column) -> Column:
        return F.floor((own * F.col(docs) + wider * prior) / (F.col(docs) + prior)).cast("long")

    q = {c: drawn(F.col(f"f.{c}"), "f.docs", drawn(F.col(f"m.{c}"), "m.docs", F.col(f"t.{c}"))).alias(c) for c in QUARTILES}
    j = j.select(F.col("f.lang").alias("lang"), F.col("f.source").alias("source"), F.col("f.rule").alias("rule"), *q.values())
    least = F.greatest(F.floor(F.col("q50") / 64).cast("long"), F.lit(1))
    out = []
    for r in RULES:
        hi = F.greatest(F.col("q75") + F.greatest(F.col("q75") - F.col("q50"), least) * r.spread, F.lit(r.floor))
        lo = F.col("q25") - F.greatest(F.col("q50") - F.col("q25"), least) * r.spread if r.low else F.lit(-1)
        out += [F.max(F.when(F.col("rule") == r.name, e)).cast("long").alias(f"{r.name}_{s}") for s, e in (("hi", hi), ("lo", lo))]
    return j.groupBy("lang", "source").agg(*out)


def judged(rows: DataFrame, limits: DataFrame, q: str = "__sc_q", small: int = 50_000) -> DataFrame:
    """rows (with lang, source and q) joined with their fences; adds __sc_failed and __sc_kept.

    Up to `small` groups, counted here, are broadcast, so that rows stay where
    they are; more are joined as Spark sees fit. limits should be cut."""
    names = [c for c in limits.columns if c not in ("lang", "source")]
    limits = limits.select(F.col("lang").alias("__sc_lang"), F.col("source").alias("__sc_source"), *[F.col(c).alias(f"__sc_{c}") for c in names])
    if limits.limit(small + 1).count() <= small:
        limits = F.broadcast(limits)
    j = rows.join(limits, F.col("__sc_lang").eqNullSafe(rows["lang"]) & F.col("__sc_source").eqNullSafe(rows["source"]), "left")
    ok = F.lit(True)
    for r in RULES:
        v = ratio(r, q)
        ok = ok & F.coalesce((v <= F.col(f"__sc_{r.name}_hi")) & (v >= F.col(f"__sc_{r.name}_lo")), F.lit(True))
    return j.withColumns({"__sc_failed": base_failed(q), "__sc_kept": ~base_failed(q) & ok})


def profile(docs: DataFrame, id_col: str = "doc_id", text: str = "text", prior: int = 10) -> DataFrame:
    """(id, counts, base_failed, kept), one row per document; each text is read once."""
    rows = cut(measured(docs.select(id_col, "lang", "source", text), text).drop(text))
    out = judged(rows, cut(fences(sketch(rows), prior)))
    return out.select(
        id_col, *[F.col(f"__sc_q.{c}").alias(c) for c in BASE_COUNTS],
        F.col("__sc_failed").alias("base_failed"), F.col("__sc_kept").alias("kept"),
    )


def keep(docs: DataFrame, text: str = "text", prior: int = 10) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    Each text is measured once: the counts are written beside it to the shared
    folder, read alone for the sketch, and with it for the verdict; no text is shuffled."""
    rows = written(measured(docs, text))
    out = judged(rows, cut(fences(sketch(rows), prior)))
    return out.filter("__sc_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
