"""Precision, recall and F0.5 of detectors against labelled cases, and the gate over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import ERROR_CLASSES, Gates
from scriptorium.operators.spans import hits


def classes(spark) -> DataFrame:
    """(error_class, category, implemented): the twelve classes."""
    return spark.createDataFrame([(k, c, s is not None) for k, (c, s) in ERROR_CLASSES.items()], "error_class string, category string, implemented boolean")


def gold_spans(cases: DataFrame) -> DataFrame:
    """cases with start and end of the first occurrence of wrong; null where there is none."""
    at = F.position(F.col("wrong"), F.col("text")) - 1
    return cases.withColumn("start", F.when(at >= 0, at)).withColumn("end", F.col("start") + F.length("wrong"))


def matched(cases: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, error_class, hit_seq): the first edit of the case's class that overlaps its span.

    A case without a span is hit by any edit of its class."""
    return hits(cases, edits).groupBy("id", "error_class").agg(F.min("hit_seq").alias("hit_seq"))


def confusion(cases: DataFrame, edits: DataFrame, clean_edits: DataFrame, all_classes: DataFrame) -> DataFrame:
    """(error_class, support, tp, fp, fn): each case is a hit or a miss of its class; every other edit is a false
    alarm of the class that gave it, and so is every edit on clean text."""
    m = matched(cases, edits)
    hits = m.groupBy("error_class").agg(F.count("*").alias("support"), F.count("hit_seq").alias("tp"), F.sum(F.col("hit_seq").isNull().cast("long")).alias("fn"))
    used = m.filter("hit_seq IS NOT NULL").select("id", F.col("hit_seq").alias("seq"))
    false = edits.join(used, ["id", "seq"], "left_anti").select("error_class").unionAll(clean_edits.select("error_class"))
    fp = false.groupBy("error_class").agg(F.count("*").alias("fp"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return all_classes.join(hits, "error_class", "left").join(fp, "error_class", "left").select("error_class", "implemented", zero("support"), zero("tp"), zero("fp"), zero("fn"))


def precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)


def f05(p: Column, r: Column) -> Column:
    return F.when(0.25 * p + r > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(0.0)


def metrics(counts: DataFrame) -> DataFrame:
    """counts with precision, recall and f05."""
    c = counts.withColumn("precision", precision(F.col("tp"), F.col("fp"))).withColumn("recall", precision(F.col("tp"), F.col("fn")))
    return c.withColumn("f05", f05(F.col("precision"), F.col("recall")))


def macro_f05(per_class: DataFrame) -> DataFrame:
    return per_class.filter("implemented").agg(F.avg("f05").alias("macro_f05"))


def clean_rate(sentences: DataFrame, edits: DataFrame) -> DataFrame:
    """(sentences, flagged, rate): clean sentences with an edit."""
    flagged = edits.select("id").distinct().withColumn("hit", F.lit(1))
    return sentences.join(flagged, "id", "left").agg(
        F.count("*").alias("sentences"), F.count("hit").alias("flagged"), F.coalesce(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("rate")
    )


def nearest_rank(values: DataFrame, value: str, shares: tuple[float, ...], *by: str) -> DataFrame:
    """The value at place round(p * (n - 1)), half to even, of each group, for each share.

    Places come from counts of equal values, so no group is gathered in a list."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by)
    run = counts.withColumn("__to", F.sum("__c").over(w.orderBy("__v"))).withColumn("__n", F.sum("__c").over(w))
    at = lambda p: F.min(F.when(F.col("__to") > F.bround(F.lit(p) * (F.col("__n") - 1), 0), F.col("__v")))
    g = run.groupBy(*by) if by else run.groupBy()
    return g.agg(*[at(p).alias(f"p{round(p * 100)}") for p in shares])


def stage_share(edits: DataFrame, stage: int = 4) -> DataFrame:
    n = F.count("*")
    return edits.filter("surfaced").agg(F.when(n > 0, F.sum((F.col("stage") == stage).cast("int")) / n).otherwise(0.0).alias("share"))


def gate(headline: DataFrame, per_class: DataFrame, baseline: DataFrame | None, gates: Gates = Gates(), strict: bool = False) -> DataFrame:
    """(severity, code, message) of one headline row (clean_rate, gold_total, human, stage4_share) and the classes' f05."""
    rules = [
        ("blocker", "clean_fp", F.col("clean_rate") > gates.max_clean_fp, F.format_string("clean false-positive rate %.4f", "clean_rate")),
        ("warning", "gold_total", F.col("gold_total") < gates.min_human_verified, F.format_string("%d gold cases", F.col("gold_total").cast("long"))),
        ("warning", "stage4_share", F.col("stage4_share") > gates.max_stage4_share, F.format_string("stage 4 gives %.4f", "stage4_share")),
    ]
    if strict:
        rules.append(("blocker", "human_verified", F.col("human") < gates.min_human_verified, F.format_string("%d verified cases", F.col("human").cast("long"))))
    if baseline is None:
        rules.append(("warning", "no_baseline", F.lit(True), F.lit("no baseline")))
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"), m.alias("message"))) for s, k, c, m in rules]), lambda x: x.isNotNull())
    out = headline.select(F.explode(found).alias("g")).select("g.*")
    if baseline is not None:
        out = out.unionByName(regressions(per_class, baseline, gates.max_f05_drop))
    return out


def regressions(per_class: DataFrame, baseline: DataFrame, most: float) -> DataFrame:
    """Blockers for classes of the baseline that lost more than `most`; classes it lacks are skipped."""
    j = per_class.select("error_class", "f05").join(baseline.select("error_class", F.col("f05").alias("was")), "error_class")
    j = j.filter(F.col("was") - F.col("f05") > most + 1e-12)
    return j.select(F.lit("blocker").alias("severity"), F.concat(F.lit("f05_"), "error_class").alias("code"), F.format_string("%.4f after %.4f", "f05", "was").alias("message"))


def gold_lint(cases: DataFrame, lexicon: DataFrame, least: int = 3) -> DataFrame:
    """(severity, code, id) of malformed cases: errors, then warnings."""
    say = lambda df, s, c, i="id": df.select(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.col(i).alias("id"))
    known = lexicon.select("word")
    few = cases.groupBy("error_class").agg(F.count("*").alias("n")).filter(F.col("n") < least)
    twice = cases.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return (
        say(cases.filter(F.col("wrong").isNotNull() & ~F.contains(F.col("text"), F.col("wrong"))), "error", "wrong_not_in_text")
        .unionAll(say(cases.filter("wrong = right"), "error", "wrong_is_right"))
        .unionAll(say(few, "error", "few_cases", "error_class"))
        .unionAll(say(twice, "error", "duplicate_id"))
        .unionAll(say(cases.filter("error_class = 'NON_WORD'").join(known, F.col("wrong") == F.col("word"), "left_semi"), "warning", "non_word_is_known"))
        .unionAll(say(cases.filter("right IS NOT NULL AND NOT contains(right, ' ')").join(known, F.col("right") == F.col("word"), "left_anti"), "warning", "right_is_unknown"))
    )


def round_robin(pools: DataFrame, pool: str, order: list[str], n: int) -> DataFrame:
    """n rows, one of each pool in turn, small pools first; pool_rank and pool_size are kept.

    Only the first n of a pool can be among them."""
    sizes = pools.groupBy(pool).agg(F.count("*").alias("pool_size"))
    ranked = pools.withColumn("pool_rank", F.row_number().over(Window.partitionBy(pool).orderBy(*order))).filter(F.col("pool_rank") <= n)
    return ranked.join(sizes, pool).orderBy("pool_rank", "pool_size", pool).limit(n)
