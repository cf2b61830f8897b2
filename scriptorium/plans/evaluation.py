"""Detectors against a folder of gold cases: counts, scores, and the gate against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.config import Gates, PipelineConfig
from scriptorium.operators import evaluate
from scriptorium.plans.check import check
from scriptorium.session import cut
from scriptorium.sources import tables


def evaluated(spark: SparkSession, path: str, code: str = "bn", config: PipelineConfig = PipelineConfig()) -> tuple[DataFrame, DataFrame]:
    """(per class: support, tp, fp, fn, precision, recall, f05) and one headline row (macro_f05, clean_rate,
    gold_total, human, stage4_share) of the gold cases and clean sentences in path."""
    cases = evaluate.gold_spans(tables.gold(spark, path))
    found = cut(check(cases.select("id", "text"), code, config, "id")["edits"].filter("surfaced"))
    sentences = tables.clean(spark, path).select(F.col("sent_id").alias("id"), "text")
    wrong = cut(check(sentences, code, config, "id")["edits"].filter("surfaced"))
    per_class = cut(evaluate.metrics(evaluate.confusion(cases, found, wrong, evaluate.classes(spark))))
    headline = evaluate.macro_f05(per_class).crossJoin(F.broadcast(evaluate.clean_rate(sentences, wrong).select(F.col("rate").alias("clean_rate"))))  # one row each
    total = cases.agg(F.count("*").alias("gold_total"), F.count(F.when(F.col("review") == "human", 1)).alias("human"))
    share = evaluate.stage_share(found.select("stage", "surfaced").union(wrong.select("stage", "surfaced"))).select(F.col("share").alias("stage4_share"))
    return per_class, headline.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(share))


def gated(spark: SparkSession, path: str, code: str = "bn", baseline: str | None = None, strict: bool = False, gates: Gates = Gates()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """evaluated(), and the (severity, code, message) of the gate; baseline: a folder that write_baseline wrote."""
    per_class, headline = evaluated(spark, path, code)
    old = tables.read_baseline(spark, baseline).select("error_class", "f05") if baseline else None
    return per_class, headline, evaluate.gate(headline, per_class, old, gates, strict)
