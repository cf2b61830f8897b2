"""A training-data pipeline over `documents`: reject, deduplicate, decontaminate, redact, encode.

Each stage takes what its predecessor kept, as Parquet. Counted with scriptorium.llm.

Defined results: a null or empty text has too few words and goes in the first stage;
a null lang or source is a group of its own there. Of a class of near duplicates one
row stays, that of the least id, rows without id last; equal rows are one, and of
several rows of that id the one whose columns hash least. Other columns of documents go
through all stages but the last; their names may be any that don't begin with `__sc_`.
An empty benchmark contaminates nothing; empty documents give no rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, decontaminate, jaccard, quality, secrets, simhash
from scriptorium.session import remove, scratch, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; their thresholds come from docs."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8 or more), the document of the least id stays."""
    return simhash.representatives(docs, by=partial(jaccard.grouped, shingle=5, similarity=0.8))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): ids is an array of token ids."""
    out = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary_path(), arrays=True)
    return out.select("doc_id", "lang", "source", F.col("__sc_n").alias("n_tokens"), F.col("__sc_ids").alias("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("bpe encoding", encoding),
]
#: Fingerprints, guess costs and merges aren't SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes once the next one's is written; the last is read by the result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch(spark, "stage")
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
