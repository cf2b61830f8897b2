"""The queries opN_<name> over the shared tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, chat, decontaminate, lattice, licenses, linededup, quality, resample, search, secrets, simhash, substrings, warc
from scriptorium.llm.sql import CHAT_SQL, DECONTAMINATION_SQL, LINE_SQL, QUALITY_SQL, RESAMPLING_SQL, SEARCH_SQL, SUBSTRING_SQL, WARC_SQL
from scriptorium.session import scratch, table


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses, the families (sorted, comma-joined) and family:start:end of the paragraphs."""
    found = licenses.report(table(spark, sf_dir, "documents"))
    spans = F.transform("paragraphs", lambda p: F.concat_ws(":", p["family"], p["start"].cast("string"), p["end"].cast("string")))
    return found.select(
        "doc_id", F.size("paragraphs").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.col("paragraphs.family"))), ",").alias("families"), F.array_join(spans, ",").alias("spans"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bpe.vocabulary_path()
    found = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path, "__sc_ids")
    return found.select("doc_id", F.col("__sc_n").alias("n_tokens"), F.sha2("__sc_ids", 256).alias("ids_sha256"), F.sha2("__sc_text", 256).alias("decoded_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.save(warc.records(table(spark, sf_dir, "pages")), path)
    return warc.page_report(spark, path)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.report(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[secrets.count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(secrets.joined(secrets.KINDS[:3]), 256).alias("base_sha256"), secrets.joined(secrets.KINDS).alias("spans"),
    )


def op8_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scores(table(spark, sf_dir, "documents"), lattice.vocabulary_path())


def op9_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(chat.stale_reply_pairs(chat.conversations(table(spark, sf_dir, "conversations"))))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.removed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=20)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.deduplicated(table(spark, sf_dir, "documents"), least=10, shortest=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_duplicates": op1_simhash_near_duplicates,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scan": op7_secret_scan,
    "op8_lattice_scores": op8_lattice_scores,
    "op9_preference_chat": op9_preference_chat,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_line_dedup": op13_line_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": DECONTAMINATION_SQL,
    "op5_warc": WARC_SQL,
    "op6_quality_rules": QUALITY_SQL,
    "op9_preference_chat": CHAT_SQL,
    "op10_substring_dedup": SUBSTRING_SQL,
    "op11_ranked_search": SEARCH_SQL,
    "op12_importance_resampling": RESAMPLING_SQL,
    "op13_line_dedup": LINE_SQL,
}
