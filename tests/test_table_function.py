"""check_table over tables against check(), and what it refuses."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from scriptorium.config import PipelineConfig
from scriptorium.plans.check import check, register_table_function

from tests.test_offsets import bengali


@pytest.fixture(scope="module")
def docs(spark):
    register_table_function(spark)
    rows = [(i, "s" if i and i % 2 else None, t) for i, t in [*bengali(8, 40), (1, "ক ,খ"), (None, "ক ,খ"), (77, None), (78, "")]]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string").repartition(3)
    df.createOrReplaceTempView("some_docs")
    return df


FIELDS = ("doc_id", "start", "end", "original", "suggestions", "error_class", "confidence", "stage", "rule", "seq", "surfaced")


def rows(df):
    return sorted(map(repr, df.select(*FIELDS).collect()))


@pytest.mark.parametrize("code", ["bn", "la"])
def test_equals_check(spark, docs, code):
    got = spark.sql(f"SELECT * FROM check_table(TABLE(some_docs), '{code}')")
    assert got.columns[:3] == ["doc_id", "source", "start"]
    assert rows(got) == rows(check(docs, code)["edits"]) and got.count() > 10


def test_partitioned_tables_and_options(spark, docs):
    got = spark.sql("SELECT * FROM check_table(TABLE(some_docs) PARTITION BY (source), 'bn', min_confidence => 0.8, max_edits => 2, max_suggestions => 1)")
    assert rows(got) == rows(check(docs, "bn", PipelineConfig(min_confidence=0.8, max_edits=2, max_suggestions=1))["edits"])


def test_clashing_columns_are_left_out(spark, docs):
    docs.withColumn("start", F.lit("x")).withColumn("rule", F.lit(1)).createOrReplaceTempView("clashing")
    assert rows(spark.sql("SELECT * FROM check_table(TABLE(clashing), 'bn')")) == rows(check(docs, "bn")["edits"])


def test_longer_texts_than_allowed_have_no_rows(spark, docs):
    got = spark.sql("SELECT * FROM check_table(TABLE(some_docs), 'bn', max_text => 20)")
    assert rows(got) == rows(check(docs, "bn", PipelineConfig(max_text=20))["edits"])


@pytest.mark.parametrize("call", ["check_table(TABLE(SELECT 1 AS x), 'bn')", "check_table(TABLE(some_docs), 'xx')", "check_table(TABLE(some_docs), 'bn', speed => 2)", "check_table('text', 'bn')"])
def test_refused(spark, docs, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM {call}").collect()
