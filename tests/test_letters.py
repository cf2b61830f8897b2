"""Capitals letter by letter."""

from pyspark.sql import functions as F
from scriptorium.functions.letters import u, upper_by_letter


def test_capitals_keep_the_length(spark):
    given = ["a", "é", "1", u("DF"), u("149"), u("FB01"), u("1F80"), u("1F50"), u("1C6"), ""]
    want = ["A", "É", "1", u("1E9E"), u("149"), u("FB01"), u("1F88"), u("1F50"), u("1C4"), ""]
    rows = spark.createDataFrame([(x,) for x in given], "x string").select(upper_by_letter(F.col("x"))).collect()
    assert [r[0] for r in rows] == want
