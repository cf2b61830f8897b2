"""Usage analytics over an event log, by built-ins.

Events: type (check, accept, ignore), day, user, words, issues, out_of_scope,
error_class. The anchor date stands for today, so results don't depend on when
they are computed. Every aggregate has partial sums before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_driver_events(events: DataFrame) -> DataFrame:
    """The driver's events in this shape: view is check, purchase accept, error ignore; others are left out."""
    kind = F.when(F.col("event_type") == "view", "check").when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "ignore")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        kind.alias("type"), F.to_date("ts").alias("day"), "ts", "user_id", F.floor("value").cast("long").alias("words"), k.alias("issues"),
        (k % 3).alias("out_of_scope"), F.concat(F.lit("C"), (k % 12).cast("string")).alias("error_class"),
    ).filter(F.col("type").isNotNull())


def _measures() -> list[Column]:
    one = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, 1)), F.lit(0)).cast("long")
    add = lambda c: F.coalesce(F.sum(F.when(F.col("type") == "check", F.col(c))), F.lit(0)).cast("long")
    return [one("check").alias("checks"), add("issues").alias("issues"), add("out_of_scope").alias("out_of_scope"), one("accept").alias("accepted"), one("ignore").alias("ignored")]


def daily(events: DataFrame) -> DataFrame:
    """A row per day: the measures and the largest number of words."""
    return events.groupBy("day").agg(*_measures(), F.coalesce(F.max(F.when(F.col("type") == "check", F.col("words"))), F.lit(0)).alias("words"))


def summary(days: DataFrame, *by: str) -> DataFrame:
    """Totals of daily rows; words are the sum of each day's largest."""
    g = days.groupBy(*by) if by else days.groupBy()
    total = g.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("checks", "issues", "out_of_scope", "accepted", "ignored", "words")])
    done = F.col("accepted") + F.col("ignored")
    return total.withColumn("accept_rate", F.when(done > 0, F.col("accepted") / done).otherwise(0.0))


def anchor(events: DataFrame) -> DataFrame:
    """One row, (today): the last day of events."""
    return events.agg(F.max("day").alias("today"))


def rolling(events: DataFrame) -> DataFrame:
    """summary() of today, the last 7 and the last 30 days."""
    spans = F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.lit(d).alias("back")) for n, d in (("today", 0), ("week", 6), ("month", 29))]))
    # anchor() is one row whatever the size of the log.
    days = daily(events).crossJoin(F.broadcast(anchor(events))).select("*", spans.alias("s"))
    inside = F.when(F.col("s.bucket") == "today", F.col("day") == F.col("today")).otherwise(F.col("day") >= F.date_sub("today", F.col("s.back")))
    return summary(days.filter(inside).withColumn("bucket", F.col("s.bucket")), "bucket")


def last_days(events: DataFrame, n: int = 14) -> DataFrame:
    """(day, words, issues, accepted) of the last n days, oldest first, with zeros."""
    spine = anchor(events).select(F.explode(F.sequence(F.date_sub("today", n - 1), F.col("today"))).alias("day"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return spine.join(daily(events), "day", "left").select("day", zero("words"), zero("issues"), zero("accepted"))


def by_class(events: DataFrame) -> DataFrame:
    """(error_class, accepted, ignored, total), most first; as many rows as there are classes."""
    one = lambda t: F.sum(F.when(F.col("type") == t, 1).otherwise(0)).cast("long").alias(t)
    g = events.filter(F.col("type").isin("accept", "ignore")).groupBy("error_class").agg(one("accept"), one("ignore"))
    return g.select("error_class", F.col("accept").alias("accepted"), F.col("ignore").alias("ignored"), (F.col("accept") + F.col("ignore")).alias("total")).orderBy(F.desc("total"), "error_class")


def total(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("n"))


def local_day(ts: Column, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd")
