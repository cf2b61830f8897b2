"""Lines that many documents share, by levelled sorted runs of line hashes; DataFrame operations only.

A run is a table of line keys (two 64-bit hashes) with the number of documents that hold
each, sorted within buckets of the key. A batch of documents counts its keys, merge-anti-
joins them with what the runs know to be common already, and adds the rest as a run of
level 0. Whenever a level has `fanout` runs, they are merged, bucket by bucket, into one
of the next level; all runs have the same buckets, so neither join exchanges a run. A
key that has reached `least` documents is common from then on, and kept in a partition of
its own in its run; only that one is read to anti-join. A key is written once a level.

Of documents, only hashes travel: lines are matched with the common keys by hash, and
the places of what goes return to their documents. A line that a third of all documents
hold is one row a task when it is counted, and when it is matched the join is one that
Spark splits or broadcasts by size.

Defined results: a null or empty text is one empty line; a line's key is the line
without ASCII blanks at both ends, A-Z lower-cased; a line whose key is shorter than
`shortest` stays; a line that stands several times in a document counts once; rows are
documents of their own, also if ids repeat; a text all of whose lines go is empty; other
columns are ignored; no rows give none. Keys are compared by 128 bits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import remove, scratch

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["a", "b"]


def lowered(x: Column) -> Column:
    """x with A-Z lower-cased, and nothing else; the built-in does that to ASCII, and faster."""
    return F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, UPPER.lower()))


def lines(text: str = "text") -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keys(text: str = "text", shortest: int = 1) -> Column:
    """For each line a struct of two hashes, null for one whose key is too short."""
    bare = F.transform(lines(text), lambda x: lowered(F.btrim(x, F.lit(BLANKS))))
    return F.transform(bare, lambda k: F.when(F.length(k) >= shortest, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))


class Runs:
    """Levelled runs of (a, b, docs) at path, each a table of the session's catalogue while it is there."""

    def __init__(self, spark: SparkSession, least: int = 10, fanout: int = 2, path: str | None = None):
        self.spark, self.least, self.fanout, self.path = spark, least, fanout, path or scratch(spark, "runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as counting deals keys: a task writes whole buckets
        self.levels: list[list[str]] = []

    def _saved(self, rows: DataFrame, level: int) -> None:
        name = f"scriptorium_run_{uuid.uuid4().hex}"
        out = rows.select(*KEY, "docs", (F.col("docs") >= self.least).alias("common"))
        out.write.partitionBy("common").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def common(self) -> list[DataFrame]:
        """The keys of each run that are common."""
        return [self.spark.table(t).filter("common").select(*KEY) for level in self.levels for t in level]

    def add(self, counted: DataFrame) -> None:
        """A batch's (a, b, docs), each key once."""
        for known in self.common():
            counted = counted.join(known.hint("merge"), KEY, "left_anti")
        self._saved(counted, 0)
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                self._merge(self.levels[level], level + 1)
            level += 1

    def _merge(self, tables: list[str], level: int) -> None:
        """One run of the next level for all of these."""
        tables = list(tables)
        merged = self.spark.table(tables[0]).select(*KEY, "docs")
        for t in tables[1:]:
            other = self.spark.table(t).select(*KEY, F.col("docs").alias("more"))
            merged = merged.join(other.hint("merge"), KEY, "full_outer").select(*KEY, (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))
        self._saved(merged, level)
        for own in self.levels:
            own[:] = [t for t in own if t not in tables]
        for t in tables:
            self.spark.sql(f"DROP TABLE {t}")
            remove(self.spark, f"{self.path}/{t}")

    def finished(self) -> DataFrame:
        """All runs merged to one; its common keys, as plain files, so that a skewed join with them can be split."""
        there = [t for level in self.levels for t in level]
        if len(there) > 1:
            self._merge(there, len(self.levels))
            there = [t for level in self.levels for t in level]
        schema = "a long, b long, docs long, common boolean"
        if not there:
            return self.spark.createDataFrame([], schema).select(*KEY)
        self.spark.sql(f"DROP TABLE {there[0]}")
        self.levels = []
        return self.spark.read.schema(schema).parquet(f"{self.path}/{there[0]}").filter("common").select(*KEY)


def counted(hashed: DataFrame) -> DataFrame:
    """(a, b, docs) of rows with an array of keys: documents that hold each. Sorted, the first of equal keys stands for the document."""
    s = hashed.select(F.array_sort(F.filter("keys", lambda k: k.isNotNull())).alias("s"))
    once = s.select(F.explode(F.filter("s", lambda k, i: (i == 0) | (k != F.get("s", i - 1)))).alias("k"))
    return once.groupBy("k.a", "k.b").agg(F.count("*").alias("docs"))


def deduplicated(docs: DataFrame, least: int = 10, shortest: int = 1, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept): all docs without the lines whose key stands in `least` documents or more.

    Documents are added in batches, as those of several days would be; the result doesn't depend on how many. Rows of
    equal id and text are one when places return to them, as these are the same."""
    spark = docs.sparkSession
    x, y = F.xxhash64(id_col, text), F.xxhash64(F.lit(1), text, id_col)
    path = scratch(spark, "lines")
    docs.select(x.alias("x"), y.alias("y"), keys(text, shortest).alias("keys"), F.pmod(x, F.lit(batches)).alias("batch")).write.partitionBy("batch").parquet(path)
    hashed = spark.read.schema("x long, y long, keys array<struct<a:long,b:long>>, batch long").parquet(path)
    runs = Runs(spark, least, fanout)
    for i in range(batches):
        runs.add(counted(hashed.filter(F.col("batch") == i)))
    every = hashed.select("x", "y", F.posexplode("keys").alias("at", "k")).filter("k is not null").select("x", "y", "at", "k.a", "k.b")
    gone = every.join(runs.finished(), KEY, "left_semi").groupBy("x", "y").agg(F.collect_set("at").alias("gone"))
    gone = gone.select(F.col("x").alias("__sc_x"), F.col("y").alias("__sc_y"), F.col("gone").alias("__sc_gone"))  # the id may have any name
    own = docs.select(id_col, F.coalesce(text, F.lit("")).alias("__sc_text"), x.alias("__sc_x"), y.alias("__sc_y")).join(gone, ["__sc_x", "__sc_y"], "left")
    ln = F.split("__sc_text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__sc_lines") - 1), "__sc_gone")
    kept = F.when(F.col("__sc_gone").isNull(), F.col("__sc_text")).otherwise(F.array_join(F.transform(stay, lambda p: F.get("__sc_lines", p)), "\n"))
    return own.withColumn("__sc_lines", ln).select(
        id_col, F.size("__sc_lines").cast("long").alias("n_lines"), F.coalesce(F.size("__sc_gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept")
    )
