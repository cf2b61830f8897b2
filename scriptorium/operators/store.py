"""Small upsert tables as DataFrames: devices, users and what belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.upserts import UpsertLog
from scriptorium.session import remove
from scriptorium.sources.files import exists, listed

TABLES = {
    "devices": "device_id string, user_id string, recovery_hash string, created_at timestamp, last_seen_at timestamp",
    "users": "user_id string, created_at timestamp",
    "documents": "document_id string, device_id string, user_id string, body string, created_at timestamp",
    "error_events": "event_id string, device_id string, user_id string, error_class string, occurred_on date",
    "streaks": "device_id string, user_id string, days int",
    "entitlements": "device_id string, user_id string, tier string",
}
FREE_TIER = "free_unlimited"


def opened(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the store at path, by its newest version that was written whole; empty ones where there is none."""
    version = max(versions(spark, path), default=0)
    where = {n: f"{path}/v{version}/{n}" for n in TABLES}
    return {n: spark.read.schema(d).parquet(where[n]) if version and exists(spark, where[n]) else spark.createDataFrame([], d) for n, d in TABLES.items()}


def saved(spark: SparkSession, tables: dict[str, DataFrame], path: str, keep: int = 2) -> int:
    """Writes all tables as one new version, which counts once its mark is there: all of them or none.

    The newest `keep` versions stay, so that what still reads the one before can end; older ones go."""
    version = max(versions(spark, path), default=0) + 1
    for n in TABLES:
        tables[n].write.mode("overwrite").parquet(f"{path}/v{version}/{n}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/v{version}/_done")
    for old in versions(spark, path):
        if old <= version - keep:
            remove(spark, f"{path}/v{old}")
    return version


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are there whole."""
    return sorted(int(n[1:]) for n in listed(spark, path) if n[:1] == "v" and n[1:].isdigit() and exists(spark, f"{path}/{n}/_done"))


def devices_log(spark: SparkSession, path: str, **how: int) -> UpsertLog:
    """Devices as a log of deltas: when each was first and last seen, its user and its recovery hash."""
    schema = "device_id string, user_id string, recovery_hash string, created_at timestamp, last_seen_at timestamp"
    rules = (("user_id", "last by last_seen_at"), ("recovery_hash", "last by last_seen_at"), ("created_at", "min"), ("last_seen_at", "max"))
    return UpsertLog(spark, path, "device_id", schema, rules, **how)


def first_last(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(device_id, created_at, last_seen_at): what upserting each event in order ends in."""
    return events.groupBy(F.col(user).alias("device_id")).agg(F.min(ts).alias("created_at"), F.max(ts).alias("last_seen_at"))


def upserted_devices(before: DataFrame, seen: DataFrame) -> DataFrame:
    """Devices after those in seen were met: created_at stays, last_seen_at moves on."""
    a, b = before.alias("a"), seen.alias("b")
    j = a.join(b, F.col("a.device_id") == F.col("b.device_id"), "full_outer")
    own = [c for c in before.columns if c not in ("device_id", "created_at", "last_seen_at")]
    return j.select(
        F.coalesce("a.device_id", "b.device_id").alias("device_id"), *[F.col(f"a.{c}") for c in own],
        F.coalesce("a.created_at", "b.created_at").alias("created_at"), F.greatest("a.last_seen_at", "b.last_seen_at").alias("last_seen_at"),
    )


def inserted_or_ignored(before: DataFrame, rows: DataFrame, key: str = "device_id") -> DataFrame:
    return before.unionByName(rows.join(before.select(key), key, "left_anti"), allowMissingColumns=True)


def ensure_devices(tables: dict[str, DataFrame], seen: DataFrame) -> dict[str, DataFrame]:
    """tables with each device of seen known, entitled and with a streak."""
    ids = seen.select("device_id").distinct()
    return tables | {
        "devices": upserted_devices(tables["devices"], seen),
        "entitlements": inserted_or_ignored(tables["entitlements"], ids.withColumn("tier", F.lit(FREE_TIER))),
        "streaks": inserted_or_ignored(tables["streaks"], ids.withColumn("days", F.lit(0))),
    }


def attach_recovery(devices: DataFrame, device_id: str, digest: str) -> DataFrame:
    return devices.withColumn("recovery_hash", F.when(F.col("device_id") == device_id, digest).otherwise(F.col("recovery_hash")))


def device_for_recovery(devices: DataFrame, digest: str) -> DataFrame:
    return devices.filter(F.col("recovery_hash") == digest)


def tier_for(entitlements: DataFrame, device_id: str, free: bool = True) -> str:
    """The tier of a device; while everything is free, that of all."""
    if free:
        return FREE_TIER
    row = entitlements.filter(F.col("device_id") == device_id).select("tier").first()
    return row[0] if row else "none"


def upgraded(tables: dict[str, DataFrame], device_id: str, user_id: str) -> tuple[dict[str, DataFrame], int]:
    """tables with the device's rows without a user bound to user_id, and how many those are.

    An unknown device raises KeyError, another user's PermissionError; doing it twice changes nothing."""
    row = tables["devices"].filter(F.col("device_id") == device_id).select("user_id").first()
    if row is None:
        raise KeyError(device_id)
    if row[0] not in (None, user_id):
        raise PermissionError(f"device {device_id} belongs to another user")
    out, touched = dict(tables), 0
    for name, t in tables.items():
        if {"device_id", "user_id"} <= set(t.columns):
            free = (F.col("device_id") == device_id) & F.col("user_id").isNull()
            touched += t.filter(free).count()
            out[name] = t.withColumn("user_id", F.when(free, user_id).otherwise(F.col("user_id")))
    return out, touched
