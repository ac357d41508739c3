"""Change detection, membership, retries and schedules of repeated collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_fetch(known: DataFrame, seen: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Seen ids whose version was never completed."""
    old = known.select(key, F.col(version).alias("old"))
    return seen.join(old, key, "left").where(~F.col(version).eqNullSafe(F.col("old"))).select(key, version)


def membership(known: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Known ids with ``present``: whether the scan saw them."""
    return known.join(seen.select(key, F.lit(True).alias("s")).distinct(), key, "left").withColumn("present", F.coalesce("s", F.lit(False))).drop("s")


def pruned(known: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    return known.join(seen, key, "left_anti")


def retry_minutes(attempt: Column) -> Column:
    """15 minutes, 1, 6 and 24 hours."""
    return F.element_at(F.array(*map(F.lit, (15, 60, 360, 1440))), F.least(F.greatest(attempt, F.lit(1)), F.lit(4)).cast("int"))


def backoff_ms(attempt: Column, retry_after_s: Column | None = None, most: int = 15_000) -> Column:
    wait = F.least(F.lit(500) * F.pow(F.lit(2), attempt - 1), F.lit(most))
    return F.coalesce(F.least(retry_after_s * 1000, F.lit(most)), wait) if retry_after_s is not None else wait


def retryable(status: Column) -> Column:
    return status.isNull() | status.isin(408, 409, 429) | (status >= 500)


def next_run(after: Column, frequency: Column, hour: Column, weekday: Column) -> Column:
    """The next daily or weekly (1: Sunday) run at an hour after an instant."""
    day = F.date_trunc("DAY", after)
    at = lambda d: F.timestamp_add("HOUR", hour, d)
    daily = F.when(at(day) > after, at(day)).otherwise(at(F.timestamp_add("DAY", F.lit(1), day)))
    ahead = F.pmod(weekday - F.dayofweek(day), F.lit(7))
    weekly = F.when(at(F.timestamp_add("DAY", ahead, day)) > after, at(F.timestamp_add("DAY", ahead, day))).otherwise(at(F.timestamp_add("DAY", ahead + 7, day)))
    return F.when(frequency == "weekly", weekly).otherwise(daily)


def progress(phase: Column, done: Column, total: Column) -> Column:
    """Percent of a backup: phases weigh 15, 55, 5 and 24; the last point is its completion."""
    share = F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(0.0)
    return (
        F.when(phase == "indexing", 15 * share).when(phase == "exporting", 15 + 55 * share).when(phase == "asset_indexing", 70 + 5 * share)
        .when(phase == "asset_downloading", 75 + 24 * share).when(phase == "completed", 100.0).otherwise(0.0)
    )
