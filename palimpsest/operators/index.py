"""A stored index of tokens: buckets of postings that a lookup prunes, kept up by deltas.

A delta is the postings of new texts, in folders by a hash of the token and sorted
by token there, so a lookup of some tokens lists a few folders and skips what its
row groups' bounds rule out.  A text that is indexed again, or taken out, is
written to the deaths with the number of the delta from which on older postings of
its key no longer count.  Compaction writes the live postings as one delta.
All of it is committed: a reader sees whole deltas, and two writers never the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.driver import query_tokens
from palimpsest.sources import committed

BUCKETS = 64
POSTINGS = "bucket int, token string, key string, delta long"
DEATHS = "key string, until long"


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _postings(rows: DataFrame, delta: int) -> DataFrame:
    tokens = rows.select(F.explode(T.tokens("text")).alias("token"), F.col("key").cast("string").alias("key"))
    return _sorted(tokens.select(bucket(F.col("token")).alias("bucket"), "token", "key", F.lit(delta).cast("long").alias("delta")))


def _sorted(rows: DataFrame) -> DataFrame:
    """By bucket and token; range partitions, so that a common token stands in several files."""
    return rows.repartitionByRange("bucket", "token", "key").sortWithinPartitions("bucket", "token", "key")


def add(spark: SparkSession, store: str, rows: DataFrame) -> int:
    """Index texts (key, text), one a key; texts that these keys had before count no more."""

    def change(now: committed.Snapshot):
        delta = now.version + 1
        dead = rows.select(F.col("key").cast("string").alias("key"), F.lit(delta).cast("long").alias("until"))
        return {"added": {"postings": _postings(rows, delta), "deaths": dead}, "note": {"operation": "add"}, "by": {"postings": ["bucket"]}}, None

    return committed.retried(spark, store, change)[0]


def remove(spark: SparkSession, store: str, keys: DataFrame) -> int:
    """Take texts out by key."""

    def change(now: committed.Snapshot):
        dead = keys.select(F.col("key").cast("string").alias("key"), F.lit(now.version + 1).cast("long").alias("until"))
        return {"added": {"deaths": dead}, "note": {"operation": "remove"}}, None

    return committed.retried(spark, store, change)[0]


def live(now: committed.Snapshot, spark: SparkSession, rows: DataFrame | None = None) -> DataFrame:
    """Postings (of ``rows`` of them) that no later delta has put an end to."""
    rows = now.table(spark, "postings", POSTINGS) if rows is None else rows
    until = now.table(spark, "deaths", DEATHS).groupBy("key").agg(F.max("until").alias("until"))
    return rows.join(until, "key", "left").where("until IS NULL OR delta >= until").drop("until")


def compact(spark: SparkSession, store: str) -> int:
    """Merge all deltas into one, without the dead."""

    def change(now: committed.Snapshot):
        delta = now.version + 1
        rows = _sorted(live(now, spark).select("bucket", "token", "key", F.lit(delta).cast("long").alias("delta")))
        return {"replaced": {"postings": rows, "deaths": spark.createDataFrame([], DEATHS)}, "note": {"operation": "compact"}, "by": {"postings": ["bucket"]}}, None

    return committed.retried(spark, store, change)[0]


def buckets_of(spark: SparkSession, tokens: list[str]) -> list[int]:
    """The folders that hold the tokens of a query."""
    return sorted({r[0] for r in spark.createDataFrame([(x,) for x in tokens], "token string").select(bucket(F.col("token"))).collect()})


def lookup(spark: SparkSession, store: str, tokens: list[str], version: int | None = None) -> DataFrame:
    """(token, key) of the live postings of some tokens: only their buckets are listed and read."""
    now = committed.snapshot(spark, store, version)
    if not tokens:
        return spark.createDataFrame([], "token string, key string")
    rows = now.table(spark, "postings", POSTINGS)
    rows = rows.where(F.col("bucket").isin(buckets_of(spark, tokens)) & F.col("token").isin(tokens))
    return live(now, spark, rows).select("token", "key")


def holding_all(spark: SparkSession, store: str, query: str) -> DataFrame:
    """Keys of texts that hold every token of a query; without a token, none."""
    tokens = query_tokens(query)
    found = lookup(spark, store, tokens).groupBy("key").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(tokens)).select("key")
