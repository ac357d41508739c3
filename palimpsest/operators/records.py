"""Content records: normalisation, validation, evidence checks, transitions, promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import clean, parsed_uri

# Kinds and states of content objects.
KINDS = ("note", "flash", "web_excerpt", "ai_excerpt", "conversation", "image", "file")
STATES = ("active", "archived", "trashed")


def normalised(rows: DataFrame) -> DataFrame:
    """Objects with known kinds and states, clamped texts, distinct tags, a positive revision, and their hash."""
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("note")
    title, body = clean("title", 1000), clean("body", 2_000_000)
    cut = F.when(kind == "flash", clean("body", 80)).otherwise("Untitled")
    out = rows.select(
        clean("id", 240).alias("id"), kind.alias("kind"), F.nullif(clean("project_id", 300), F.lit("")).alias("project_id"), F.when(title == "", cut).otherwise(title).alias("title"), body.alias("body"),
        F.slice(F.array_distinct(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t) != "")), 1, 200).alias("tags"),
        F.when(F.col("status").isin(*STATES), F.col("status")).otherwise("active").alias("status"), F.greatest(F.lit(1), F.coalesce(F.floor("revision"), F.lit(1))).cast("long").alias("revision"),
    )
    return out.withColumn("digest", F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*out.columns)), 256)))


def issues(rows: DataFrame, schema_version: int = 1) -> DataFrame:
    """(id, path) of what is wrong with objects."""
    tests = [("schemaVersion", F.col("schema_version") != schema_version), ("id", F.trim(F.coalesce("id", F.lit(""))) == ""), ("title", F.trim(F.coalesce("title", F.lit(""))) == ""), ("revision", F.coalesce(F.col("revision") < 1, F.lit(True))), ("contentHash", ~F.coalesce("digest", F.lit("")).startswith("sha256:"))]
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), name) for name, test in tests)))
    return rows.select("id", F.explode(found).alias("path"))


def verified(uris: DataFrame, versions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(uri, reason) of cited addresses: ok, or why not.  versions (id, revision, digest); evidence (conversation_id, node_id, evidence_hash)."""
    u = uris.select("uri").distinct().withColumn("e", parsed_uri("uri"))
    v = versions.select(F.col("id").alias("vi"), F.col("revision").cast("string").alias("vr"), F.col("digest").alias("vd"))
    h = evidence.select(F.col("conversation_id").alias("hc"), F.col("evidence_hash").alias("hh")).distinct()
    n = evidence.select(F.col("conversation_id").alias("nc"), F.col("evidence_hash").alias("nh"), F.col("node_id").alias("nn")).distinct()
    content = u.where("e.kind = 'content'").join(v, (F.col("e.id") == F.col("vi")) & (F.col("e.part") == F.col("vr")), "left")
    content = content.select("uri", F.when(F.col("vd").isNull(), "content_version_not_found").when(F.col("vd") != F.col("e.hash"), "content_hash_mismatch").otherwise("ok").alias("reason"))
    talk = u.where("e.kind = 'conversation'").join(h, (F.col("e.id") == F.col("hc")) & (F.col("e.hash") == F.col("hh")), "left")
    talk = talk.join(n, (F.col("e.id") == F.col("nc")) & (F.col("e.hash") == F.col("nh")) & (F.col("e.part") == F.col("nn")), "left")
    talk = talk.select("uri", F.when(F.col("hc").isNull(), "evidence_not_found").when(F.col("nn").isNull(), "node_not_found").otherwise("ok").alias("reason"))
    return content.union(talk).union(u.where("e IS NULL").select("uri", F.lit("invalid_uri")))


def projects(*sources: DataFrame) -> DataFrame:
    """(project_id, title) of several tables (project_id, title); a later table's title replaces an earlier one's."""
    rows = None
    for rank, df in enumerate(sources):
        part = df.where("project_id IS NOT NULL").select("project_id", F.coalesce("title", "project_id").alias("title"), F.lit(rank).alias("rank"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("project_id").agg(F.max_by("title", F.struct("rank", "title")).alias("title"))


def statistics(objects: DataFrame, project: str = "project_id", tag: str = "tag", size: str = "size", key: str = "id") -> DataFrame:
    """One row about a library: objects, projects, tags and their text."""
    return objects.agg(F.count_distinct(key).alias("objects"), F.count_distinct(project).alias("projects"), F.count_distinct(tag).alias("tags"), F.sum(size).alias("chars"))


def rollup(objects: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per project: objects (id, project, title, chars), their text, the latest one and its title, and what reviews (id, quality, toxic) say."""
    rows = objects.join(reviews, "id", "left")
    return rows.groupBy("project").agg(
        F.count("*").alias("objects"), F.sum("chars").alias("chars"), F.max("id").alias("latest"), F.max_by("title", "id").alias("title"), F.count("quality").alias("reviewed"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("restricted")
    )


def counters(log: DataFrame, kind: str, value: str, key: str, over: float) -> DataFrame:
    """Per kind of a log: entries, those over a value, the total, first and last."""
    return log.groupBy(kind).agg(F.count("*").alias("events"), F.count_if(F.col(value) > over).alias("large"), F.round(F.sum(value), 4).alias("total"), F.min(key).alias("first"), F.max(key).alias("last"))


def listed(objects: DataFrame, order: list, limit: int = 100, **equal) -> DataFrame:
    """The first objects in an order, of those whose columns have the given values (None: any)."""
    for name, value in equal.items():
        if value is not None:
            objects = objects.where(F.col(name) == value)
    return objects.orderBy(*order).limit(limit)


def moved(status: Column, action: Column) -> Column:
    """The state after archive, trash or restore; null where the action does not apply."""
    return (
        F.when((action == "archive") & (status == "active"), "archived").when((action == "trash") & status.isin("active", "archived"), "trashed")
        .when((action == "restore") & status.isin("archived", "trashed"), "active")
    )


def promoted(objects: DataFrame, kind: Column) -> DataFrame:
    """Drafts of decisions, tasks or memories from content objects, waiting for review."""
    return objects.select(F.concat_ws(":", F.lit("promotion"), "id", F.col("revision").cast("string")).alias("id"), "project_id", F.col("id").alias("source_id"), F.col("revision").alias("source_revision"), kind.alias("target"), F.lit("pending_review").alias("status"), F.substring("title", 1, 500).alias("title"), F.struct(F.substring("body", 1, 20_000).alias("summary")).alias("draft"))


def reviewed(promotions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Promotions after verdicts (id, verdict); only pending ones change."""
    rows = promotions.join(verdicts.select("id", "verdict"), "id", "left")
    return rows.withColumn("status", F.when((F.col("status") == "pending_review") & F.col("verdict").isNotNull(), F.col("verdict")).otherwise(F.col("status"))).drop("verdict")
