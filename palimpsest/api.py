"""The query surface: twelve functions over the tables of a bundle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import gate, search


@dataclass
class Bundle:
    """messages (key, conversation_id, node_id, role, text, active, created_at), conversations (conversation_id, title, project_id, project_title,
    archived, updated_at, evidence_hash), objects (id, kind, project_id, title, body, tags, status, revision, digest, updated_at), states, and further tables."""

    messages: DataFrame
    conversations: DataFrame
    objects: DataFrame
    states: DataFrame
    more: dict[str, DataFrame] = field(default_factory=dict)


def bounded(n: int, most: int) -> int:
    return max(1, min(int(n), most))


def stats(b: Bundle) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    projects = b.conversations.select("project_id").union(b.objects.select("project_id")).union(b.states.select("project_id")).where("project_id IS NOT NULL").agg(F.count_distinct("project_id").alias("projects"))
    out = one(b.conversations, "conversations")
    for df in (one(b.messages, "messages"), one(b.objects, "content_objects"), one(b.states, "states"), projects):
        out = out.crossJoin(df)  # one row each
    return out


def list_projects(b: Bundle) -> DataFrame:
    counts = b.messages.groupBy("conversation_id").agg(F.count("*").alias("messages"))
    talks = b.conversations.where("project_id IS NOT NULL").join(counts, "conversation_id", "left").select("project_id", "project_title", "updated_at", F.lit(1).alias("c"), F.coalesce("messages", F.lit(0)).alias("m"), F.lit(0).alias("o"))
    things = b.objects.where("project_id IS NOT NULL AND status <> 'trashed'").select("project_id", F.lit(None).cast("string"), "updated_at", F.lit(0), F.lit(0).cast("long"), F.lit(1))
    rows = talks.union(things).groupBy("project_id").agg(F.max_by("project_title", F.when(F.col("project_title").isNotNull(), F.col("updated_at"))).alias("title"), F.sum("c").alias("conversations"), F.sum("m").alias("messages"), F.sum("o").alias("content_objects"), F.max("updated_at").alias("updated_at"))
    return rows.orderBy(F.desc_nulls_last("updated_at"), "title")


def search_messages(b: Bundle, query: str, limit: int = 20, **filters) -> DataFrame:
    rows = b.messages.join(b.conversations, "conversation_id")
    rows = search.narrowed(rows, **filters).withColumn("whole", F.concat_ws("\n", "title", "text"))
    found = search.search(rows, query, bounded(limit, 200), "updated_at", "key", "whole", phrase_only=True)
    return found.select("key", "conversation_id", "node_id", "role", "score", T.snippet("text", query).alias("snippet"), T.message_uri("conversation_id", "node_id", "evidence_hash").alias("uri"))


def list_content(b: Bundle, limit: int = 100, project: str | None = None, kind: str | None = None, status: str | None = None, trashed: bool = False) -> DataFrame:
    rows = b.objects
    for name, value in (("project_id", project), ("kind", kind), ("status", status)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if status is None and not trashed:
        rows = rows.where("status <> 'trashed'")
    return rows.orderBy(F.desc_nulls_last("updated_at"), "id").limit(bounded(limit, 1000))


def search_content(b: Bundle, query: str, limit: int = 20) -> DataFrame:
    return search.search_objects(b.objects.where("status <> 'trashed'"), query, bounded(limit, 200))


def read_content(b: Bundle, object_id: str, max_chars: int = 100_000) -> DataFrame:
    return b.objects.where(F.col("id") == object_id).withColumn("body", T.clip("body", max(200, min(max_chars, 1_000_000))))


def read_conversation(b: Bundle, conversation_id: str, roles=None, active_only: bool = True, limit: int = 200, max_chars: int = 12_000) -> DataFrame:
    rows = b.messages.where(F.col("conversation_id") == conversation_id)
    if active_only:
        rows = rows.where("active")
    if roles:
        rows = rows.where(F.col("role").isin(list(roles)))
    return rows.orderBy(F.col("depth") if "depth" in rows.columns else F.col("created_at"), "node_id").limit(bounded(limit, 2000)).withColumn("text", T.clip("text", max_chars))


def project_snapshot(b: Bundle, project: str) -> DataFrame:
    counts = b.messages.groupBy("conversation_id").agg(F.count("*").alias("messages"))
    talks = b.conversations.where(F.col("project_id") == project).join(counts, "conversation_id", "left").agg(F.count("*").alias("conversations"), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), F.max("updated_at").alias("talk_at"))
    things = b.objects.where((F.col("project_id") == project) & (F.col("status") != "trashed")).agg(F.count("*").alias("content_objects"), F.max("updated_at").alias("object_at"))
    return talks.crossJoin(things).withColumn("updated_at", F.greatest("talk_at", "object_at")).drop("talk_at", "object_at")  # one row each


def source_evidence(b: Bundle, conversation_id: str, max_chars: int = 20_000) -> DataFrame:
    return b.more["evidence"].where(F.col("conversation_id") == conversation_id).withColumn("canonical", F.substring("canonical", 1, max_chars))


def memory_gate(b: Bundle, project: str, now: str, budget: int = 2048, policy: str = "balanced", target: str = "internal") -> DataFrame:
    return gate.evaluate(gate.candidates(b.states.where(F.col("project_id") == project)), project, now, budget, policy, target)


def context_pack(b: Bundle, query: str, budget: int = 8192, per_conversation: int = 3, most: int | None = None) -> DataFrame:
    """Excerpts in rank order while they fit, at most ``per_conversation`` of one conversation (key, tokens, taken, used).

    All messages found are ranked, unless ``most`` bounds them.  An excerpt costs a
    token at least, so no more than ``budget`` of them fit: only the costs of those
    first ones meet in one task, and what stands behind them is not taken.
    """
    from palimpsest.operators.sequences import capped, numbered

    if budget not in (2048, 8192, 32768):
        raise ValueError("budgets are 2048, 8192 or 32768")
    rows = b.messages.join(b.conversations, "conversation_id").withColumn("whole", F.concat_ws("\n", "title", "text"))
    found = search.search(rows, query, most, "updated_at", "key", "whole", phrase_only=True)
    kept = capped(found, "conversation_id", [F.desc("score"), "key"], per_conversation)
    cost = kept.select(F.lit(1).alias("pack"), "key", "conversation_id", "score", T.clip("text", 4000).alias("excerpt")).withColumn("tokens", T.estimate("excerpt"))
    placed = numbered(cost, [F.desc("score"), "key"], "place")
    held = gate.stopped(placed.where(F.col("place") <= budget).select("pack", "place", "tokens"), budget, "pack", "tokens", ["place"])
    last = held.agg(F.max("used").alias("last"))
    judged = placed.join(held.select("place", "taken", "used"), "place", "left").crossJoin(F.broadcast(last))  # one row
    return judged.withColumns({"taken": F.coalesce("taken", F.lit(False)), "used": F.coalesce("used", "last")}).drop("place", "last")


def propose(b: Bundle, project: str, kind: str, change: DataFrame, cited: DataFrame) -> DataFrame:
    """Proposal rows with the base version they are made on; citations that no message has are dropped."""
    known = b.messages.join(b.conversations, "conversation_id").select(T.message_uri("conversation_id", "node_id", "evidence_hash").alias("uri"))
    uris = cited.join(known, "uri", "left_semi").agg(F.array_sort(F.collect_set("uri")).alias("evidence"))  # a proposal's few citations
    base = b.states.where(F.col("project_id") == project).select("project_id", F.col("version").alias("base_version"))
    return change.crossJoin(base).crossJoin(uris).withColumn("kind", F.lit(kind))  # one row each
