"""Captured conversations: visible snapshots, candidate scores, confidence, source choice, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import trimmed


def linear(messages: DataFrame, key: str = "conversation_id", order: str = "position") -> DataFrame:
    """Nodes of visible messages (role, text): a chain without branches; empty texts are left out, unknown roles follow parity."""
    rows = messages.where(trimmed(F.coalesce("text", F.lit(""))) != "")
    w = Window.partitionBy(key).orderBy(order)
    name = lambda n: F.when(n > 0, F.concat(F.lit("visible-"), F.lpad(n.cast("string"), 4, "0")))
    n = F.row_number().over(w)
    role = F.when(F.col("role").isin("user", "assistant", "system", "tool"), F.col("role")).otherwise(F.when(n % 2 == 1, "user").otherwise("assistant"))
    rows = rows.select(key, "text", n.alias("n"), role.alias("role"), F.lead(order).over(w).isNotNull().alias("more"))
    return rows.select(key, name(F.col("n")).alias("node_id"), name(F.col("n") - 1).alias("parent_id"), F.when(F.col("more"), name(F.col("n") + 1)).alias("child_id"), "role", trimmed("text").alias("text"))


def score(c: dict[str, Column]) -> Column:
    """Points of a capture candidate.  Fixed values: the weights of its properties."""
    return (
        F.when(c["viable"], 1_000_000).otherwise(0) + F.when(c["exact_id"], 200_000).otherwise(-1_000_000) + F.when(c["direct"], 100_000).otherwise(0)
        + F.when(c["root_reached"], 50_000).otherwise(0) - c["parent_breaks"] * 25_000 - F.when(c["cycle"], 50_000).otherwise(0)
        + c["active_messages"] * 1_000 + c["message_nodes"] * 10 + c["user_messages"] + c["assistant_messages"]
    ).cast("long")


def best(candidates: DataFrame, key: str, points: str) -> DataFrame:
    """The best candidate of each conversation."""
    return candidates.groupBy(key).agg(F.max_by(F.struct(*candidates.columns), F.struct(points, F.xxhash64(*candidates.columns))).alias("c")).select("c.*")


def doubts(c: dict[str, Column], small: int = 12) -> Column:
    """Reasons against trusting a structured capture; none means it is confident."""
    top = F.coalesce(c["max_turn"], F.lit(0))
    broken = ~c["viable"] | ~c["exact_id"] | ~c["root_reached"] | (c["parent_breaks"] > 0) | c["cycle"]
    tests = [
        (~c["viable"], "NOT_VIABLE"), (~c["exact_id"], "CONVERSATION_ID_MISMATCH"), (~c["root_reached"], "ROOT_NOT_REACHED"), (c["parent_breaks"] > 0, "PARENT_BREAK"), (c["cycle"], "PARENT_CYCLE"),
        (c["active_messages"] < c["visible"], "FEWER_THAN_VISIBLE_MESSAGES"), ((top > 0) & (c["active_messages"] < top), "BELOW_PAGE_TURN_LOWER_BOUND"),
        (c["leaf_mismatch"], "CURRENT_LEAF_MISMATCH"), (~broken & (c["active_messages"] <= small), "SMALL_BRANCH_REQUIRES_CORROBORATION"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), name) for t, name in tests)))


def corroborated(c: dict[str, Column], complete: Column, seen: Column) -> Column:
    """Whether a complete scroll through the page backs the structured capture."""
    top = F.coalesce(c["max_turn"], F.lit(0))
    sound = c["viable"] & c["exact_id"] & c["root_reached"] & (c["parent_breaks"] == 0) & ~c["cycle"]
    return sound & complete & (c["active_messages"] >= seen) & ((top <= 0) | (c["active_messages"] >= top))


def source(api: Column, confident: Column, backed: Column, debugger: Column, page: Column) -> Column:
    """Which capture to take: a confident or backed structured one, else the page; without one the debugger's, then the page."""
    return F.when(api & (confident | backed), "api").when(api & page, "page").when(api, "api").when(debugger, "debugger").when(page, "page").otherwise("none")


def timeline(items: DataFrame, status: str = "all", kind: str = "all", project: str = "all", query: str = "") -> DataFrame:
    """Items newest first; ``unbound`` asks for those without a project."""
    if status != "all":
        items = items.where(F.col("status") == status)
    if kind != "all":
        items = items.where(F.col("kind") == kind)
    if project == "unbound":
        items = items.where("project_id IS NULL OR project_id = ''")
    elif project != "all":
        items = items.where(F.col("project_id") == project)
    if query.strip():
        items = items.where(F.lower(F.concat_ws("\n", "title", "body", F.array_join("tags", " "), F.coalesce("project_title", F.lit("")))).contains(query.strip().lower()))
    return items.orderBy(F.desc("updated_at"), "id")


def recovery(message: Column) -> Column:
    """What to do about an error.  Fixed values: the patterns of messages."""
    return (
        F.when(message.rlike("401|403|登录|session|认证|授权"), "refresh-session").when(message.rlike("(?i)工作空间|workspace|account"), "choose-workspace")
        .when(message.rlike("下载|写入|interrupted"), "show-downloads").otherwise("retry")
    )


def quality(blockers: Column, warnings: Column) -> Column:
    return F.when(blockers > 0, "danger").when(warnings > 0, "warning").otherwise("good")
