"""Graph validation and quality counters of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import branch, cut

READABLE = ("user", "user_voice_transcript", "assistant_final", "assistant_voice_transcript")


def issues(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """(conversation_id, code, node_id): missing parents and children, missing current node, empty path."""
    ids = nodes.select("conversation_id", F.col("node_id").alias("other"))
    lost = nodes.where("parent_id IS NOT NULL").join(ids, (nodes.conversation_id == ids.conversation_id) & (nodes.parent_id == ids.other), "left_anti").select("conversation_id", F.lit("MISSING_PARENT").alias("code"), "node_id")
    child = nodes.select("conversation_id", "node_id", F.explode("children").alias("child"))
    orphan = child.join(ids, (child.conversation_id == ids.conversation_id) & (child.child == ids.other), "left_anti").select("conversation_id", F.lit("MISSING_CHILD").alias("code"), "node_id")
    current = heads.where("current_node IS NOT NULL").join(ids, (heads.conversation_id == ids.conversation_id) & (heads.current_node == ids.other), "left_anti").select("conversation_id", F.lit("MISSING_CURRENT_NODE").alias("code"), F.col("current_node").alias("node_id"))
    return lost.union(orphan).union(current)


def report(nodes: DataFrame, heads: DataFrame, verified: bool = True) -> DataFrame:
    """Counters and status (COMPLETE, PARTIAL, FAILED) of every conversation."""
    nodes, heads = cut(nodes), cut(heads)  # parsed from whole texts, and read by each part of the report
    path, trace = branch(nodes, heads)
    active = nodes.join(path, ["conversation_id", "node_id"], "left").withColumn("active", F.col("depth").isNotNull() & F.col("is_message"))
    real = F.col("is_message") & (F.col("message_id").isNotNull() | (F.size("content") > 0))
    unknown = F.size(F.filter("content", lambda p: p["type"] == "unknown"))
    readable = F.exists("content", lambda p: p["type"].isin("image", "file", "citation", "canvas") | (p["type"].isin("text", "code") & (F.trim(p["text"]) != "")))
    a = F.col("active")
    kind = lambda *names: F.count_if(a & F.col("semantic").isin(*names))
    counts = active.groupBy("conversation_id").agg(
        F.count("*").alias("total_nodes"), F.count_if(real).alias("message_nodes"), F.count_if(a).alias("active_messages"), F.count_if(~a & real).alias("branch_nodes"),
        F.sum(unknown).cast("long").alias("unknown_parts"), F.coalesce(F.sum(F.when(a, unknown)), F.lit(0)).cast("long").alias("active_unknown_parts"),
        kind("user", "user_voice_transcript").alias("user_messages"), kind("assistant_final", "assistant_voice_transcript").alias("final_messages"),
        kind("user_voice_transcript").alias("user_voice"), kind("assistant_voice_transcript").alias("assistant_voice"),
        kind("assistant_intermediate").alias("intermediate"), kind("tool_call").alias("tool_calls"), kind("tool_result").alias("tool_results"), kind("reasoning").alias("reasoning"),
        kind("assistant_intermediate", "tool_call", "tool_result", "reasoning", "system", "developer").alias("technical"), kind("unknown").alias("unrecognised"),
        F.count_if(a & F.col("semantic").isin(*READABLE) & readable).alias("renderable"),
        F.min(F.when(a, F.col("created_at"))).alias("first_at"), F.max(F.when(a, F.col("created_at"))).alias("last_at"),
    )
    wrong = issues(nodes, heads).groupBy("conversation_id").agg(F.count("*").alias("graph_issues"), F.count_if(F.col("code") == "MISSING_PARENT").alias("orphan_nodes"))
    out = counts.join(trace, "conversation_id", "left").join(wrong, "conversation_id", "left").fillna({"graph_issues": 0, "orphan_nodes": 0})
    bad = (F.col("graph_issues") > 0) | ~F.coalesce("root_reached", F.lit(False)) | (F.col("renderable") == 0) | (F.col("unrecognised") > 0) | (F.col("active_unknown_parts") > 0)
    return out.withColumn("status", F.when(F.col("active_messages") == 0, "FAILED").when(bad | F.lit(not verified), "PARTIAL").otherwise("COMPLETE"))
