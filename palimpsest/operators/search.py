"""Inverted index and ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.driver import query_tokens


def postings(messages: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(token, key), one row for each distinct token of a message."""
    return messages.select(F.explode(T.tokens(text)).alias("token"), key)


def holding_all(index: DataFrame, query: str, key: str = "key") -> DataFrame | None:
    """Keys of a stored index that hold every token of the query; None if the query has no token.

    Only the query's postings are read; counting them needs one shuffle however
    long a common token's list is, and partial counts shrink it first.
    """
    wanted = query_tokens(query)
    if not wanted:
        return None
    return index.where(F.col("token").isin(wanted)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(key)


def holds_all(text, query: str):
    """Whether a text has every index token of the query, row by row: no posting is built, nothing is shuffled.

    The plain containment tests come first and spare most texts the tokenizer.
    """
    wanted = query_tokens(query)
    low = F.lower(F.coalesce(T.col(text), F.lit("")))
    test = F.lit(True)
    for token in wanted:
        test = test & low.contains(token)
    return test & (F.size(F.array_intersect(T.tokens(text), F.array(*map(F.lit, wanted)))) == len(wanted))


def narrowed(rows: DataFrame, roles=None, project=None, archived=None, active_only=False, source_kind=None, date_from=None, date_to=None, ids=None, title_has=None) -> DataFrame:
    """Message filter; an undated row fails ``date_from`` and passes ``date_to``."""
    if roles:
        rows = rows.where(F.col("role").isin(list(roles)))
    if project is not None:
        rows = rows.where(F.col("project_id") == project)
    if title_has:
        rows = rows.where(F.lower("project_title").contains(title_has.lower()))
    if archived is not None:
        rows = rows.where(F.col("archived") == archived)
    if active_only:
        rows = rows.where("active")
    if source_kind is not None:
        rows = rows.where(F.array_contains("source_kinds", source_kind))
    if ids:
        rows = rows.where(F.col("conversation_id").isin(list(ids)))
    at = F.coalesce("created_at", F.timestamp_millis(F.lit(0).cast("long")))
    if date_from:
        rows = rows.where(at >= F.to_timestamp(F.lit(f"{date_from} 00:00:00")))
    if date_to:
        rows = rows.where(at <= F.to_timestamp(F.lit(f"{date_to} 23:59:59.999")))
    return rows


def counted(messages: DataFrame, *by: str) -> DataFrame:
    """Messages of each conversation, or of each of its roles."""
    return messages.groupBy(*by).agg(F.count("*").alias("messages"))


def conversations(messages: DataFrame, key: str = "conversation_id", turn: str = "turn", limit: int = 200) -> DataFrame:
    """(key, messages, last_turn): conversations with the most turns first."""
    return messages.groupBy(key).agg(F.count("*").alias("messages"), F.max(turn).alias("last_turn")).orderBy(F.desc("last_turn"), key).limit(limit)


def containing(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows whose columns, one after the other, contain the text, whatever its case; an empty one keeps all."""
    return rows.where(F.lower(F.concat_ws("\n", *columns)).contains(needle.strip().lower())) if needle.strip() else rows


def search(messages: DataFrame, query: str, limit: int | None = 100, recency: str | None = None, key: str = "key", text: str = "text", phrase_only: bool = False) -> DataFrame:
    """Messages that hold all tokens of the query, best first; without tokens a substring filter.

    ``phrase_only`` counts a phrase match alone; ``recency`` names a timestamp that adds up to 5 points.
    """
    found = messages.where(holds_all(text, query) if query_tokens(query) else F.lower(text).contains(query.lower().strip()))
    active = F.col("active") if "active" in messages.columns else F.lit(False)
    user = F.col("role") == "user" if "role" in messages.columns else F.lit(False)
    score = T.search_score(text, query, active, user, phrase_only).cast("double")
    if recency:
        score = score + F.least(F.lit(5.0), F.coalesce(F.unix_millis(recency), F.lit(0)) / 1e13)
    found = found.withColumn("score", F.round(score, 6)).where("score IS NOT NULL")
    order = [F.desc("score"), *([F.desc_nulls_last(recency)] if recency else []), F.asc(key)]
    return found.orderBy(*order).limit(limit) if limit else found


def search_objects(objects: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """Content objects (id, title, body, tags, updated_at): 20 for the phrase in the title, 3 a matched token, up to 5 for recency."""
    q, words = query.lower().strip(), query_tokens(query)
    whole = F.lower(F.concat_ws("\n", "title", "body", F.array_join("tags", " ")))
    objects = objects.where(holds_all(whole, query) if words else whole.contains(q))
    points = F.when(F.lower("title").contains(q), 20).otherwise(0) + sum((F.when(whole.contains(w), 3).otherwise(0) for w in words), F.lit(0))
    score = points + F.least(F.lit(5.0), F.coalesce(F.unix_millis("updated_at"), F.lit(0)) / 1e13)
    found = objects.withColumn("score", F.round(score.cast("double"), 6))
    return found.orderBy(F.desc("score"), F.desc_nulls_last("updated_at"), "id").limit(limit) if limit else found
