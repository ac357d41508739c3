"""Providers, locations, assets and links of captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def provider(url: Column | str, suffixes: dict[str, str]) -> Column:
    """The provider whose domain is the host or ends it; the longest domain wins."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    out = F.lit(None).cast("string")
    for domain, name in sorted(suffixes.items(), key=lambda x: len(x[0])):
        out = F.when((host == domain) | host.endswith("." + domain), name).otherwise(out)
    return out


def present(locations: Column) -> Column:
    """No location at all, or one that is not marked absent."""
    return (F.size(locations) <= 0) | F.exists(locations, lambda x: F.coalesce(x["present"], F.lit(True)))


def primary(locations: Column, ranks: list[str]) -> Column:
    """The location whose type stands first in ``ranks``; among equals the first."""
    rank = lambda t: F.coalesce(F.array_position(F.array(*map(F.lit, ranks)), t), F.lit(0))
    keyed = F.transform(locations, lambda x, i: F.struct(F.when(rank(x["type"]) == 0, len(ranks) + 1).otherwise(rank(x["type"])).alias("r"), i.alias("i"), x.alias("x")))
    return F.try_element_at(F.array_sort(keyed), F.lit(1))["x"]


def title(first_user: Column | str, *names: Column | str, fallback: Column | None = None) -> Column:
    """The first name that says something, else the first sentence of the first user message, else the fallback."""
    empty = r"(?i)^(|untitled.*|new chat|conversation)$"
    useful = [F.when(~F.trim(n).rlike(empty), F.trim(n)) for n in (F.col(n) if isinstance(n, str) else n for n in names)]
    sentence = F.nullif(F.trim(F.substring(F.regexp_extract(F.col(first_user) if isinstance(first_user, str) else first_user, r"^\s*([^.!?\n]+)", 1), 1, 60)), F.lit(""))
    return F.coalesce(*useful, sentence, fallback if fallback is not None else F.lit("untitled"))


def file_ids(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(file[-_][A-Za-z0-9]+)"), F.lit(1)))


def asset_kind(name: Column | str, mime: Column | str) -> Column:
    n, m = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(m.startswith("image/") | n.rlike(r"\.(png|jpe?g|gif|webp|svg)$"), "image").when(m.startswith("audio/") | n.rlike(r"\.(mp3|wav|ogg|m4a)$"), "audio")
        .when(m.startswith("video/") | n.rlike(r"\.(mp4|mov|webm)$"), "video").when((m == "application/pdf") | n.rlike(r"\.pdf$"), "document")
        .when(n.rlike(r"\.(zip|tar|gz|7z)$"), "archive").otherwise("file")
    )


def assets(refs: DataFrame) -> DataFrame:
    """One row an asset of references (key, name, name_score, downloadable, conversation): OR, best name, all conversations."""
    return refs.groupBy("key").agg(F.bool_or("downloadable").alias("downloadable"), F.max_by("name", F.struct("name_score", "name")).alias("name"), F.count_distinct("conversation").alias("conversations"))


def asset_states(inventory: DataFrame, saved: DataFrame, failed: DataFrame) -> DataFrame:
    """(key, state): saved, failed, unsupported or missing."""
    s, f = saved.select("key", F.lit(1).alias("s")).distinct(), failed.select("key", F.lit(1).alias("f")).distinct()
    state = F.when(F.col("s").isNotNull(), "saved").when(F.col("f").isNotNull(), "failed").when(~F.col("downloadable"), "unsupported").otherwise("missing")
    return inventory.join(s, "key", "left").join(f, "key", "left").select("key", state.alias("state"))


def matched_assets(assets_: DataFrame, project: DataFrame, conversations: DataFrame) -> DataFrame:
    """Assets of a project, by its id or through one of its conversations: a union of two semi-joins instead of an OR join."""
    one = assets_.join(project, "project_id", "left_semi").select("key")
    two = assets_.select("key", F.explode("conversations").alias("conversation_id")).join(conversations, "conversation_id", "left_semi").select("key")
    return one.union(two).distinct()


# Fields of a stored asset that may be kept.
ASSET_FIELDS = ("key", "job_id", "asset_key", "file_id", "file_name", "mime_type", "size_bytes", "expected_bytes", "sha256", "archive_path", "bytes", "references", "diagnostics", "downloaded_at", "object_key")


def stored_assets(rows: DataFrame) -> DataFrame:
    """Asset records with the allowed fields only; of diagnostics (signing_endpoint, signing_attempts, binary_status, download_host) clamped parts without tokens and addresses.

    At most ten attempts are kept, as surveyed; a null record of diagnostics stays null.
    """
    kept = rows.select(*(c for c in rows.columns if c in ASSET_FIELDS))
    if "diagnostics" not in kept.columns:
        return kept
    message = lambda x: F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?i)Bearer\s+\S+", "Bearer <redacted>"), r"(?i)https?://[^\s\"'<>]+", "<redacted-url>"), 1, 240)
    d = F.col("diagnostics")
    attempt = lambda a: F.struct(
        F.coalesce(F.substring(a["label"], 1, 80), F.lit("unknown")).alias("label"), F.when(a["result"] == "success", "success").otherwise("failed").alias("result"), a["status"].try_cast("double").alias("status"), message(a["message"]).alias("message"),
    )
    clean = F.struct(
        F.substring(d["signing_endpoint"], 1, 80).alias("signing_endpoint"), F.transform(F.slice(F.coalesce(d["signing_attempts"], F.array()), 1, 10), attempt).alias("signing_attempts"),
        d["binary_status"].try_cast("double").alias("binary_status"), F.substring(F.regexp_replace(d["download_host"], r"(?i)[^a-z0-9.:-]", ""), 1, 160).alias("download_host"),
    )
    return kept.withColumn("diagnostics", F.when(d.isNotNull(), clean))
