"""Reviewed changes: approvals, rejections, rollbacks, memories, gate configurations and run receipts.

Tables are append-only and one writer applies a batch.  Compare-and-set is an
assertion within the batch: a change names the version and hash it was made on and
is refused where the current ones differ.  Of several changes of one project in
a batch the oldest is applied; the others find a newer version and are refused.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import clean, safe_id

from .selection import clamp, mapped

POLICIES, TARGETS = ("safe", "balanced", "broad"), ("internal", "external")


def optional(x: Column | str, limit: int) -> Column:
    return F.nullif(clean(x, limit), F.lit(""))


def states(rows: DataFrame) -> DataFrame:
    """Project states with clamped fields; a state without a project id is left out.

    supersessions is an array of (id, record_type, target_id, reason).
    """
    item = lambda x, i: F.struct(
        safe_id(F.coalesce(F.nullif(x["id"], F.lit("")), F.concat(F.lit("supersession-"), (i + 1).cast("string")))).alias("id"),
        F.when(x["record_type"] == "task", "task").otherwise("decision").alias("record_type"), clean(x["target_id"], 200).alias("target_id"), clean(x["reason"], 20_000).alias("reason"),
    )
    project = clean("project_id", 300)
    return rows.where(project != "").select(
        project.alias("project_id"), F.coalesce(optional("title", 500), project).alias("title"), F.greatest(F.lit(0), F.coalesce(F.floor("version"), F.lit(0))).cast("long").alias("version"),
        optional("hash", 200).alias("hash"), F.transform(F.coalesce("supersessions", F.array().cast("array<struct<id:string,record_type:string,target_id:string,reason:string>>")), item).alias("supersessions"),
    )


def stable_digest(rows: DataFrame, column: str, without: tuple[str, ...] = ()) -> DataFrame:
    """The JSON in ``column`` replaced by SHA-256 of its stable form: keys sorted, those in ``without`` left out at every level."""

    def kept(value):
        if isinstance(value, list):
            return [kept(v) for v in value]
        if isinstance(value, dict):
            return {k: kept(v) for k, v in value.items() if k not in without}
        return value

    return mapped(rows, column, lambda v: hashlib.sha256(json.dumps(kept(v), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest())


def touched(kind: Column, record: Column, record_type: Column, target: Column, replacement: Column) -> Column:
    """Keys that a proposal changes: the status, its record, or a superseded record and what replaces it."""
    pair = F.array_compact(F.array(F.concat_ws(":", record_type, target), F.when(replacement.isNotNull(), F.concat_ws(":", record_type, replacement))))
    return F.when(kind == "project_status", F.array(F.lit("status"))).when(kind.isin("decision", "task"), F.array(F.concat_ws(":", kind, record))).otherwise(pair)


def approvals(proposals: DataFrame, current: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """(id, project_id, outcome, from_version, to_version) of an approval of every proposal.

    proposals: id, project_id, status, base_version, base_hash (of the state that the review saw), created_at;
    current: project_id, version, hash; conflicts: ids of proposals whose touched keys changed since they were made.
    A project without a state is at version 0 with no hash.
    """
    now = current.select("project_id", F.col("version").alias("v"), F.col("hash").alias("h"))
    rows = proposals.join(now, "project_id", "left").withColumn("from_version", F.coalesce("v", F.lit(0)).cast("long"))
    rows = rows.join(conflicts.select("id", F.lit(True).alias("clash")).distinct(), "id", "left").withColumn("clash", F.coalesce("clash", F.lit(False))) if conflicts is not None else rows.withColumn("clash", F.lit(False))
    fits = (F.col("base_version") == F.col("from_version")) & F.col("base_hash").eqNullSafe(F.col("h"))
    rows = rows.withColumn("outcome", F.when(F.col("status").isin("approved", "rejected"), F.concat(F.lit("refused:already_"), "status")).when(F.col("clash"), "refused:conflict").when(~fits, "refused:state_changed").otherwise("approved"))
    first = F.row_number().over(Window.partitionBy("project_id", "outcome").orderBy("created_at", "id"))
    rows = rows.withColumn("outcome", F.when((F.col("outcome") == "approved") & (first > 1), "refused:state_changed").otherwise(F.col("outcome")))
    return rows.select("id", "project_id", "outcome", "from_version", F.when(F.col("outcome") == "approved", F.col("from_version") + 1).alias("to_version"))


def approval_rows(approved: DataFrame) -> DataFrame:
    """Version rows of ``approvals``: (project_id, version, action, proposal_id); a project's first approval writes its initial version as well."""
    good = approved.where("outcome = 'approved'")
    initial = good.where("from_version = 0").select("project_id", F.lit(0).cast("long").alias("version"), F.lit("initial").alias("action"), F.lit(None).cast("string").alias("proposal_id"))
    return initial.union(good.select("project_id", F.col("to_version"), F.lit("approved"), F.col("id").cast("string")))


def rejections(proposals: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, status, event) after a rejection of ``ids``: approved ones are refused, rejected ones stay without a second event, unknown ids are not found."""
    rows = ids.select("id").distinct().join(proposals.select("id", "status"), "id", "left")
    status = F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "approved", "approved").otherwise("rejected")
    event = F.when(F.col("status").isNull() | F.col("status").isin("approved", "rejected"), F.lit(None)).otherwise("proposal_rejected")
    return rows.select("id", status.alias("status"), event.alias("event"))


def rollbacks(targets: DataFrame, current: DataFrame, versions: DataFrame) -> DataFrame:
    """(project_id, outcome, version, restored_from, hash): a rollback writes the target's content as a new version.

    targets: project_id, target; current: project_id, version; versions: project_id, version, hash.
    """
    have = versions.select("project_id", F.col("version").alias("target"), F.col("hash"), F.lit(True).alias("there"))
    rows = targets.join(current.select("project_id", "version"), "project_id", "left").join(have, ["project_id", "target"], "left")
    outcome = F.when(F.col("there").isNull(), "refused:version_not_found").when(F.col("target") == F.col("version"), "refused:already_current").otherwise("restored")
    good = outcome == "restored"
    return rows.select("project_id", outcome.alias("outcome"), F.when(good, F.col("version") + 1).alias("version"), F.when(good, F.col("target")).alias("restored_from"), F.when(good, F.col("hash")).alias("hash"))


def memory_approvals(candidates: DataFrame, profiles: DataFrame, current: DataFrame) -> DataFrame:
    """(project_id, outcome, version): an equal hash changes nothing, a state that moved on refuses, else the version rises by one.

    candidates: project_id, hash, state_version, state_hash; profiles: project_id, version, hash; current: project_id, version, hash.
    """
    old = profiles.select("project_id", F.col("version").alias("pv"), F.col("hash").alias("ph"))
    now = current.select("project_id", F.col("version").alias("sv"), F.col("hash").alias("sh"))
    rows = candidates.join(old, "project_id", "left").join(now, "project_id", "left")
    moved = (F.coalesce("sv", F.lit(0)) != F.coalesce("state_version", F.lit(0))) | ~F.col("sh").eqNullSafe(F.col("state_hash"))
    outcome = F.when(F.col("hash") == F.col("ph"), "unchanged").when(moved, "refused:state_changed").otherwise("approved")
    return rows.select("project_id", outcome.alias("outcome"), (F.coalesce("pv", F.lit(0)) + F.when(outcome == "approved", 1).otherwise(0)).cast("long").alias("version"))


def configurations(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(project_id, version, policy, target, token_budget, hash) of saved gate configurations: known values or the defaults, versions in a row."""
    last = existing.groupBy("project_id").agg(F.max("version").alias("last"))
    rows = incoming.join(last, "project_id", "left").select(
        "project_id", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("version"), F.when(F.col("policy").isin(*POLICIES), F.col("policy")).otherwise("balanced").alias("policy"),
        F.when(F.col("target").isin(*TARGETS), F.col("target")).otherwise("internal").alias("target"), clamp(F.col("token_budget").cast("string"), 128, 1 << 31, 2048).alias("token_budget"),
    )
    return rows.withColumn("hash", F.sha2(F.concat_ws("\n", *(F.col(c).cast("string") for c in rows.columns)), 256))


def receipts(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming receipts with ``outcome``: added, or refused where the id exists already or comes twice (the first by ``created_at`` stays)."""
    have = existing.select(key, F.lit(True).alias("there")).distinct()
    first = F.row_number().over(Window.partitionBy(key).orderBy("created_at"))
    rows = incoming.withColumn("nth", first).join(have, key, "left")
    return rows.withColumn("outcome", F.when(F.col("there") | (F.col("nth") > 1), "refused:exists").otherwise("added")).drop("there", "nth")


def restored_configuration(runs: DataFrame, existing: DataFrame) -> DataFrame:
    """The configurations that runs (id, project_id, policy, target, token_budget) used, saved again as new versions, with the run they come from."""
    saved = configurations(runs.select("project_id", "policy", "target", "token_budget"), existing)
    return saved.join(runs.select("project_id", F.col("id").alias("from_run")), "project_id")


def versions_of(rows: DataFrame, column: str, value: str) -> DataFrame:
    """The versions of one project or object, newest first."""
    return rows.where(F.col(column) == value).orderBy(F.desc("version"))


def found_state(rows: DataFrame, wanted: str) -> DataFrame:
    """The state with that project id, else the first by id whose title holds the text, whatever its case."""
    title = F.lower(F.regexp_replace(F.trim("title"), r"\s+", " ")).contains(" ".join(wanted.lower().split()))
    return rows.where((F.col("project_id") == wanted) | title).orderBy(F.desc(F.col("project_id") == wanted), "project_id").limit(1)


def manifest(report: DataFrame) -> DataFrame:
    """(project_id, included, excluded, review, used_tokens): the manifest of gate reports (project_id, decision, tokens)."""
    count = lambda name: F.count_if(F.col("decision") == name)
    return report.groupBy("project_id").agg(count("INCLUDE").alias("included"), count("EXCLUDE").alias("excluded"), count("REVIEW").alias("review"), F.coalesce(F.sum(F.when(F.col("decision") == "INCLUDE", F.col("tokens"))), F.lit(0)).cast("long").alias("used_tokens"))


def gate_markdown(report: DataFrame, budget: int, limit: int = 10_000) -> DataFrame:
    """(project_id, markdown) of gate reports (project_id, id, title, text, decision, reason, tokens).

    A report lists what one token budget holds and what it left out; ``limit``
    refuses, by an error, projects whose report has more rows than a reader's text takes.
    """
    row = F.struct("id", F.when(F.col("decision") == "INCLUDE", F.concat(F.lit("### "), F.coalesce(F.nullif("title", F.lit("")), F.col("id").cast("string")), F.lit("\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.concat(F.lit("- "), F.col("id").cast("string"), F.lit(": "), "reason")).alias("line"))
    part = lambda name: F.array_sort(F.collect_list(F.when(F.col("decision") == name, row)))
    rows = report.groupBy("project_id").agg(F.count("*").alias("n"), part("INCLUDE").alias("i"), part("REVIEW").alias("r"), part("EXCLUDE").alias("e"), F.coalesce(F.sum(F.when(F.col("decision") == "INCLUDE", F.col("tokens"))), F.lit(0)).cast("string").alias("used"))
    rows = rows.where(F.when(F.col("n") > limit, F.raise_error(F.lit("a gate report with too many rows"))).otherwise(F.lit(True)))
    lines = lambda c, gap: F.when(F.size(c) == 0, "- None").otherwise(F.array_join(F.transform(c, lambda x: x["line"]), gap))
    text = F.concat(F.lit("# "), "project_id", F.lit(f"\n\n- Token budget: {budget}\n- Used: "), "used", F.lit("\n\n## Included\n\n"), lines("i", "\n\n"), F.lit("\n\n## Review\n\n"), lines("r", "\n"), F.lit("\n\n## Excluded\n\n"), lines("e", "\n"), F.lit("\n"))
    return rows.select("project_id", text.alias("markdown"))
