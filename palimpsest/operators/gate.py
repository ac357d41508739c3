"""Policy gate and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T

from .fold import ordered


def decide(rows: DataFrame, project: str, now: str, policy: str = "balanced", target: str = "internal") -> DataFrame:
    """Candidates with ``decision`` (INCLUDE, EXCLUDE, REVIEW), ``reason`` and ``warning``; the first rule that fits decides.

    Needs project_id, scope, status, superseded_by, expires_at (string), sensitivity,
    conflicts (count), bad_evidence (count), evidence (count), source, kind, priority, locked.
    """
    out, broad, external = F.lit(False), F.lit(policy == "broad"), F.lit(target == "external")
    expiry = F.try_to_timestamp(F.col("expires_at"))
    backed = F.col("source") == "approved_project_state"
    urgent = F.lit(policy == "balanced") & (F.col("kind") == "task") & F.col("priority").isin("high", "critical")
    bare = ~backed & (F.col("evidence") == 0)
    rules: list[tuple[Column, str, str]] = [
        ((F.col("project_id") != project) | (F.coalesce("scope", F.lit("")).isin("", project) == out), "EXCLUDE", "CROSS_PROJECT_SCOPE"),
        (F.col("superseded_by").isNotNull() | (F.col("status") == "superseded"), "EXCLUDE", "SUPERSEDED"),
        (F.col("status").isin("reversed", "done", "cancelled"), "EXCLUDE", "INACTIVE_RECORD"),
        (F.col("expires_at").isNotNull() & expiry.isNull(), "REVIEW", "INVALID_EXPIRY"),
        (expiry < F.to_timestamp(F.lit(now)), "EXCLUDE", "EXPIRED"),
        (external & (F.col("sensitivity") == "restricted"), "EXCLUDE", "SENSITIVE_EXTERNAL_TARGET"),
        (external & (F.col("sensitivity") == "internal") & ~broad, "REVIEW", "INTERNAL_MEMORY_EXTERNAL_TARGET"),
        (F.col("conflicts") > 0, "REVIEW", "UNRESOLVED_CONFLICT"),
        (F.col("bad_evidence") > 0, "REVIEW", "INVALID_EVIDENCE_URI"),
        (bare & ~broad & ~urgent, "REVIEW", "MISSING_EVIDENCE"),
        (F.col("locked"), "INCLUDE", "LOCKED_APPROVED_MEMORY"),
        (backed, "INCLUDE", "APPROVED_PROJECT_STATE"),
    ]
    decision, reason = F.lit("INCLUDE"), F.lit("EVIDENCE_VERIFIED")
    for test, verdict, code in reversed(rules):
        test = F.coalesce(test, out)
        decision, reason = F.when(test, verdict).otherwise(decision), F.when(test, code).otherwise(reason)
    warning = (
        F.when(external & (F.col("sensitivity") == "internal") & broad, "INTERNAL_MEMORY_ALLOWED_BY_BROAD_POLICY")
        .when(bare & broad, "MISSING_EVIDENCE_ALLOWED_BY_BROAD_POLICY").when(bare & urgent, "MISSING_EVIDENCE_APPROVED_HIGH_PRIORITY_TASK")
    )
    rows = rows.withColumn("decision", decision).withColumn("reason", reason)
    return rows.withColumn("warning", F.when(F.col("decision") == "INCLUDE", warning))


def budgeted(rows: DataFrame, budget: int, key: str = "project_id", cost: str = "tokens", order: list | None = None) -> DataFrame:
    """Greedy budget with skip: locked rows always go in, others if they still fit; adds ``taken``, ``used`` (after the row) and ``overrun``."""

    def step(used: int, row: dict):
        need = row[cost]
        taken = bool(row["locked"]) or used + need <= budget
        used += need if taken else 0
        return used, (taken, used, max(0, used - budget) if row["locked"] else 0)

    return ordered(rows, key, order or [F.desc("score"), F.desc("updated_at"), "id"], step, int, "taken boolean, used long, overrun long")


def stopped(rows: DataFrame, budget: int, key: str, cost: str, order: list) -> DataFrame:
    """Greedy budget that ends at the first row that does not fit; adds ``taken`` and ``used``."""

    def step(state, row):
        used, open_ = state
        taken = open_ and used + row[cost] <= budget
        used += row[cost] if taken else 0
        return (used, taken), (taken, used)

    return ordered(rows, key, order, step, lambda: (0, True), "taken boolean, used long")


def candidates(states: DataFrame) -> DataFrame:
    """Gate candidates of approved project states (project_id, title, version, updated_at, status, decisions, tasks)."""
    base = ["project_id", "updated_at"]
    blank = {"superseded_by": None, "expires_at": None}

    def shape(df, id_, kind, title, text, priority, importance, locked, source, status=F.lit("active"), evidence=F.lit(1)):
        cols = {"id": id_, "kind": F.lit(kind), "title": title, "text": text, "priority": priority, "importance": importance, "locked": locked, "source": F.lit(source), "status": status, "evidence": evidence.cast("int")}
        return df.select(*base, *(v.alias(k) for k, v in cols.items()), F.col("project_id").alias("scope"), F.lit("internal").alias("sensitivity"), *(F.lit(v).cast("string").alias(k) for k, v in blank.items()), F.lit(0).alias("conflicts"), F.lit(0).alias("bad_evidence"))

    status = shape(states, F.concat(F.lit("state:"), "project_id", F.lit(":status")), "project_status", F.lit("Approved status"), F.concat_ws("; ", "status.phase", "status.health", "status.summary"), F.lit("medium"), F.lit(100), F.lit(True), "approved_project_state")

    def listed(field: str, kind: str, priority: str, importance: int, locked: bool):
        each = states.select(*base, F.posexplode(f"status.{field}").alias("k", "item"))
        return shape(each, F.concat(F.lit("state:"), "project_id", F.lit(f":{kind}:"), (F.col("k") + 1).cast("string")), kind, F.lit(kind), F.col("item"), F.lit(priority), F.lit(importance), F.lit(locked), "approved_project_state")

    decision = states.select(*base, F.explode("decisions").alias("d"))
    decision = shape(decision, F.concat(F.lit("decision:"), "d.id"), "decision", F.col("d.title"), F.col("d.summary"), F.lit("high"), F.lit(90), F.lit(False), "approved_record", F.col("d.status"), F.size("d.evidence"))
    task = states.select(*base, F.explode("tasks").alias("t"))
    weight = F.when(F.col("t.priority") == "critical", 95).when(F.col("t.priority") == "high", 85).otherwise(70)
    task = shape(task, F.concat(F.lit("task:"), "t.id"), "task", F.col("t.title"), F.col("t.notes"), F.col("t.priority"), weight, F.lit(False), "approved_record", F.col("t.status"), F.size("t.evidence"))
    out = status.union(listed("blockers", "blocker", "critical", 100, True)).union(listed("nextActions", "next_action", "high", 80, False)).union(decision).union(task)
    return out.withColumn("score", T.priority("kind", "priority", "importance", "locked")).withColumn("tokens", T.estimate("text"))


def evaluate(rows: DataFrame, project: str, now: str, budget: int = 2048, policy: str = "balanced", target: str = "internal") -> DataFrame:
    """The whole gate: rules, then the budget over what they include."""
    judged = decide(rows, project, now, policy, target)
    packed = budgeted(judged.where("decision = 'INCLUDE'"), max(128, budget))
    kept = packed.withColumn("decision", F.when(F.col("taken"), "INCLUDE").otherwise("EXCLUDE")).withColumn("reason", F.when(F.col("taken"), F.col("reason")).otherwise("TOKEN_BUDGET"))
    return kept.drop("taken", "used", "overrun").unionByName(judged.where("decision <> 'INCLUDE'"))
