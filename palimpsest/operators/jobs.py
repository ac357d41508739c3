"""Collection jobs as tables: migration, reconciliation, snapshots, runs, profiles, caches and guidance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import safe_filename, slug, tags, trimmed

from .selection import clamp

VERSION = 3
# Default, least and greatest numbers of a schedule, and its default time.
SCHEDULE = {"interval_days": (3, 1, 365), "idle_seconds": (120, 30, 3600), "max_asset_bytes": (8 << 20, 1 << 20, 64 << 20), "max_snapshots": (30, 1, 365), "max_age_days": (180, 1, 3650)}
TIME = "03:30"


def migrated(jobs: DataFrame) -> DataFrame:
    """Jobs of any version at the present one, with ``warning``; a job of no known version is left out.

    Version 1 (or none, but with a pagination) indexes its regular source again unless
    its index is complete; version 2 gets an empty asset state; both lose nothing saved.
    """
    v = F.when(F.col("version").isNull() & F.col("pagination_complete").isNotNull(), 1).otherwise(F.col("version"))
    first = v == 1
    return jobs.withColumn("v", v).where("v IN (1, 2, 3)").select(
        "id", F.lit(VERSION).alias("version"), F.when(F.col("scope") == "selected", "selected").otherwise("all").alias("scope"), F.when(first, "indexing").otherwise(F.col("status")).alias("status"),
        F.when(first, F.when(F.coalesce("pagination_complete", F.lit(False)), "complete").otherwise("pending")).otherwise(F.col("regular_status")).alias("regular_status"),
        F.array_distinct(F.coalesce("completed_ids", F.array().cast("array<bigint>"))).alias("completed_ids"), F.when(F.col("v") < 3, F.concat(F.lit("migrated from version "), F.col("v").cast("string"))).alias("warning"),
    )


def reconciled(listed: DataFrame, artifacts: DataFrame, versions: DataFrame) -> DataFrame:
    """(job_id, id, version) that are durably done: listed conversations with a stored artifact, at their noted version, else the listed one.

    listed: job_id, id, version; artifacts: job_id, id; versions: job_id, id, version.
    """
    done = listed.join(artifacts.select("job_id", "id").distinct(), ["job_id", "id"], "left_semi")
    noted = versions.select("job_id", "id", F.col("version").alias("noted"))
    return done.join(noted, ["job_id", "id"], "left").select("job_id", "id", F.coalesce("noted", "version").alias("version"))


def resumed(plans: DataFrame, runs: DataFrame, volumes: DataFrame) -> DataFrame:
    """Volumes still to write: (plan_id, volume) without those that a run of the same plan and graph has completed.

    plans: plan_id, graph_hash, volumes (count); runs: run_id, plan_id, graph_hash; volumes: run_id, volume.
    """
    same = runs.join(plans.select("plan_id", "graph_hash"), ["plan_id", "graph_hash"], "left_semi")
    done = same.join(volumes, "run_id").select("plan_id", "volume").distinct()
    every = plans.where("volumes > 0").select("plan_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("volumes").cast("long"))).alias("volume"))
    return every.join(done, ["plan_id", "volume"], "left_anti")


def to_run(selected: DataFrame, progress: DataFrame, marks: DataFrame, most: int = 2) -> DataFrame:
    """What a selected export still fetches: (job_id, id, attempt); a job whose selection changed since is refused by its mark.

    selected: job_id, id, mark; progress: job_id, id, done, attempts; marks: job_id, mark (of the job's own selection).
    """
    same = selected.join(marks, ["job_id", "mark"], "left_semi")
    rows = same.join(progress, ["job_id", "id"], "left")
    tries = F.coalesce("attempts", F.lit(0))
    return rows.where(~F.coalesce("done", F.lit(False)) & (tries < most)).select("job_id", "id", (tries + 1).cast("long").alias("attempt"))


def finalised(jobs: DataFrame) -> DataFrame:
    """(id, status, asset_status) of jobs that keep references only: complete, with errors where failures are left."""
    return jobs.select("id", F.when(F.coalesce("failures", F.lit(0)) > 0, "completed_with_errors").otherwise("completed").alias("status"), F.lit("inventory_only").alias("asset_status"))


def export_counters(listed: DataFrame, artifacts: DataFrame, failures: DataFrame, selected: DataFrame) -> DataFrame:
    """(job_id, selected_total, saved, remaining, failed, partial, regular, archived) of what may be exported so far.

    listed: job_id, id, archived; artifacts: job_id, id; failures: job_id, id; selected: job_id, total.
    """
    have = artifacts.select("job_id", "id", F.lit(True).alias("saved")).distinct()
    bad = failures.select("job_id", "id", F.lit(True).alias("bad")).distinct()
    rows = listed.join(have, ["job_id", "id"], "left").join(bad, ["job_id", "id"], "left")
    saved = F.col("saved").isNotNull()
    out = rows.groupBy("job_id").agg(
        F.count("*").alias("listed"), F.count_if(saved).alias("saved"), F.count_if(F.col("bad").isNotNull() & ~saved).alias("failed"),
        F.count_if(saved & ~F.col("archived")).alias("regular"), F.count_if(saved & F.col("archived")).alias("archived"),
    )
    total = F.coalesce("total", "listed").cast("long")
    left = F.greatest(F.lit(0), total - F.col("saved")).cast("long")
    return out.where("saved > 0").join(selected, "job_id", "left").select("job_id", total.alias("selected_total"), "saved", left.alias("remaining"), "failed", (left > 0).alias("partial"), "regular", "archived")


def cached(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...], at: str) -> DataFrame:
    """A keyed cache after a put: one row a key, the latest by ``at``; ties go to the incoming row."""
    rows = existing.withColumn("new", F.lit(0)).unionByName(incoming.withColumn("new", F.lit(1)))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*existing.columns), F.struct(at, "new")).alias("b"))
    return best.select("b.*")


def newest(rows: DataFrame, at: str, key: str, limit: int | None = None) -> DataFrame:
    """A listing, newest first, of at most ``limit`` rows where one is given."""
    rows = rows.orderBy(F.desc_nulls_last(at), key)
    return rows.limit(limit) if limit else rows


def cleared(tables: dict[str, DataFrame], job: str | int) -> dict[str, DataFrame]:
    """Jobs, artifacts, assets or whatever has a job_id, without those of one job."""
    return {name: df.where(~F.col("job_id").eqNullSafe(F.lit(job))) for name, df in tables.items()}


def cleared_index(tables: dict[str, DataFrame], index: tuple[str, ...] = ("imports", "conversations", "messages", "postings")) -> dict[str, DataFrame]:
    """All tables, those of the index empty; evidence, states, memories and captures stay as they are."""
    return {name: df.limit(0) if name in index else df for name, df in tables.items()}


def latest_run(runs: DataFrame, key: str = "project_id", at: str = "updated_at") -> DataFrame:
    """The last run of each project."""
    return runs.groupBy(key).agg(F.max_by(F.struct(*(c for c in runs.columns if c != key)), F.struct(F.col(at), *(c for c in runs.columns if c not in (key, at)))).alias("r")).select(key, "r.*")


def replaced(existing: DataFrame, incoming: DataFrame, key: str = "project_id") -> DataFrame:
    """``existing`` with all rows of the incoming projects replaced, as a partition overwrite does."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def appended(log: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """An append-only log after an append; ids that it has are not written again."""
    return log.unionByName(rows.dropDuplicates([key]).join(log.select(key), key, "left_anti"))


def schedule(rows: DataFrame) -> DataFrame:
    """Schedule settings (all strings or null) with bounds and defaults; hours and minutes beyond a day's are taken as its last."""
    numbers = [clamp(F.col(name), low, high, default).alias(name) for name, (default, low, high) in SCHEDULE.items()]
    number = lambda k, most: F.lpad(F.least(F.regexp_extract("local_time", r"^(\d{1,2}):(\d{2})$", k).try_cast("int"), F.lit(most)).cast("string"), 2, "0")
    hour = F.when(F.col("local_time").rlike(r"^\d{1,2}:\d{2}$"), F.concat(number(1, 23), F.lit(":"), number(2, 59))).otherwise(TIME)
    policy = F.when(F.col("asset_policy").isin("references-only", "download"), F.col("asset_policy")).otherwise("references-only")
    return rows.select("id", F.coalesce(F.col("enabled"), F.lit(False)).alias("enabled"), hour.alias("local_time"), policy.alias("asset_policy"), *numbers)


def archive_path(file_id: Column, key: Column, name: Column) -> Column:
    """assets/<id>_<name> of safe names; an asset without a file id takes its key."""
    own = F.coalesce(F.nullif(file_id, F.lit("")), F.regexp_replace(key, "(?i)[^a-z0-9_-]+", "-"))
    return F.concat(F.lit("assets/"), safe_filename(own, fallback="asset"), F.lit("_"), safe_filename(F.coalesce(F.nullif(name, F.lit("")), F.lit("attachment"))))


def rough_size(raw: Column) -> Column:
    """About how many bytes a record takes: those of its JSON."""
    return F.coalesce(F.octet_length(raw), F.lit(0)).cast("long")


def undo(status: Column) -> Column:
    """What an undo of a capture's state does.  Fixed values: its names."""
    return F.when(status == "archived", "archive").when(status == "trashed", "trash").otherwise("none")


def relation_ends(selected: Column, source: Column, target: Column) -> Column:
    """struct(ready, from_id, to_id) of a relation between selected ids (an array): the ends asked for where they are selected, else the first ids that differ."""
    ids = F.array_distinct(F.filter(selected, lambda x: x.isNotNull() & (x != "")))
    asked = lambda x, k: F.when(F.array_contains(ids, x), x).otherwise(F.get(ids, F.lit(k)))
    one = asked(F.coalesce(source, F.lit("")), 0)
    two = asked(F.coalesce(target, F.lit("")), 1)
    other = F.when(two == one, F.get(F.filter(ids, lambda x: x != one), F.lit(0))).otherwise(two)
    few = F.size(ids) < 2
    return F.struct((~few).alias("ready"), F.coalesce(F.when(few, F.get(ids, F.lit(0))).otherwise(one), F.lit("")).alias("from_id"), F.when(few, "").otherwise(other).alias("to_id"))


def preflight(rows: DataFrame) -> DataFrame:
    """(id, conversations, free_bytes, resume) before a backup: known totals, else what the job lists, else what it saved; null if nothing is known."""
    known = F.coalesce("regular_total", F.lit(0)) + F.coalesce("archived_total", F.lit(0))
    number = F.coalesce(*(F.nullif(F.coalesce(x, F.lit(0)), F.lit(0)) for x in (known, F.col("listed"), F.col("saved")))).cast("long")
    free = F.when(F.coalesce("quota", F.lit(0)) > 0, F.greatest(F.lit(0), F.col("quota") - F.coalesce("usage", F.lit(0)))).cast("long")
    going = F.col("status").isNotNull() & ~F.col("status").isin("completed", "completed_with_errors")
    return rows.select("id", number.alias("conversations"), free.alias("free_bytes"), going.alias("resume"))


def guidance(on_page: Column, library: Column, status: Column, saved: Column, volumes: Column, written: Column) -> Column:
    """What to do next: the first of six states that fits.  Fixed values: the states' names."""
    complete = F.coalesce(status.isin("completed", "completed_with_errors"), F.lit(False))
    return (
        F.when(~on_page, "needs-chat").when(status.isNotNull() & ~complete, "resume-backup").when(complete & (volumes > written), "finish-computer-backup")
        .when(complete & (library == 0) & (saved > 0), "index-library").when(library > 0, "search-library").otherwise("save-current")
    )


def chosen_project(forms: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, project_id, title, created, error) of project choices (id, selected_id, selected_title, new_title).

    A new title whose slug exists is that project if the titles agree but for their case, else an error.
    """
    new = trimmed(F.coalesce("new_title", F.lit("")))
    have = existing.select(F.col("project_id").alias("s"), F.coalesce("title", "project_id").alias("known"))
    rows = forms.withColumn("new", new).withColumn("s", F.when(new != "", slug(new))).join(have, "s", "left")
    clash = F.col("known").isNotNull() & (F.lower(trimmed("known")) != F.lower("new"))
    old = F.nullif(trimmed(F.coalesce("selected_id", F.lit(""))), F.lit(""))
    is_new = F.col("new") != ""
    return rows.select(
        "id", F.when(is_new & clash, F.lit(None)).when(is_new, F.col("s")).otherwise(old).alias("project_id"),
        F.when(is_new & clash, F.lit(None)).when(is_new, F.coalesce("known", "new")).when(old.isNotNull(), F.coalesce(F.nullif(trimmed("selected_title"), F.lit("")), old)).alias("title"),
        (is_new & F.col("known").isNull()).alias("created"), F.when(is_new & clash, "title takes another project's id").alias("error"),
    )


def captured(forms: DataFrame) -> DataFrame:
    """Content objects from capture forms (id, kind, project_title, title, body, tags, source_url); a form without a body is left out."""
    body, project = trimmed(F.coalesce("body", F.lit(""))), F.nullif(trimmed(F.coalesce("project_title", F.lit(""))), F.lit(""))
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.lit("flash"))
    cut = F.when(kind == "flash", F.substring(F.regexp_replace(body, r"\s+", " "), 1, 42)).otherwise("Untitled note")
    url = F.nullif(trimmed(F.coalesce("source_url", F.lit(""))), F.lit(""))
    return forms.where(body != "").select("id", kind.alias("kind"), F.when(project.isNotNull(), slug(project)).alias("project_id"), project.alias("project_title"), F.coalesce(F.nullif(trimmed(F.coalesce("title", F.lit(""))), F.lit("")), cut).alias("title"), body.alias("body"), tags("tags").alias("tags"), F.when(url.isNotNull(), "web").otherwise("mobile").alias("provider"), url.alias("source_url"))
