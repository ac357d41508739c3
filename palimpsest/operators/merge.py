"""Keyed merges: upserts, portable imports, conflicts, rollback checks, state patches and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .objects import difference


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "key", digest: str = "digest", at: str = "updated_at") -> DataFrame:
    """(key, status): inserted, duplicate (same digest), stale (older than what is there) or updated.  Missing dates are not stale."""
    old = existing.select(key, F.col(digest).alias("old_digest"), F.col(at).alias("old_at"), F.lit(1).alias("there"))
    rows = incoming.join(old, key, "left")
    status = F.when(F.col("there").isNull(), "inserted").when(F.col(digest) == F.col("old_digest"), "duplicate").when(F.col(at) < F.col("old_at"), "stale").otherwise("updated")
    return rows.select(key, status.alias("status"), digest, at)


def applied(existing: DataFrame, incoming: DataFrame, key: str = "key", digest: str = "digest", at: str = "updated_at") -> DataFrame:
    """The table after the upsert: stale and duplicate rows never replace what is there."""
    good = upsert(existing, incoming, key, digest, at).where("status IN ('inserted', 'updated')").select(key)
    return existing.join(good, key, "left_anti").unionByName(incoming.join(good, key, "left_semi"))


def latest(versions: DataFrame, key: str = "id", revision: str = "revision") -> DataFrame:
    """The last version of each object."""
    best = versions.groupBy(key).agg(F.max_by(F.struct(*versions.columns), revision).alias("v"))
    return best.select("v.*")


def merged(rows: DataFrame, key: str, order: str, any_: list[str] = (), last: list[str] = (), sets: list[str] = ()) -> DataFrame:
    """One row a key: OR of flags, the last non-null values, unions of arrays."""
    aggs = [F.bool_or(c).alias(c) for c in any_]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets]
    return rows.groupBy(key).agg(*aggs)


def locations(before: Column, after: Column) -> Column:
    """Two arrays of locations (type, project_id, ...) as one: of one type and project the later stays, at the place of the first."""
    same = lambda x, y: (x["type"] == y["type"]) & x["project_id"].eqNullSafe(y["project_id"])
    kept = F.transform(before, lambda x: F.coalesce(F.get(F.filter(after, lambda y: same(x, y)), F.lit(0)), x))
    return F.concat(kept, F.filter(after, lambda y: ~F.exists(before, lambda x: same(x, y))))


def refreshed(known: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """(key, title, version, locations, refresh) of known and newly seen metadata (title, version, locations): new values where there are some, and whether the content is to be fetched again."""
    old = known.select(key, *(F.col(c).alias(f"old_{c}") for c in ("title", "version", "locations")), F.lit(True).alias("there"))
    rows = seen.join(old, key, "full_outer")
    none = F.filter(F.coalesce("locations", "old_locations"), lambda _: F.lit(False))
    fresh = F.col("version").isNotNull() & ~F.col("version").eqNullSafe(F.col("old_version"))
    return rows.select(key, F.coalesce("title", "old_title").alias("title"), F.coalesce("version", "old_version").alias("version"), locations(F.coalesce("old_locations", none), F.coalesce("locations", none)).alias("locations"), fresh.alias("refresh"))


def plan_objects(incoming: DataFrame, local: DataFrame, incoming_versions: DataFrame, local_versions: DataFrame) -> DataFrame:
    """(id, action) of incoming objects (id, project, revision, digest) against local ones and both version histories (id, revision, digest)."""
    here = local.select("id", F.col("project").alias("l_project"), F.col("revision").alias("l_revision"), F.col("digest").alias("l_digest"))
    ours = local_versions.select("id", "revision", F.col("digest").alias("ours"))
    theirs = incoming_versions.select("id", F.col("revision").alias("l_revision"), F.col("digest").alias("theirs"))
    rows = incoming.join(here, "id", "left").join(theirs, ["id", "l_revision"], "left").join(ours, ["id", "revision"], "left")
    action = (
        F.when(F.col("l_revision").isNull(), "create").when(~F.col("l_project").eqNullSafe(F.col("project")), "conflict:PROJECT_CONFLICT")
        .when((F.col("revision") == F.col("l_revision")) & (F.col("digest") == F.col("l_digest")), "skip:identical")
        .when((F.col("revision") > F.col("l_revision")) & (F.col("theirs") == F.col("l_digest")), "fast_forward")
        .when((F.col("revision") < F.col("l_revision")) & (F.col("ours") == F.col("digest")), "skip:local-ahead")
        .when(F.col("revision") == F.col("l_revision"), "conflict:REVISION_HASH_CONFLICT").otherwise("conflict:DIVERGENT_HISTORY")
    )
    return rows.select("id", "revision", "l_revision", action.alias("action"))


def plan_records(incoming: DataFrame, local: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action) of immutable records: add, skip:identical, or a conflict."""
    here = local.select(key, F.col(digest).alias("l_digest"), F.lit(1).alias("there"))
    action = F.when(F.col("there").isNull(), "add").when(F.col(digest) == F.col("l_digest"), "skip:identical").otherwise("conflict:RECORD_ID_CONFLICT")
    return incoming.join(here, key, "left").select(key, action.alias("action"))


def plan_relations(added: DataFrame, local_objects: DataFrame, created: DataFrame) -> DataFrame:
    """Relations (id, from_id, to_id) with ``ok``: whether both ends will exist after the import."""
    ends = local_objects.select("id").union(created.select("id")).distinct()
    one, two = ends.select(F.col("id").alias("from_id"), F.lit(1).alias("f")), ends.select(F.col("id").alias("to_id"), F.lit(1).alias("t"))
    return added.join(one, "from_id", "left").join(two, "to_id", "left").select("id", "from_id", "to_id", (F.col("f").isNotNull() & F.col("t").isNotNull()).alias("ok"))


def rollback_conflicts(created: DataFrame, current: DataFrame, relations: DataFrame, operations: DataFrame, own_relations: DataFrame, own_operations: DataFrame) -> DataFrame:
    """(id, code) for what stands against undoing an import: changed objects, and relations or operations others have added since."""
    now = current.select("id", F.col("revision").alias("r"), F.col("digest").alias("d"))
    changed = created.join(now, "id", "left").where(~(F.col("revision").eqNullSafe(F.col("r")) & F.col("digest").eqNullSafe(F.col("d")))).select("id", F.lit("OBJECT_CHANGED_AFTER_IMPORT").alias("code"))
    foreign = relations.join(own_relations.select("id"), "id", "left_anti")
    ends = foreign.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    related = created.select("id").join(ends, "id", "left_semi").select("id", F.lit("DEPENDENT_RELATION_EXISTS").alias("code"))
    later = operations.join(own_operations.select("id"), "id", "left_anti").select(F.col("object_id").alias("id")).distinct()
    operated = created.select("id").join(later, "id", "left_semi").select("id", F.lit("DEPENDENT_OPERATION_EXISTS").alias("code"))
    return changed.union(related).union(operated)


def patched(records: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Records after patches (key, action add/update/supersede, fields to set; null leaves a field): the last patch of a key wins, ``error`` tells refused ones."""
    fields = [c for c in records.columns if c != key]
    new = patches.select(key, "action", *(F.col(c).alias(f"new_{c}") for c in fields))
    rows = records.withColumn("there", F.lit(True)).join(new, key, "full_outer")
    error = F.when((F.col("action") == "add") & F.col("there"), "already exists").when(F.col("action").isin("update", "supersede") & F.col("there").isNull(), "not found")
    rows = rows.withColumn("error", error)
    value = lambda c: F.when(F.col("action").isNull() | F.col("error").isNotNull(), F.col(c)).otherwise(F.coalesce(f"new_{c}", c))
    cols = [F.when((F.col("action") == "supersede") & F.col("error").isNull(), "superseded").otherwise(value(c)).alias(c) if c == "status" else value(c).alias(c) for c in fields]
    return rows.select(key, *cols, "error")


def changes(before: DataFrame, after: DataFrame, key: str = "id", label: str = "record") -> DataFrame:
    """(path, type): add, remove or change of records."""
    names = [c for c in before.columns if c != key]
    sign = lambda df: df.select(key, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("sign"))
    diff = difference(sign(before), sign(after), key, "sign").where("change <> 'unchanged'")
    kind = F.when(F.col("change") == "added", "add").when(F.col("change") == "removed", "remove").otherwise("change")
    return diff.select(F.concat(F.lit(f"{label}."), F.col(key).cast("string")).alias("path"), kind.alias("type"))


def concurrent(touched: DataFrame, base: DataFrame, current: DataFrame, key: str = "key", digest: str = "digest") -> DataFrame:
    """Touched keys whose value changed between the base a proposal was made on and the current state."""
    b, c = base.select(key, F.col(digest).alias("b")), current.select(key, F.col(digest).alias("c"))
    return touched.join(b, key, "left").join(c, key, "left").where(~F.col("b").eqNullSafe(F.col("c"))).select(key, F.lit("concurrent_change").alias("code"))


def versioned(log: DataFrame, key: str = "object_id", order: str = "at") -> DataFrame:
    """Operation log with ``revision`` and ``ok``: an operation holds if the revision it expects is the one before it."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order, "id"))
    return log.withColumn("revision", rank).withColumn("ok", F.col("expected").isNull() | (F.col("expected") == F.col("revision") - 1))


def line_changes(before: DataFrame, after: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, line, change): lines of the one text that the other lacks; a line that stands twice counts twice."""
    lines = lambda df: df.select(key, F.explode(F.split(text, "\n")).alias("line"))
    old, new = lines(before), lines(after)
    return new.join(old.distinct(), [key, "line"], "left_anti").withColumn("change", F.lit("added")).union(old.join(new.distinct(), [key, "line"], "left_anti").withColumn("change", F.lit("removed")))
