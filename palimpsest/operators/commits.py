"""Operations that read a committed version, decide on its rows, and commit the next one: proposals, approvals, saved revisions, packages.

Tables only grow: verdicts stand beside proposals, and an object or a state is the
last of its versions.  What is decided is written down before it is committed, so
a decision and its rows never come from two versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.sources import committed

from . import governance, merge, packages
from .canonical import cut

PROPOSALS = "id string, project_id string, status string, base_version long, base_hash string, created_at timestamp, payload string"
VERDICTS = "id string, verdict string"
STATES = "project_id string, version long, hash string, action string, proposal_id string, payload string"
#: Immutable collections: key, and columns.  Objects are the last of their versions.
RECORDS = {
    "versions": ("key", "key string, object_id string, project_id string, revision long, digest string, body string"), "relations": ("id", "id string, from_id string, to_id string, type string"),
    "operations": ("id", "id string, object_id string, operation string"), "promotions": ("id", "id string, source_id string, source_revision long, target string"),
}


def propose(spark: SparkSession, store: str, proposals: DataFrame) -> tuple[int, DataFrame]:
    """Create proposals, each id once: the version after it, and (id, outcome): added, or refused:exists."""

    def change(now: committed.Snapshot):
        rows = cut(governance.receipts(now.table(spark, "proposals", PROPOSALS).select("id"), proposals))
        new = rows.where("outcome = 'added'").drop("outcome")
        return (None if new.isEmpty() else {"added": {"proposals": new}, "note": {"operation": "propose"}}), rows.select("id", "outcome")

    return committed.retried(spark, store, change)


def proposals(spark: SparkSession, now: committed.Snapshot) -> DataFrame:
    """Proposals with the status that their verdicts give them."""
    verdicts = now.table(spark, "verdicts", VERDICTS)
    rows = now.table(spark, "proposals", PROPOSALS)
    return rows.join(verdicts, "id", "left").withColumn("status", F.coalesce("verdict", "status")).select(rows.columns)


def states(spark: SparkSession, now: committed.Snapshot) -> DataFrame:
    """The last version of each project's state."""
    return merge.latest(now.table(spark, "states", STATES), "project_id", "version")


def objects(spark: SparkSession, now: committed.Snapshot) -> DataFrame:
    """The last version of each object: id, project_id, revision, digest, body."""
    rows = merge.latest(now.table(spark, "versions", RECORDS["versions"][1]), "object_id", "revision")
    return rows.select(F.col("object_id").alias("id"), "project_id", "revision", "digest", "body")


def approve(spark: SparkSession, store: str, ids: DataFrame) -> tuple[int, DataFrame]:
    """Approve proposals by compare-and-set on the version and hash of the state that each was made on: (id, project_id, outcome, from_version, to_version).

    An approval writes the next version of the state (its hash is that of the
    version and the payload) and the proposal's verdict, both in one commit.
    """

    def change(now: committed.Snapshot):
        rows = proposals(spark, now).join(ids.select("id").distinct(), "id", "left_semi")
        done = cut(governance.approvals(rows, states(spark, now)))
        good = done.where("outcome = 'approved'")
        if good.isEmpty():
            return None, done
        hashed = F.sha2(F.concat_ws("\n", F.col("to_version").cast("string"), F.coalesce("payload", F.lit(""))), 256)
        state = good.join(rows.select("id", "payload"), "id").select("project_id", F.col("to_version").alias("version"), hashed.alias("hash"), F.lit("approved").alias("action"), F.col("id").alias("proposal_id"), "payload")
        return {"added": {"states": state, "verdicts": good.select("id", F.lit("approved").alias("verdict"))}, "note": {"operation": "approve"}}, done

    return committed.retried(spark, store, change)


def save(spark: SparkSession, store: str, edits: DataFrame) -> tuple[int, DataFrame]:
    """Save objects (id, project_id, expected, digest, body) that stand at the revision expected (0: new): (id, outcome, revision)."""

    def change(now: committed.Snapshot):
        there = objects(spark, now).select("id", F.col("project_id").alias("p"), F.col("revision").alias("r"))
        first = F.row_number().over(Window.partitionBy("id").orderBy("digest"))
        rows = edits.withColumn("nth", first).join(there, "id", "left")
        outcome = (
            F.when(F.col("nth") > 1, "refused:edited_twice").when(F.coalesce("r", F.lit(0)) != F.col("expected"), "refused:revision_changed")
            .when(F.col("r").isNotNull() & ~F.col("p").eqNullSafe(F.col("project_id")), "refused:other_project").otherwise("saved")
        )
        rows = cut(rows.withColumn("outcome", outcome).withColumn("revision", (F.coalesce("r", F.lit(0)) + F.when(outcome == "saved", 1).otherwise(0)).cast("long")))
        good, told = rows.where("outcome = 'saved'"), rows.select("id", "outcome", "revision")
        key = F.concat("id", F.lit(":v"), F.col("revision").cast("string")).alias("key")
        new = good.select(key, F.col("id").alias("object_id"), "project_id", "revision", "digest", "body")
        return (None if good.isEmpty() else {"added": {"versions": new}, "note": {"operation": "save"}}), told

    return committed.retried(spark, store, change)


def package_plan(spark: SparkSession, now: committed.Snapshot, package: dict[str, DataFrame]) -> DataFrame:
    """(collection, id, action) of every row of a package against a version; a rule that the package breaks is a conflict."""
    have = {name: now.table(spark, name, schema) for name, (_, schema) in RECORDS.items()}
    here = objects(spark, now)
    of = lambda df: df.select("id", F.col("project_id").alias("project"), "revision", "digest")
    past = lambda df: df.select(F.col("object_id").alias("id"), "revision", "digest")
    plan = merge.plan_objects(of(package["objects"]), of(here), past(package["versions"]), past(have["versions"])).select(F.lit("objects").alias("collection"), F.col("id").cast("string").alias("id"), "action")
    broken = packages.package_issues(*(package[c] for c in ("objects", *RECORDS))).where("severity = 'error'")
    plan = plan.union(broken.select(F.lit("package"), "item", F.concat(F.lit("conflict:"), "code")))
    for name, (key, _) in RECORDS.items():
        signed = lambda df, key=key: df.select(F.col(key).cast("string").alias("id"), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("digest"))
        plan = plan.union(merge.plan_records(signed(package[name]), signed(have[name].select(package[name].columns)), "id", "digest").select(F.lit(name), "id", "action"))
    plan = cut(plan)
    added = plan.where("collection = 'relations' AND action = 'add'").select("id")
    ends = merge.plan_relations(package["relations"].join(added, "id", "left_semi"), here, plan.where("collection = 'objects' AND action = 'create'"))
    return plan.union(ends.where("NOT ok").select(F.lit("relations"), "id", F.lit("conflict:RELATION_ENDPOINT_UNAVAILABLE")))


def apply_package(spark: SparkSession, store: str, package: dict[str, DataFrame]) -> tuple[int, DataFrame]:
    """Import a package of five tables at once or not at all: the version after it, and (collection, id, action).

    Every row is checked against the version that the import is committed on, and
    again against a newer one if another writer was first.  One conflict, and
    nothing is written; without a row to write there is no new version either.
    """

    def change(now: committed.Snapshot):
        plan = cut(package_plan(spark, now, package))
        if not plan.where("startswith(action, 'conflict')").isEmpty() or plan.where("action = 'add'").isEmpty():
            return None, plan
        new = {name: package[name].join(plan.where(f"collection = '{name}' AND action = 'add'").select(F.col("id").alias(key)), key, "left_semi") for name, (key, _) in RECORDS.items()}
        return {"added": new, "note": {"operation": "import"}}, plan

    return committed.retried(spark, store, change)
