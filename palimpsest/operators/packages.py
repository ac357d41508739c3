"""Portable packages and handoffs: hashes, rules, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import parsed_uri

from .objects import fingerprint
from .records import issues


def payload_hash(tables: dict[str, DataFrame]) -> str:
    """One hash of all tables; rows may stand in any order."""
    from hashlib import sha256

    return sha256("\n".join(f"{name}:{fingerprint(df, *df.columns).first()[0]}" for name, df in sorted(tables.items())).encode()).hexdigest()


def package_issues(objects: DataFrame, versions: DataFrame, relations: DataFrame, operations: DataFrame, promotions: DataFrame, project: str | None = None) -> DataFrame:
    """(severity, code, item) of broken rules between the tables of a package."""
    err = lambda df, code, c: df.select(F.lit("error").alias("severity"), F.lit(code).alias("code"), F.col(c).cast("string").alias("item"))
    twice = lambda df, key: df.groupBy(key).count().where("count > 1")
    found = err(twice(objects, "id"), "DUPLICATE_ID", "id").union(err(twice(versions, "key"), "DUPLICATE_ID", "key"))
    if project is not None:
        found = found.union(err(objects.where(~F.col("project_id").eqNullSafe(F.lit(project))), "SCOPE_PROJECT_MISMATCH", "id"))
    found = found.union(err(versions.where("object_id IS NULL OR revision IS NULL OR revision < 1"), "INVALID_CONTENT_VERSION", "key"))
    found = found.union(err(versions.where(F.col("key") != F.concat("object_id", F.lit(":v"), F.col("revision").cast("string"))), "VERSION_IDENTITY_MISMATCH", "key"))
    current = versions.select(F.col("object_id").alias("id"), "revision", "digest")
    found = found.union(err(objects.join(current, ["id", "revision", "digest"], "left_anti"), "CURRENT_VERSION_MISSING", "id"))
    ends = lambda p: objects.select(F.col("id").alias(f"{p}_id"), F.col("project_id").alias(f"{p}_project"), F.lit(1).alias(f"{p}_there"))
    linked = relations.join(ends("from"), "from_id", "left").join(ends("to"), "to_id", "left")
    found = found.union(err(linked.where("from_there IS NULL OR to_there IS NULL"), "RELATION_ENDPOINT_MISSING", "id")).union(err(linked.where("from_project <> to_project"), "CROSS_PROJECT_RELATION", "id"))
    found = found.union(err(operations.join(objects.select(F.col("id").alias("object_id")), "object_id", "left_anti"), "OPERATION_OBJECT_MISSING", "id"))
    origin = promotions.join(objects.select(F.col("id").alias("source_id"), F.col("revision").alias("r")), "source_id", "left")
    return found.union(err(origin.where("r IS NULL"), "PROMOTION_SOURCE_MISSING", "id")).union(err(origin.where("source_revision > r"), "PROMOTION_REVISION_INVALID", "id"))


#: Formats of a package, and of the records of each collection; the version of all of them.
FORMATS = {"package": "portable-package", "objects": "content-object", "versions": "content-version", "relations": "content-relation", "operations": "content-operation", "promotions": "content-promotion"}
SCHEMA_VERSION = 1
KEYS = {"objects": "id", "versions": "key", "relations": "id", "operations": "id", "promotions": "id"}


def content_digest(*cols: str) -> Column:
    """The hash that an object's record should bear."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256))


def envelope(tables: dict[str, DataFrame], project: str | None = None, unbound: bool = False) -> dict:
    """What stands beside the records of a package: hash, id taken from it, and counts."""
    digest = payload_hash(tables)
    return {"format": FORMATS["package"], "schema_version": SCHEMA_VERSION, "package_id": f"capture-package:{digest[:24]}", "payload_hash": digest, "project": project, "unbound": unbound, "counts": {name: df.count() for name, df in tables.items()}}


def record_issues(tables: dict[str, DataFrame], content: list[str]) -> DataFrame:
    """(severity, code, item) of records by themselves and of the evidence that they cite.

    Records bear format and schema_version; objects (id, title, revision, digest) hash
    the columns ``content``; evidence stands in objects.evidence_uris (array),
    relations.evidence_uri and promotions.source_evidence_uri.
    """
    found = None

    def told(rows: DataFrame, code: str | Column, item: Column | str, severity: str = "error") -> None:
        nonlocal found
        part = rows.select(F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), (F.col(item) if isinstance(item, str) else item).cast("string").alias("item"))
        found = part if found is None else found.union(part)

    for name, rows in tables.items():
        key = F.coalesce(F.col(KEYS[name]).cast("string"), F.lit(""))
        at = F.concat(F.lit(f"{name}."), key)
        told(rows.where(key == ""), "MISSING_KEY", F.lit(f"{name}.{KEYS[name]}"))
        told(rows.where(key != "").groupBy(key.alias("k")).count().where("count > 1"), "DUPLICATE_KEY", F.concat(F.lit(f"{name}."), "k"))
        told(rows.where(~F.col("format").eqNullSafe(F.lit(FORMATS[name]))), "FORMAT_MISMATCH", at)
        told(rows.where(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))), "SCHEMA_VERSION_MISMATCH", at)
    objects, versions = tables["objects"], tables["versions"]
    told(issues(objects), "INVALID_CONTENT_OBJECT", F.concat(F.lit("objects."), F.col("id").cast("string"), F.lit("."), "path"))
    told(objects.where(~F.col("digest").eqNullSafe(content_digest(*content))), "CONTENT_HASH_MISMATCH", F.concat(F.lit("objects."), F.col("id").cast("string")))
    snapshot = versions.select(F.col("key").alias("id"), *(F.col(c) for c in versions.columns if c not in ("key", "id")))
    told(issues(snapshot), "INVALID_VERSION_SNAPSHOT", F.concat(F.lit("versions."), F.col("id").cast("string"), F.lit("."), "path"))
    cited = objects.select(F.explode("evidence_uris").alias("uri"), F.concat(F.lit("objects."), F.col("id").cast("string")).alias("at"))
    cited = cited.union(tables["relations"].where("evidence_uri IS NOT NULL").select("evidence_uri", F.concat(F.lit("relations."), F.col("id").cast("string"))))
    cited = cited.union(tables["promotions"].where("source_evidence_uri IS NOT NULL").select("source_evidence_uri", F.concat(F.lit("promotions."), F.col("id").cast("string"))))
    cited = cited.withColumn("e", parsed_uri("uri")).where("e.kind = 'content'").withColumn("key", F.concat("e.id", F.lit(":v"), "e.part"))
    seen = cited.join(versions.select("key", F.col("digest").alias("have"), F.lit(True).alias("there")).dropDuplicates(["key"]), "key", "left")
    told(seen.where("there IS NULL"), "EXTERNAL_CONTENT_EVIDENCE", "at", "warning")
    told(seen.where(F.col("there") & ~F.col("have").eqNullSafe(F.col("e.hash"))), "EVIDENCE_HASH_MISMATCH", "at")
    return found


def envelope_issues(told: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """(severity, code, item) of what stands beside the records: a hash and counts a table, and the scope of objects."""
    objects, want = tables["objects"], envelope(tables)
    # Codes of what is wrong with a package.
    rows = [
        (told.get("format") != FORMATS["package"], "PACKAGE_FORMAT_MISMATCH", "format"), (told.get("schema_version") != SCHEMA_VERSION, "PACKAGE_SCHEMA_MISMATCH", "schemaVersion"),
        (told.get("payload_hash") != want["payload_hash"], "PAYLOAD_HASH_MISMATCH", "payloadHash"), (told.get("package_id") != want["package_id"], "PACKAGE_ID_MISMATCH", "packageId"),
        *(((told.get("counts") or {}).get(name) != n, "COUNT_MISMATCH", f"counts.{name}") for name, n in want["counts"].items()),
    ]
    found = objects.sparkSession.createDataFrame([("error", code, at) for wrong, code, at in rows if wrong], "severity string, code string, item string")
    bound = objects.where(F.lit(bool(told.get("unbound"))) & (F.coalesce("project_id", F.lit("")) != "")).select(F.lit("error"), F.lit("SCOPE_UNBOUND_MISMATCH"), F.concat(F.lit("objects."), F.col("id").cast("string")))
    project = told.get("project")
    other = objects.where(F.lit(project is not None) & ~F.col("project_id").eqNullSafe(F.lit(project))).select(F.lit("error"), F.lit("SCOPE_PROJECT_MISMATCH"), F.concat(F.lit("objects."), F.col("id").cast("string")))
    return found.union(bound).union(other)


def preflight(handoffs: DataFrame) -> DataFrame:
    """(handoff_id, status, failures) of handoffs whose manifest, contract, receipt, state, gate and challenge stand in one row as structs."""
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    tests = [
        (differ("manifest.handoff_id", "contract.handoff_id"), "HANDOFF_ID_MISMATCH"), (differ("receipt.handoff_id", "contract.handoff_id"), "SENDER_RECEIPT_HANDOFF_MISMATCH"),
        (differ("receipt.bundle_hash", "manifest.bundle_hash"), "SENDER_RECEIPT_BUNDLE_HASH_MISMATCH"), (differ("state.project_id", "contract.project_id"), "PROJECT_ID_MISMATCH"),
        (differ("state.version", "contract.state_version"), "STATE_VERSION_MISMATCH"), (differ("state.hash", "contract.state_hash"), "STATE_HASH_MISMATCH"), (differ("gate.project_id", "contract.project_id"), "MEMORY_GATE_PROJECT_MISMATCH"),
        (differ("gate.policy", "contract.policy"), "MEMORY_GATE_POLICY_MISMATCH"), ((F.col("gate.review") > 0) & ~F.col("contract.review_allowed"), "MEMORY_GATE_REVIEW_REQUIRED"),
        ((F.col("gate.overrun") > 0) & ~F.col("contract.overrun_allowed"), "MEMORY_GATE_BUDGET_OVERRUN"), (differ("challenge.benchmark_id", "contract.benchmark_id"), "BENCHMARK_ID_MISMATCH"),
        (F.col("context_tokens") > F.col("contract.budget"), "CONTEXT_PACK_BUDGET_EXCEEDED"),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(True)), code) for t, code in tests)))
    return handoffs.select(F.col("manifest.handoff_id").alias("handoff_id"), F.when(F.size(found) > 0, "BLOCKED").otherwise("PASS").alias("status"), found.alias("failures"))


def receipt(plan: DataFrame, package: str, at: str) -> DataFrame:
    """An append-only receipt of an import plan (id, action): what each write did, and a hash over all of it."""
    rows = plan.where("action IN ('create', 'fast_forward', 'add')")
    counts = rows.groupBy("action").agg(F.count("*").alias("writes"))
    mark = fingerprint(rows, "id", "action")
    return counts.crossJoin(mark).select(F.lit(package).alias("package_id"), F.lit(at).alias("created_at"), "action", "writes", F.col("fingerprint").alias("receipt_hash"))  # one row of hash
