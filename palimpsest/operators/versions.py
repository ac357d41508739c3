"""Versions of captured objects: listings, restores, relations, exports, rollback receipts, memory selection, challenges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import ordered
from .objects import fingerprint


def listed(versions: DataFrame, objects: DataFrame | None = None, project: str | None = None, object_id: str | None = None) -> DataFrame:
    """Versions by object and revision: of all objects, of one project's (a semi-join), or of one object, newest first."""
    if project is not None:
        versions = versions.join(objects.where(F.col("project_id") == project).select(F.col("id").alias("object_id")), "object_id", "left_semi")
    if object_id is not None:
        return versions.where(F.col("object_id") == object_id).orderBy(F.desc("revision"))
    return versions.orderBy("object_id", "revision")


def restored(wanted: DataFrame, versions: DataFrame, objects: DataFrame) -> DataFrame:
    """(object_id, outcome, revision, restored_from, digest): a restore writes an old version's content as the object's next revision.

    wanted: object_id, revision; versions: object_id, revision, digest; objects: id, revision.
    """
    old = versions.select("object_id", "revision", "digest", F.lit(True).alias("there"))
    now = objects.select(F.col("id").alias("object_id"), F.col("revision").alias("present"))
    rows = wanted.join(old, ["object_id", "revision"], "left").join(now, "object_id", "left")
    outcome = F.when(F.col("present").isNull(), "refused:object_not_found").when(F.col("there").isNull(), "refused:version_not_found").otherwise("restored")
    good = outcome == "restored"
    return rows.select("object_id", outcome.alias("outcome"), F.when(good, F.col("present") + 1).alias("revision"), F.when(good, F.col("revision")).alias("restored_from"), F.when(good, F.col("digest")).alias("digest"))


def linked(relations: DataFrame, objects: DataFrame) -> DataFrame:
    """Relations (id, from_id, to_id) with ``outcome`` and the project they belong to: both ends must exist, in one project where both have one."""
    end = lambda p: objects.select(F.col("id").alias(f"{p}_id"), F.col("project_id").alias(f"{p}_project"), F.lit(True).alias(f"{p}_there"))
    rows = relations.join(end("from"), "from_id", "left").join(end("to"), "to_id", "left")
    outcome = F.when(F.col("from_there").isNull() | F.col("to_there").isNull(), "refused:endpoint_missing").when(F.col("from_project") != F.col("to_project"), "refused:cross_project").otherwise("linked")
    return rows.select("id", "from_id", "to_id", outcome.alias("outcome"), F.when(outcome == "linked", F.coalesce("from_project", "to_project")).alias("project_id"))


def unlinked(relations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The relations that stay, and the operations (object_id, type, relation_id) that log the others' removal."""
    gone = relations.join(ids.select("id").distinct(), "id", "left_semi")
    return relations.join(ids.select("id"), "id", "left_anti"), gone.select(F.col("from_id").alias("object_id"), F.lit("unlink").alias("type"), F.col("id").alias("relation_id"))


def relations_of(relations: DataFrame, object_id: str | int | None = None, project: str | None = None) -> DataFrame:
    """Relations by age, of one object at either end, of one project, or all; operations and promotions are listed likewise by ``newest``."""
    if project is not None:
        relations = relations.where(F.col("project_id") == project)
    if object_id is not None:
        relations = relations.where((F.col("from_id") == object_id) | (F.col("to_id") == object_id))
    return relations.orderBy("created_at", "id")


def exported(objects: DataFrame, versions: DataFrame, relations: DataFrame, operations: DataFrame, promotions: DataFrame, project: str | None = None, unbound: bool = False, date_from: str | None = None, date_to: str | None = None) -> dict[str, DataFrame]:
    """The tables of an export of captures: objects by project and date, and all that belongs to them; a relation needs both of its ends."""
    if project is not None:
        objects = objects.where(F.col("project_id") == project)
    if unbound:
        objects = objects.where("project_id IS NULL OR project_id = ''")
    at = F.coalesce("updated_at", "created_at") if "created_at" in objects.columns else F.col("updated_at")
    if date_from:
        objects = objects.where(at >= F.to_timestamp(F.lit(f"{date_from} 00:00:00")))
    if date_to:
        objects = objects.where(at <= F.to_timestamp(F.lit(f"{date_to} 23:59:59.999")))
    ids = lambda name: objects.select(F.col("id").alias(name))
    of = lambda df, name: df.join(ids(name), name, "left_semi")
    return {"objects": objects, "versions": of(versions, "object_id"), "relations": of(of(relations, "from_id"), "to_id"), "operations": of(operations, "object_id"), "promotions": of(promotions, "source_id")}


def rollback_receipt(actions: DataFrame, source_receipt: str, at: str) -> DataFrame:
    """An append-only receipt of a rollback's actions (kind, id): counts by kind and one hash over all of them."""
    mark = fingerprint(actions, "kind", "id")
    return actions.groupBy("kind").agg(F.count("*").alias("rows")).crossJoin(mark).select(F.lit(source_receipt).alias("source_receipt"), F.lit(at).alias("created_at"), "kind", "rows", F.col("fingerprint").alias("receipt_hash"))  # one row of hash


def memory_messages(messages: DataFrame, conversations: DataFrame, query: str = "") -> DataFrame:
    """Active messages of known conversations for a memory package: with a query those that match by score, and the newest first."""
    from palimpsest.functions.text import search_score

    rows = messages.where(F.coalesce("active", F.lit(True))).join(conversations.select("conversation_id", "updated_at"), "conversation_id")
    at = F.coalesce("created_at", "updated_at")
    score = search_score("text", query, F.lit(True), F.col("role") == "user") if query.strip() else F.lit(0)
    return rows.withColumn("score", score.cast("long")).where("score IS NOT NULL").orderBy(F.desc("score"), F.desc_nulls_last(at), "key")


def merged_parts(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, position, kind, language, text): the parts (kind, language, text) of a group's fragments put together.

    A text or code part that follows one of its kind (and language) continues it: a text that
    holds the other as its beginning replaces it, else it is added.  Any other part
    that the group has already is left out.  Parts stream in order; the state is the
    last part and the set of digests of those before.
    """
    import hashlib

    def step(state, row):
        n, kind, language, body, seen = state
        now = (row["kind"], row["language"] or "", row["text"] or "")
        mark = hashlib.sha256("\0".join(now).encode()).digest()
        if n and kind == now[0] and kind in ("text", "code") and (kind == "text" or language == now[1]):
            text = now[2] if now[2].startswith(body) else body if body.startswith(now[2]) else body + now[2]
            return (n, kind, language, text, seen), (n, text)
        last = hashlib.sha256("\0".join((kind or "", language or "", body or "")).encode()).digest()
        seen = seen | {last} if n else seen
        if mark in seen:
            return (n, kind, language, body, seen), (None, None)
        return (n + 1, now[0], now[1], now[2], seen), (n + 1, now[2])

    folded = ordered(rows, key, [order], step, lambda: (0, None, None, None, frozenset()), "position long, merged string")
    return folded.where("position IS NOT NULL").groupBy(key, "position").agg(F.first("kind").alias("kind"), F.first("language").alias("language"), F.max_by("merged", order).alias("text"))


def grouped_sets(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the sorted distinct values of each key, for keys with few of them."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


# States of a task that is still open.
OPEN = ("todo", "in_progress", "blocked")


def challenge(decisions: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answer key, challenge) of a continuity benchmark.

    The key lists a project's active decisions and open tasks (project_id, kind, id, title, status, priority) in order of
    id; the challenge has, for each project, their counts and an id that is a hash of the whole key.
    """
    status, text = F.coalesce("status", F.lit("active")), lambda c, n: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n)
    d = decisions.where(status == "active").select("project_id", F.lit("decision").alias("kind"), text("id", 200).alias("id"), text("title", 500).alias("title"), status.alias("status"), F.lit(None).cast("string").alias("priority"))
    status = F.coalesce("status", F.lit("todo"))
    t = tasks.where(status.isin(*OPEN)).select("project_id", F.lit("task").alias("kind"), text("id", 200).alias("id"), text("title", 500).alias("title"), status.alias("status"), F.coalesce("priority", F.lit("medium")).alias("priority"))
    key = d.unionByName(t).where("id <> ''")
    # hashes of rows add up in any order, so no project's rows meet in one task
    mark = F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\0", "kind", "id", "title", "status", F.coalesce("priority", F.lit(""))), 256), 1, 14), 16, 10).cast("decimal(38,0)"))
    asked = key.groupBy("project_id").agg(F.count_if(F.col("kind") == "decision").alias("decisions"), F.count_if(F.col("kind") == "task").alias("tasks"), F.concat(F.lit("challenge-"), mark.cast("string")).alias("benchmark_id"))
    return key, asked


def responses(rows: DataFrame, raw: str = "raw", most: int = 500) -> DataFrame:
    """(case, project_id, summary, phase, health, progress, decisions, tasks, evidence) of raw JSON answers: trimmed, bounded, distinct; what is not there is null or empty."""
    j = lambda path, n: F.nullif(F.substring(F.trim(F.coalesce(F.get_json_object(raw, path), F.lit(""))), 1, n), F.lit(""))
    list_of = lambda path: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(F.from_json(F.get_json_object(raw, path), "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")), 1, most)
    each = lambda path: F.filter(F.transform(F.coalesce(F.from_json(F.get_json_object(raw, path), "array<struct<id:string,title:string,status:string,priority:string>>"), F.array().cast("array<struct<id:string,title:string,status:string,priority:string>>")), lambda x: x.withField("id", F.trim(x["id"]))), lambda x: x["id"] != "")
    return rows.select(
        "case", j("$.project.id", 500).alias("project_id"), j("$.status.summary", 20_000).alias("summary"), j("$.status.phase", 500).alias("phase"), j("$.status.health", 100).alias("health"), j("$.status.progressPercent", 40).try_cast("double").alias("progress"),
        each("$.decisions").alias("decisions"), each("$.tasks").alias("tasks"), list_of("$.evidenceUris").alias("evidence"),
    )


def checked(planned: DataFrame, current: DataFrame, key: str = "id", digest: str = "digest") -> DataFrame:
    """Planned rows with ``ok``: whether the source still has the digest that the plan was made on; a volume with a row that is not is not written."""
    now = current.select(key, F.col(digest).alias("now"))
    return planned.join(now, key, "left").withColumn("ok", F.col(digest).eqNullSafe(F.col("now"))).drop("now")


def bundle_files(profiles: DataFrame) -> DataFrame:
    """(project_id, name, text) of the files of approved memories (project_id, version, hash, core, project, sources)."""
    manifest = F.to_json(F.struct("project_id", "version", "hash"))
    evidence = F.concat(F.lit("# Evidence index\n\n"), F.when(F.size("sources") > 0, F.array_join(F.transform(F.array_distinct("sources"), lambda s: F.concat(F.lit("- "), s)), "\n")).otherwise("- none"), F.lit("\n"))
    files = F.array(*(F.struct(F.lit(n).alias("name"), t.alias("text")) for n, t in (("manifest.json", manifest), ("core.md", F.col("core")), ("project.md", F.coalesce("project", "core")), ("evidence.md", evidence))))
    return profiles.where("core IS NOT NULL").select("project_id", F.explode(files).alias("f")).select("project_id", "f.name", "f.text")


def handoff(objects: DataFrame, gate: DataFrame, pack: DataFrame, answer_key: DataFrame, project: str, budget: int) -> DataFrame:
    """One row that binds a handoff's parts: counts and hashes of the project's objects, gate decisions, context pack and answer key, and one hash of all.

    objects: project_id, id, digest; gate: project_id, id, decision, tokens; pack: key, tokens, taken; answer_key: project_id, kind, id.
    """
    own = objects.where(F.col("project_id") == project)
    judged = gate.where(F.col("project_id") == project)
    taken = pack.where("taken")
    one = lambda df, name, *cols: fingerprint(df, *cols).select(F.col("fingerprint").alias(f"{name}_hash")).crossJoin(df.agg(F.count("*").alias(f"{name}_rows")))  # one row each
    row = one(own, "objects", "id", "digest").crossJoin(one(judged, "gate", "id", "decision")).crossJoin(one(taken, "pack", "key", "tokens")).crossJoin(one(answer_key.where(F.col("project_id") == project), "key", "kind", "id"))
    row = row.crossJoin(taken.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("context_tokens")))
    row = row.withColumn("status", F.when(F.col("context_tokens") > budget, "BLOCKED").otherwise("READY"))
    return row.withColumn("handoff_id", F.concat(F.lit("handoff-"), F.substring(F.sha2(F.concat_ws("\n", F.lit(project), "objects_hash", "gate_hash", "pack_hash", "key_hash"), 256), 1, 24)))


def verified_handoff(rows: DataFrame, again: DataFrame) -> DataFrame:
    """(handoff_id, part, ok): parts of a handoff row compared with one that the receiver built anew."""
    parts = ("objects", "gate", "pack", "key")
    old, new = (df.select(F.lit(1).alias("one"), F.col("handoff_id").alias(f"{p}_id"), *(F.col(f"{x}_hash").alias(f"{p}_{x}") for x in parts)) for p, df in (("old", rows), ("new", again)))
    both = old.join(new, "one")  # a row each
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("part"), F.col(f"old_{x}").eqNullSafe(F.col(f"new_{x}")).alias("ok")) for x in parts)))
    return both.select(F.col("old_id").alias("handoff_id"), each.alias("p")).select("handoff_id", "p.part", "p.ok")


def verified_answers(handoffs: DataFrame, kits: DataFrame, receipts: DataFrame, evaluated: DataFrame) -> DataFrame:
    """(handoff_id, status, failures, score, verdict) of handoffs whose receivers answered.

    handoffs: handoff_id, package_hash, payload_hash, preflight (PASS or not); kits and
    receipts: handoff_id of the private kit and of the receiver's receipt as they lie
    beside the handoff ``case``, with their hashes, the receipt's status and mutated flag; evaluated: case, score, verdict, critical.
    An answer is scored only if nothing stands against it: BLOCKED else, VERIFIED_PASS with the verdict PASS, VERIFIED_FAIL with another.
    """
    h = handoffs.select(F.col("handoff_id").alias("case"), "package_hash", "payload_hash", "preflight")
    k = kits.select("case", F.struct("handoff_id", "package_hash", "payload_hash").alias("kit"))
    r = receipts.select("case", F.struct("handoff_id", "package_hash", "status", "mutated").alias("receipt"))
    rows = h.join(k, "case", "left").join(r, "case", "left").join(evaluated.select("case", "score", "verdict", F.col("critical").alias("wrong")), "case", "left")
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    kit, receipt = F.col("kit").isNotNull(), F.col("receipt").isNotNull()
    # Codes of what stands against a handoff.
    tests = [
        (F.col("preflight") != "PASS", "PREFLIGHT_NOT_PASSED"), (~kit, "VERIFICATION_KIT_INVALID"), (~receipt, "RECEIVER_RECEIPT_INVALID"), (F.col("score").isNull(), "RESPONSE_INVALID_JSON"),
        (kit & differ("kit.handoff_id", "case"), "VERIFICATION_KIT_HANDOFF_MISMATCH"), (kit & differ("kit.package_hash", "package_hash"), "RECEIVER_PACKAGE_HASH_MISMATCH"), (kit & differ("kit.payload_hash", "payload_hash"), "RECEIVER_PAYLOAD_ROOT_MISMATCH"),
        (receipt & (F.col("receipt.status") != "PASS"), "RECEIVER_PREFLIGHT_NOT_PASSED"), (receipt & differ("receipt.handoff_id", "case"), "RECEIVER_RECEIPT_HANDOFF_MISMATCH"),
        (receipt & differ("receipt.package_hash", "package_hash"), "RECEIVER_RECEIPT_PACKAGE_MISMATCH"), (receipt & F.coalesce("receipt.mutated", F.lit(True)), "APPROVED_STATE_MUTATION_CLAIM"),
    ]
    against = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), code) for test, code in tests)))
    rows = rows.withColumn("against", against).withColumn("open", F.size("against") == 0)
    failed = F.array_compact(F.array(F.when(F.col("verdict") != "PASS", "CONTINUITY_BENCHMARK_FAILED"), F.when(F.size("wrong") > 0, "CRITICAL_CONTINUITY_ERROR")))
    status = F.when(~F.col("open"), "BLOCKED").when(F.size(failed) > 0, "VERIFIED_FAIL").otherwise("VERIFIED_PASS")
    only = lambda c: F.when(F.col("open"), F.col(c)).alias(c)
    return rows.select(F.col("case").alias("handoff_id"), status.alias("status"), F.when(F.col("open"), failed).otherwise(F.col("against")).alias("failures"), only("score"), only("verdict"))
