"""Content-addressed storage: chunks and manifests, reuse, closure, collection, snapshots, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .canonical import cut


def stable_hash(*cols: Column | str) -> Column:
    """SHA-256 of the canonical JSON of named values."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def plan(nodes: DataFrame, size: int = 256) -> DataFrame:
    """Storage objects of conversations (conversation_id, ordinal, node_id, payload): nodes, chunks of ``size`` nodes, manifests.

    key, kind, bytes, refs.  A chunk's hash is that of its nodes' keys, a manifest's
    that of its chunks', so an appended node changes one chunk and the manifest.
    """
    node = nodes.select("conversation_id", "ordinal", F.concat(F.lit("node:"), F.sha2("payload", 256)).alias("key"), F.octet_length("payload").cast("long").alias("bytes"))

    def level(below: DataFrame, kind: str, group: list, order: str) -> DataFrame:
        # at most ``size`` keys a chunk; a manifest lists a conversation's chunks
        refs = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), "key"))), lambda x: x["key"])
        rows = below.groupBy(*group).agg(refs.alias("refs"))
        return rows.withColumn("text", F.array_join("refs", "\n")).select(*group, F.concat(F.lit(f"{kind}:"), F.sha2("text", 256)).alias("key"), F.octet_length("text").cast("long").alias("bytes"), "refs")

    chunk = level(node.withColumn("chunk", F.floor(F.col("ordinal") / size)), "chunk", ["conversation_id", "chunk"], "ordinal")
    manifest = level(chunk, "manifest", ["conversation_id"], "chunk")
    none = F.array().cast("array<string>")
    rows = node.select("conversation_id", "key", "bytes", none.alias("refs")).union(chunk.select("conversation_id", "key", "bytes", "refs")).union(manifest.select("conversation_id", "key", "bytes", "refs"))
    return rows.withColumn("kind", F.substring_index("key", ":", 1))


def missing(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """One of each key that the store lacks."""
    return objects.dropDuplicates(["key"]).join(stored.select("key"), "key", "left_anti")


def reuse(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """(kind, inserted, reused, bytes_written, bytes_reused) of a put of ``objects``."""
    have = stored.select("key", F.lit(True).alias("have"))
    rows = objects.groupBy("kind", "key").agg(F.max("bytes").alias("bytes")).join(have, "key", "left")
    new = F.col("have").isNull()
    return rows.groupBy("kind").agg(F.count_if(new).alias("inserted"), F.count_if(~new).alias("reused"), F.coalesce(F.sum(F.when(new, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_written"), F.coalesce(F.sum(F.when(~new, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_reused"))


def closure(start: DataFrame, objects: DataFrame) -> DataFrame:
    """All keys that ``start`` (key) reaches through refs, however long the chains; cycles end by the anti-join with what is known."""
    edges = objects.select("key", F.explode("refs").alias("ref"))
    known, fresh = start.select("key").distinct(), start.select("key").distinct()
    while True:
        fresh = cut(fresh.join(edges, "key").select(F.col("ref").alias("key")).distinct().join(known, "key", "left_anti"))
        if fresh.isEmpty():
            break
        known = cut(known.union(fresh))
    return known


def duplicates(objects: DataFrame, key: str = "key") -> DataFrame:
    """(key, copies) of keys that occur more than once."""
    return objects.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def garbage(objects: DataFrame, live: DataFrame) -> DataFrame:
    """Objects that nothing live reaches."""
    return objects.join(closure(live, objects), "key", "left_anti")


def restored(start: DataFrame, objects: DataFrame) -> DataFrame:
    """(key, ref, present) of manifests and chunks below ``start``: what a restore needs and whether it is there."""
    reached = closure(start, objects)
    edges = objects.join(reached, "key", "left_semi").select("key", F.explode("refs").alias("ref"))
    have = objects.select(F.col("key").alias("ref"), F.lit(True).alias("present")).distinct()
    return edges.join(have, "ref", "left").select("key", "ref", F.coalesce("present", F.lit(False)).alias("present"))


def _below(rows: DataFrame, objects: DataFrame, sides: tuple[str, ...]) -> DataFrame:
    """What hangs below the objects of a level: (conversation_id, at, a key a side), with ``at`` grown by the place among the refs; only what differs goes on.

    A place is compared with the same place, so what follows an insertion differs; nodes are appended.
    """
    refs = objects.select("key", "refs").dropDuplicates(["key"])
    out = None
    for side in sides:
        part = rows.where(F.col(side).isNotNull()).join(refs.withColumnRenamed("key", side), side).select("conversation_id", "at", F.posexplode("refs").alias("k", side))
        part = part.select("conversation_id", F.concat("at", F.array("k")).alias("at"), side)
        out = part if out is None else out.join(part, ["conversation_id", "at"], "full_outer")
    return out if len(sides) == 1 else out.where(~F.col(sides[0]).eqNullSafe(F.col(sides[1])))


def tree_difference(before: DataFrame, after: DataFrame, objects: DataFrame, size: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two sets of manifests (conversation_id, key) compared from the top: only chunks whose keys differ are read.

    Changed nodes (conversation_id, ordinal, change, before, after), the keys read
    (conversation_id, level, key), and those that are asked for and not there.
    """
    old, new = before.select("conversation_id", F.col("key").alias("before")), after.select("conversation_id", F.col("key").alias("after"))
    manifest = old.join(new, "conversation_id", "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("at", F.array().cast("array<int>"))
    manifest = cut(manifest.select("conversation_id", "at", "before", "after"))
    chunk = cut(_below(manifest, objects, ("before", "after")))
    node = cut(_below(chunk, objects, ("before", "after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("updated")
    ordinal = (F.element_at("at", 1).cast("long") * size + F.element_at("at", 2)).alias("ordinal")
    read = None
    for level, rows in (("manifest", manifest), ("chunk", chunk)):
        part = rows.select("conversation_id", F.lit(level).alias("level"), F.explode(F.array_compact(F.array("before", "after"))).alias("key")).distinct()
        read = part if read is None else read.union(part)
    absent = read.join(objects.select("key"), "key", "left_anti").select("conversation_id", "level", "key")
    return node.select("conversation_id", ordinal, change.alias("change"), "before", "after"), read, absent


def restore(manifests: DataFrame, objects: DataFrame, payloads: DataFrame, size: int = 256) -> tuple[DataFrame, DataFrame]:
    """Nodes (conversation_id, ordinal, key, payload) of conversations by their manifests (conversation_id, key), and (conversation_id, level, key) of what is missing at each level.

    A conversation that misses anything is not restored: its nodes are left out.
    """
    top = manifests.select("conversation_id", F.array().cast("array<int>").alias("at"), "key")
    chunk = cut(_below(top, objects, ("key",)))
    node = cut(_below(chunk, objects, ("key",)))
    there = objects.select("key").distinct()
    absent = None
    for level, rows, have in (("manifest", top, there), ("chunk", chunk, there), ("node", node, payloads.select("key").distinct())):
        part = rows.join(have, "key", "left_anti").select("conversation_id", F.lit(level).alias("level"), "key").distinct()
        absent = part if absent is None else absent.union(part)
    absent = cut(absent)
    whole = node.join(absent.select("conversation_id").distinct(), "conversation_id", "left_anti").join(payloads.select("key", "payload").dropDuplicates(["key"]), "key")
    return whole.select("conversation_id", (F.element_at("at", 1).cast("long") * size + F.element_at("at", 2)).alias("ordinal"), "key", "payload"), absent


def difference(before: DataFrame, after: DataFrame, key: str, sign: str) -> DataFrame:
    """(key, change): added, updated, removed, unchanged of two keyed tables."""
    old, new = before.select(key, F.col(sign).alias("old"), F.lit(1).alias("in_old")), after.select(key, F.col(sign).alias("new"), F.lit(1).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return old.join(new, key, "full_outer").select(key, change.alias("change"))


def sizes(refs: DataFrame) -> DataFrame:
    """logical_bytes, physical_bytes (each key once), saved_bytes, unique_objects of references (key, bytes)."""
    each = refs.groupBy("key").agg(F.sum("bytes").alias("all"), F.max("bytes").alias("one"))
    out = each.agg(F.coalesce(F.sum("all"), F.lit(0)).cast("long").alias("logical_bytes"), F.coalesce(F.sum("one"), F.lit(0)).cast("long").alias("physical_bytes"), F.count("*").alias("unique_objects"))
    return out.withColumn("saved_bytes", F.greatest(F.lit(0).cast("long"), F.col("logical_bytes") - F.col("physical_bytes")))


def fingerprint(members: DataFrame, *cols: str) -> DataFrame:
    """One hash of a table that does not depend on the order of its rows."""
    return members.select(F.sha2(F.to_json(F.struct(*cols)), 256).alias("h")).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("s")).select(F.sha2(F.concat_ws(":", "n", "s"), 256).alias("fingerprint"))


def retained(snapshots: DataFrame, now: str, most: int = 30, days: int = 180, by: str = "account") -> DataFrame:
    """Adds ``kept``: the newest of an account always, others within the count and the age."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("id")))
    young = F.col("created_at") >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {max(1, days)} DAYS")
    rows = snapshots.withColumn("rank", rank)
    return rows.withColumn("kept", (F.col("rank") == 1) | ((F.col("rank") <= max(1, most)) & young))
