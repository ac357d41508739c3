"""Registered queries of sources, streams and the small expressions that no other query reaches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import folders
from palimpsest.functions import text as T
from palimpsest.operators import canonical, capture, incremental, merge, objects, providers, scoring, web
from palimpsest.sources import archives
from palimpsest.streaming import ingest

from .catalogue import L, query

# --- archives -----------------------------------------------------------------


def zipped(t):
    """Three ZIP files of raw conversations with their canonical records, an unsafe name in each, and one file that is no archive."""
    raw = canonical.raw_of(t.conversations)
    folder = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"))
    archive = F.concat(F.lit("a"), (F.col("conv_id") % 3).cast("string"), F.lit(".zip"))
    one = raw.select(archive.alias("a"), F.concat(folder, F.lit("raw.json")).alias("n"), F.col("raw").alias("p"))
    two = raw.where("conv_id % 2 = 0").select(archive.alias("a"), F.concat(folder, F.lit("canonical.json")).alias("n"), F.concat(F.lit('{"conversationId": "'), F.col("conv_id").cast("string"), F.lit('"}')).alias("p"))
    bad = raw.where("conv_id < 3").select(archive.alias("a"), F.lit("../evil.json").alias("n"), F.lit("{}").alias("p"))
    plain = t.spark.createDataFrame([("x/conversations-1.json", '[{"id": "solo", "mapping": {}}, {"id": "bad"}]')], "path string, text string")
    return archives.packed(one.union(two).union(bad), "a", "n", "p").unionByName(plain.select("path", F.sha2("text", 256).alias("fingerprint"), F.col("text").cast("binary").alias("content")))


@query("""SELECT 'a' || conv_id % 3 || '.zip' AS path, 'c' || conv_id || '/raw.json' AS name, true AS read, CAST(NULL AS VARCHAR) AS error FROM conversations GROUP BY conv_id UNION ALL SELECT 'a' || conv_id % 3 || '.zip', 'c' || conv_id || '/canonical.json', true, NULL FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id
 UNION ALL SELECT 'a' || conv_id || '.zip', '../evil.json', false, 'unsafe name' FROM conversations WHERE conv_id < 3 GROUP BY conv_id UNION ALL SELECT 'x/conversations-1.json', 'conversations-1.json', true, NULL""")
def archive_entries(t):
    return archives.entries(zipped(t)).select("path", "name", F.col("payload").isNotNull().alias("read"), "error")


@query("SELECT CAST(conv_id AS VARCHAR) AS id, CAST(count(*) AS BIGINT) AS nodes FROM conversations GROUP BY conv_id UNION ALL SELECT 'solo', 0")
def archive_conversations(t):
    found = archives.conversations(archives.entries(zipped(t)))
    return found.select(F.get_json_object("raw", "$.id").alias("id"), L(F.size(F.json_object_keys(F.get_json_object("raw", "$.mapping"))), "nodes"))


@query("SELECT 'c' || conv_id || '/' AS folder, CAST(conv_id AS VARCHAR) AS id FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id")
def archive_candidates(t):
    return archives.own_candidates(archives.entries(zipped(t))).select("folder", F.get_json_object("canonical", "$.conversationId").alias("id"))


@query("SELECT 'conversations' AS name, doc_id AS n FROM documents WHERE source = 'src1' UNION ALL SELECT 'evidence', conv_id FROM conversations WHERE turn = 0")
def bundle_round_trip(t):
    """Written for one project and read again; a table without projects is whole, one that was not written is empty."""
    path = folders.scratch(t.spark)
    archives.write_bundle({"conversations": t.documents.select(F.col("source").alias("project_id"), F.col("doc_id").alias("n")), "evidence": t.conversations.where("turn = 0").select(F.col("conv_id").alias("n"))}, path, "src1")
    found = archives.read_bundle(t.spark, path, {"conversations": "project_id string, n long", "evidence": "n long", "messages": "n long"})
    out = None
    for name, df in found.items():
        part = df.select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


@query("""WITH o AS (SELECT doc_id FROM documents WHERE source = 'src1') SELECT 'content_objects' AS name, count(*) AS rows FROM o UNION ALL SELECT 'content_versions', 2 * count(*) FROM o UNION ALL SELECT 'content_relations', count(*) FROM o WHERE doc_id + 20 IN (SELECT doc_id FROM o)""")
def bundle_manifest(t):
    """A manifest's row counts: what belongs to a project's objects goes with them, a relation only with both of its ends."""
    path, i = folders.scratch(t.spark), F.col("doc_id")
    things = t.documents.select(i.alias("id"), F.col("source").alias("project_id"))
    version = t.documents.select(i.alias("object_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("revision"))
    archives.write_bundle({"content_objects": things, "content_versions": version, "content_relations": t.documents.select(i.alias("from_id"), (i + 20).alias("to_id"))}, path, "src1")
    return t.spark.read.schema("table string, rows long").json(f"{path}/manifest").select(F.col("table").alias("name"), "rows")


@query("SELECT 'c' || doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'untitled conversation' ELSE lang END AS title, doc_id % 3 = 0 AS archived, CASE WHEN doc_id % 3 = 0 THEN 'archived' ELSE 'regular' END AS kind, CASE WHEN doc_id % 2 = 0 THEN source END AS project_id FROM documents WHERE doc_id % 7 <> 0")
def conversation_entries(t):
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    raw = F.concat(
        F.lit('{"'), F.when(i % 2 == 0, "id").otherwise("conversation_id"), F.lit('": "'), F.when(i % 7 != 0, F.concat(F.lit("c"), n)).otherwise(""), F.lit('", "title": "'), F.when(i % 4 != 0, F.col("lang")).otherwise(" "), F.lit('"'),
        F.when(i % 3 == 0, ', "is_archived": true').otherwise(""), F.when(i % 2 == 0, F.concat(F.lit(', "gizmo_id": "'), "source", F.lit('"'))).otherwise(""), F.lit("}"),
    )
    return providers.conversation_metadata(t.documents.select(raw.alias("raw"))).select("id", "title", "archived", F.col("location.type").alias("kind"), "location.project_id")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'new' END AS title, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 2 END AS version, doc_id % 3 <> 0 AND (doc_id % 3 = 1 OR doc_id % 2 = 0) AS refresh,
 CASE doc_id % 3 WHEN 0 THEN 'regular:true,project:true' WHEN 1 THEN 'project:false,archived:true' ELSE 'regular:true,project:false,archived:true' END AS locations FROM documents""")
def metadata_refresh(t):
    """Known at version 1, seen at version id % 2: every third is only known, every third only seen."""
    i, there = F.col("doc_id"), F.lit(True)
    place = lambda kind, project, present: F.struct(F.lit(kind).alias("type"), F.lit(project).cast("string").alias("project_id"), present.alias("present"))
    known = t.documents.where("doc_id % 3 <> 1").select(i.alias("id"), F.lit("old").alias("title"), F.lit(1).cast("long").alias("version"), F.array(place("regular", None, there), place("project", "p", there)).alias("locations"))
    seen = t.documents.where("doc_id % 3 <> 0").select(i.alias("id"), F.lit("new").alias("title"), (i % 2).alias("version"), F.array(place("project", "p", F.lit(False)), place("archived", None, there)).alias("locations"))
    return merge.refreshed(known, seen).withColumn("locations", F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["type"], x["present"].cast("string"))), ","))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE lang END AS body FROM documents")
def body_decoding(t):
    """Plain and base64 bodies; what does not decode is null."""
    i = F.col("doc_id")
    body = F.when(i % 3 == 0, F.base64(F.col("lang").cast("binary"))).when(i % 3 == 1, F.col("lang")).otherwise("?!")
    return t.documents.select("doc_id", providers.body_text(body, i % 3 != 1).alias("body"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN 2 END AS items, CASE WHEN doc_id % 5 = 1 THEN doc_id WHEN doc_id % 5 = 3 THEN 7 END AS total FROM documents")
def list_responses(t):
    i = F.col("doc_id").cast("string")
    body = F.element_at(F.array(F.lit("[1, 2]"), F.concat(F.lit('{"items": [1, 2], "total": '), i, F.lit("}")), F.lit('{"results": [{}, {}]}'), F.lit('{"data": {"items": [1, 2], "total": 7}}'), F.lit('{"other": []}')), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = t.documents.select("doc_id", F.try_parse_json(body).alias("v"))
    return rows.select("doc_id", L(F.nullif(F.size(archives.first_list(F.col("v"))), F.lit(-1)), "items"), archives.first_total(F.col("v")).alias("total"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE k END AS ordinal, doc_id + k AS n FROM documents, (VALUES (0), (2)) v(k) WHERE doc_id % 2 = 1 OR k = 0")
def stream_bodies(t):
    """Whole JSON bodies and event streams with noise between their lines."""
    i = F.col("doc_id")
    line = lambda k: F.concat(F.lit('{"n": '), (i + k).cast("string"), F.lit("}"))
    body = F.when(i % 2 == 0, line(0)).otherwise(F.concat(F.lit("data: "), line(0), F.lit("\n: noise\n0:"), line(2), F.lit("\n")))
    found = archives.stream_events(t.documents.select("doc_id", body.alias("body")))
    return found.select("doc_id", L("ordinal", "ordinal"), F.try_variant_get("event", "$.n", "bigint").alias("n"))


@query("SELECT 'g' || doc_id AS id, 'kept' AS title FROM documents")
def nested_graphs(t):
    """Graphs in arrays and in JSON within strings; of two with one id the larger stays."""
    i = F.col("doc_id").cast("string")
    graph = F.concat(F.lit('{"id": "g'), i, F.lit('", "title": "kept", "mapping": {}}'))
    small = F.concat(F.lit('{"id": "g'), i, F.lit('", "mapping": {}}'))
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"a": [{"b": '), graph, F.lit("}, "), small, F.lit("]}"))).otherwise(F.to_json(F.struct(graph.alias("text"), small.alias("other"))))
    return archives.graph_objects(t.documents.select(body.alias("body"))).select("id", F.get_json_object("raw", "$.title").alias("title"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(text) END AS digest, doc_id % 7 <> 0 AS ok FROM documents WHERE text <> ''")
def reassembled_chunks(t):
    """Base64 pieces in any order; where the first is missing the length tells."""
    raw = F.col("text").cast("binary")
    third = F.expr("cast(ceil(octet_length(text) / 9) * 3 as int)")  # base64 joins where pieces are multiples of 3 bytes
    piece = lambda k: F.base64(F.substring(raw, F.lit(1) + k * third, third))
    rows = t.documents.where("text <> ''").select("doc_id", F.octet_length("text").alias("size"), F.posexplode(F.array(piece(0), piece(1), piece(2))).alias("n", "piece")).where("doc_id % 7 <> 0 OR n > 0")
    joined = archives.reassembled(rows.withColumn("piece", F.regexp_replace("piece", "\\s", "")), "doc_id", "n", "piece", "size")
    return joined.select("doc_id", F.when(F.col("ok"), F.sha2("payload", 256)).alias("digest"), "ok")


# --- streams ------------------------------------------------------------------


@query("SELECT user_id AS id, max(ts) AS updated_at, max_by(event_type, ts) AS digest FROM events GROUP BY user_id")
def stream_current(t):
    """Events drained twice from a stream into the log: nothing doubles, the newest version of each key is current."""
    base = folders.scratch(t.spark)
    schema = t.events.schema
    for _ in range(2):
        rows = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder).select(F.col("user_id").alias("id"), F.col("ts").alias("updated_at"), F.col("event_type").alias("digest"))
        ingest.ingest(rows, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return ingest.current(t.spark, f"{base}/log")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(t):
    """Daily counts of a stream with a watermark; all windows, closed or not."""
    base = folders.scratch(t.spark)
    rows = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder).withColumn("ts", F.col("ts").cast("timestamp"))
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{base}/windows")
    ingest.windowed(rows).writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/windows").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


# --- expressions --------------------------------------------------------------


@query("SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE epoch_ms(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id) END AS ms FROM documents")
def instants(t):
    i = F.col("doc_id")
    s = F.lit(1704067200) + i * 3600
    x = F.when(i % 4 == 0, s.cast("string")).when(i % 4 == 1, (s * 1000).cast("string")).when(i % 4 == 2, F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return t.documents.select("doc_id", F.unix_millis(T.instant(x)).alias("ms"))


@query("SELECT doc_id, 'file-' || doc_id || ',file_b' || doc_id AS ids, CASE WHEN doc_id % 3 = 2 THEN false ELSE true END AS present, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'project' END AS location FROM documents")
def file_references(t):
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    text = F.concat(F.lit("see file-"), n, F.lit(" and sandbox:/file_b"), n, F.lit(", again file-"), n)
    place = lambda kind, there: F.struct(F.lit(kind).alias("type"), there.alias("present"))
    none = F.filter(F.array(place("x", F.lit(True))), lambda _: F.lit(False))
    places = F.when(i % 3 == 0, none).otherwise(F.array(place("regular", F.lit(False)), place("project", F.when(i % 3 == 2, False))))
    rows = t.documents.select("doc_id", text.alias("text"), places.alias("places"))
    return rows.select("doc_id", F.array_join(web.file_ids("text"), ",").alias("ids"), web.present(F.col("places")).alias("present"), web.primary(F.col("places"), ["project", "regular"])["type"].alias("location"))


@query("""SELECT doc_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || ' min' WHEN s < 86400 THEN s // 3600 || ' h' ELSE s // 86400 || ' d' END AS age, CASE WHEN doc_id % 4 > 1 THEN 'danger' WHEN doc_id % 4 = 1 THEN 'warning' ELSE 'good' END AS quality,
 doc_id % 2 = 0 AND doc_id % 5 >= 3 AND doc_id % 3 <> 0 AS backed FROM (SELECT *, doc_id * 997 AS s FROM documents)""")
def ages_and_health(t):
    i = F.col("doc_id")
    c = {k: F.lit(True) for k in ("viable", "exact_id", "root_reached")} | {"parent_breaks": F.lit(0), "cycle": i % 3 == 0, "active_messages": i % 5, "max_turn": F.lit(3)}
    return t.documents.select("doc_id", T.relative_age(i * 997).alias("age"), capture.quality(F.floor(i % 4 / 2), i % 2).alias("quality"), capture.corroborated(c, i % 2 == 0, F.lit(2)).alias("backed"))


@query("SELECT event_id, least(500 * power(2, event_id % 8), 15000) AS wait, event_id % 4 IN (0, 2) AS again FROM events WHERE event_id % 5 <> 0")
def retries(t):
    """Ids that a scan no longer sees are pruned; the others wait and try again."""
    i = F.col("event_id")
    rows = incremental.pruned(t.events.select("event_id"), t.events.where("event_id % 5 = 0").select("event_id"), "event_id")
    status = F.element_at(F.array(*map(F.lit, (429, 404, 503, 200))), (i % 4 + 1).cast("int"))
    return rows.select("event_id", incremental.backoff_ms(i % 8 + 1).cast("double").alias("wait"), incremental.retryable(status).alias("again"))


@query("SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def put_if_missing(t):
    rows = t.documents.select(F.sha2("text", 256).alias("key"), "doc_id")
    return objects.missing(rows, rows.where("doc_id % 2 = 0")).select("key")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'missing,evidence' WHEN 1 THEN 'unsupported' ELSE '' END AS found FROM documents")
def failure_taxonomy(t):
    text = F.element_at(F.array(*map(F.lit, ("A citation was not found", "An invented date", "All well"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.documents.select("doc_id", F.array_join(scoring.failures(text), ",").alias("found"))
