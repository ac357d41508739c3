"""Registered queries of what is written and read again: committed versions, packages, volumes, notes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import folders
from palimpsest.functions import text as T
from palimpsest.operators import commits, graph, index, objects, packages, packing, scoring, versions, web
from palimpsest.sources import archives, committed, sinks
from palimpsest.sources.paged import PagedSource
from palimpsest.streaming import jobs

from .catalogue import ORACLE_SQL, WORDS_SQL, L, messages, query

# --- commits with compare-and-set ----------------------------------------------


def asked(t, rows):
    """Events as proposals to the first state of their user."""
    return rows.select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("project_id"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("base_version"),
        F.lit(None).cast("string").alias("base_hash"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("payload"),
    )


@query("SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'refused:exists' ELSE 'added' END AS outcome, CAST(2 AS BIGINT) AS version FROM events")
def proposal_creates(t):
    """Proposals of one event type are created first, then those of all events: an id is created once."""
    store, first = folders.scratch(t.spark), t.events.agg(F.min("event_type")).first()[0]
    commits.propose(t.spark, store, asked(t, t.events.where(F.col("event_type") == first)))
    version, rows = commits.propose(t.spark, store, asked(t, t.events))
    return rows.select("id", "outcome", L(F.lit(version), "version"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS k FROM events)
 SELECT 'state' AS part, CAST(user_id AS VARCHAR) AS id, CAST(1 AS BIGINT) AS version, sha256('1' || chr(10) || event_type) AS value FROM e WHERE k = 1
 UNION ALL SELECT 'again', CAST(event_id AS VARCHAR), NULL, CASE WHEN k = 1 THEN 'refused:already_approved' ELSE 'refused:state_changed' END FROM e""")
def committed_approvals(t):
    """All proposals are approved twice: a project's first one is written, the others were made on a state that has moved on; states and the second verdicts."""
    store = folders.scratch(t.spark)
    commits.propose(t.spark, store, asked(t, t.events))
    commits.approve(t.spark, store, asked(t, t.events))
    _, again = commits.approve(t.spark, store, asked(t, t.events))
    now = committed.snapshot(t.spark, store)
    state = commits.states(t.spark, now).select(F.lit("state").alias("part"), F.col("project_id").alias("id"), "version", F.col("hash").alias("value"))
    return state.union(again.select(F.lit("again"), "id", F.lit(None).cast("long"), "outcome"))


def edits(t, expected):
    return t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("project_id"), expected.cast("long").alias("expected"), F.sha2("text", 256).alias("digest"), F.col("lang").alias("body"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'en' THEN 'saved' ELSE 'refused:revision_changed' END AS outcome, CAST(CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS BIGINT) AS revision FROM documents")
def saved_revisions(t):
    """Objects saved twice; the second time all but the English ones expect a revision that is past."""
    store = folders.scratch(t.spark)
    commits.save(t.spark, store, edits(t, F.lit(0)))
    return commits.save(t.spark, store, edits(t, F.when(F.col("lang") == "en", 1).otherwise(0)))[1]


def bundle(t, revision):
    """A package of all documents at a revision, with every version up to it, a relation to the document's project mate, an operation and a promotion."""
    i = F.col("doc_id").cast("string")
    digest = lambda r: F.sha2(F.concat_ws(":", "text", r.cast("string")), 256)
    things = t.documents.select(i.alias("id"), F.col("source").alias("project_id"), revision.cast("long").alias("revision"), digest(revision.cast("long")).alias("digest"), F.col("lang").alias("body"))
    past = t.documents.select("*", F.explode(F.sequence(F.lit(1).cast("long"), revision.cast("long"))).alias("r"))
    versions = past.select(F.concat(i, F.lit(":v"), F.col("r").cast("string")).alias("key"), i.alias("object_id"), F.col("source").alias("project_id"), F.col("r").alias("revision"), digest(F.col("r")).alias("digest"), F.col("lang").alias("body"))
    return {
        "objects": things, "versions": versions, "relations": t.documents.select(i.alias("id"), i.alias("from_id"), i.alias("to_id"), F.lit("related_to").alias("type")),
        "operations": t.documents.select(i.alias("id"), i.alias("object_id"), F.lit("create").alias("operation")), "promotions": t.documents.select(i.alias("id"), i.alias("source_id"), F.lit(1).cast("long").alias("source_revision"), F.lit("memory").alias("target")),
    }


@query("""WITH d AS (SELECT *, CASE WHEN lang = 'en' THEN 2 WHEN lang = 'de' THEN 3 ELSE 1 END AS r FROM documents)
 SELECT 'object' AS part, CAST(doc_id AS VARCHAR) AS id, CAST(r AS BIGINT) AS revision, sha256(coalesce(text, '') || CASE WHEN text IS NULL THEN '' ELSE ':' END || r) AS value FROM d
 UNION ALL SELECT 'plan', CAST(doc_id AS VARCHAR), NULL, CASE WHEN lang IN ('en', 'de') THEN 'fast_forward' ELSE 'skip:identical' END FROM d
 UNION ALL SELECT 'version', 'third import', 2, 'nothing to write'""")
def package_imports(t):
    """All documents at revision 1, then at 1 to 3, then the same again: the published objects, the second plan, and no version of the third."""
    store, one = folders.scratch(t.spark), F.lit(1)
    commits.apply_package(t.spark, store, bundle(t, one))
    later = bundle(t, F.when(F.col("lang") == "en", 2).when(F.col("lang") == "de", 3).otherwise(1))
    _, plan = commits.apply_package(t.spark, store, later)
    version, _ = commits.apply_package(t.spark, store, later)
    now = commits.objects(t.spark, committed.snapshot(t.spark, store)).select(F.lit("object").alias("part"), "id", "revision", F.col("digest").alias("value"))
    told = plan.where("collection = 'objects'").select(F.lit("plan"), "id", F.lit(None).cast("long"), "action")
    return now.union(told).union(t.spark.range(1).select(F.lit("version"), F.lit("third import"), L(F.lit(version), "v"), F.lit("nothing to write")))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'en' THEN 'conflict:REVISION_HASH_CONFLICT' ELSE 'create' END AS action, CAST((SELECT count(*) FROM documents WHERE lang = 'en') AS BIGINT) AS published FROM documents")
def refused_import(t):
    """One collection of conflicting objects, and nothing of the package is published."""
    store = folders.scratch(t.spark)
    commits.save(t.spark, store, edits(t, F.lit(0)).where("body = 'en'"))
    _, plan = commits.apply_package(t.spark, store, bundle(t, F.lit(1)))
    there = commits.objects(t.spark, committed.snapshot(t.spark, store)).agg(F.count("*").alias("published"))
    return plan.where("collection = 'objects'").select("id", "action").crossJoin(there)  # one row


# --- sinks ---------------------------------------------------------------------


@query(ORACLE_SQL["volume_plan"].replace("SELECT doc_id, volume FROM f", "SELECT d.source || '/volume-' || lpad(CAST(volume AS VARCHAR), 5, '0') || '.zip' AS file, CAST(d.doc_id AS VARCHAR) || '.md' AS name, CAST(strlen(text) AS BIGINT) AS bytes, true AS ok FROM f JOIN documents d USING (doc_id)"))
def volume_archives(t):
    """Documents of a source packed into volumes, written as stored ZIP files, and read again with sizes, checksums and hashes compared."""
    rows = t.documents.select("source", "doc_id", "text", F.octet_length("text").cast("long").alias("b"))
    packed = packing.volumes(rows, 65536, "source", "b", ["doc_id"], 1000)
    file = F.concat("source", F.lit("/volume-"), F.lpad(F.col("volume").cast("string"), 5, "0"), F.lit(".zip"))
    path = folders.scratch(t.spark)
    sinks.write_files(packed.select(file.alias("file"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.col("text").alias("payload")), path, "zip")
    found = sinks.read_files(t.spark, path)
    inside = archives.entries(found.select(F.col("file").alias("path"), F.col("sha256").alias("fingerprint"), "content"))
    return inside.join(found.select(F.col("file").alias("path"), "ok"), "path").select(F.col("path").alias("file"), "name", L(F.octet_length("payload"), "bytes"), (F.col("ok") & F.col("error").isNull()).alias("ok"))


NOTES_SQL = "SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id"


@query(f"SELECT 'conversation/Talk ' || conv_id || '.md' AS file, CAST(strlen(markdown) AS BIGINT) AS bytes, sha256(markdown) AS sha256, true AS ok FROM ({NOTES_SQL})")
def vault_round_trip(t):
    """A note of every conversation as a tree of Markdown files, read again with sizes and hashes compared."""
    notes = graph.markdown(messages(t), "conv_id", "turn")
    named = graph.paths(notes.select("conv_id", F.col("conv_id").cast("string").alias("id"), F.lit("conversation").alias("kind"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title")))
    path = folders.scratch(t.spark)
    rows = notes.withColumn("id", F.col("conv_id").cast("string")).join(named, "id")
    sinks.write_files(rows.select(F.col("path").alias("file"), F.lit("").alias("name"), F.col("markdown").alias("payload")), path, "text")
    return sinks.read_files(t.spark, path).select("file", "bytes", F.sha2("content", 256).alias("sha256"), "ok")


@query("""SELECT 'objects' AS name, CAST(doc_id AS VARCHAR) AS id, lang AS value FROM documents UNION ALL SELECT 'versions', CAST(doc_id AS VARCHAR) || ':v' || r, lang FROM documents, (VALUES (1), (2)) v(r)
 UNION ALL SELECT 'relations', CAST(doc_id AS VARCHAR), 'related_to' FROM documents UNION ALL SELECT 'operations', CAST(doc_id AS VARCHAR), 'create' FROM documents UNION ALL SELECT 'promotions', CAST(doc_id AS VARCHAR), 'memory' FROM documents""")
def package_files(t):
    """A package as five record files and a manifest, read again; a file that is not as written refuses it."""
    path, rows = folders.scratch(t.spark), bundle(t, F.lit(2))
    sinks.write_package(rows, path)
    schemas = {"objects": "id string, body string", "versions": "key string, body string", "relations": "id string, type string", "operations": "id string, operation string", "promotions": "id string, target string"}
    found, out = sinks.read_lines(t.spark, path, schemas), None
    for name, df in found.items():
        part = df.select(F.lit(name).alias("name"), F.col(df.columns[0]).alias("id"), F.col(df.columns[1]).alias("value"))
        out = part if out is None else out.union(part)
    return out


# --- restores, differences, imports that go on -----------------------------------

ORDINALS_SQL = "SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents"


def trees(t):
    """Documents of a source as nodes of a conversation: storage objects without and with the last two of each, and payloads by key."""
    place = F.row_number().over(objects.Window.partitionBy("source").orderBy("doc_id")) - 1
    n = F.count("*").over(objects.Window.partitionBy("source"))
    nodes = t.documents.select(F.col("source").alias("conversation_id"), place.cast("long").alias("ordinal"), F.col("doc_id").cast("string").alias("node_id"), F.concat_ws(":", "doc_id", "text").alias("payload"), n.alias("n"))
    old, new = objects.plan(nodes.where("ordinal < n - 2"), 8), objects.plan(nodes, 8)
    return old, new, nodes.select(F.concat(F.lit("node:"), F.sha2("payload", 256)).alias("key"), "payload")


def tops(plan):
    return plan.where("kind = 'manifest'").select("conversation_id", "key")


@query(f"""WITH o AS ({ORDINALS_SQL}) SELECT 'node' AS part, source AS id, k AS n, 'added' AS value FROM o WHERE k >= n - 2
 UNION ALL SELECT 'read', source, CASE WHEN n > 2 THEN 2 ELSE 1 END, 'manifest' FROM o WHERE k = 0
 UNION ALL SELECT 'read', source, (n - 1) // 8 - (n - 2) // 8 + 1 + CASE WHEN (n - 2) % 8 > 0 THEN 1 ELSE 0 END, 'chunk' FROM o WHERE k = 0""")
def tree_changes(t):
    """Two nodes appended to every conversation: what differs, and how many manifests and chunks were read for it."""
    old, new, _ = trees(t)
    changed, read, absent = objects.tree_difference(tops(old), tops(new), old.unionByName(new), 8)
    counts = read.groupBy("conversation_id", "level").agg(F.count("*").alias("n"))
    rows = changed.select(F.lit("node").alias("part"), F.col("conversation_id").alias("id"), L("ordinal", "n"), F.col("change").alias("value"))
    return rows.union(counts.select(F.lit("read"), "conversation_id", "n", "level")).union(absent.select(F.lit("absent"), "conversation_id", F.lit(1).cast("long"), "level"))


@query(f"""WITH o AS ({ORDINALS_SQL}), hurt AS (SELECT DISTINCT source FROM o WHERE doc_id % 50 = 7)
 SELECT 'node' AS part, source AS id, k AS n, sha256(doc_id || ':' || text) AS value FROM o WHERE source NOT IN (SELECT source FROM hurt) UNION ALL SELECT 'absent', source, 1, 'node:' || sha256(doc_id || ':' || text) FROM o WHERE doc_id % 50 = 7""")
def restored_conversations(t):
    """Conversations restored from their manifests; the payloads of some nodes are gone, and what misses one is told and left out."""
    _, new, payloads = trees(t)
    kept = payloads.where("cast(substring_index(payload, ':', 1) AS long) % 50 <> 7")
    nodes, absent = objects.restore(tops(new), new, kept, 8)
    rows = nodes.select(F.lit("node").alias("part"), F.col("conversation_id").alias("id"), L("ordinal", "n"), F.sha2("payload", 256).alias("value"))
    return rows.union(absent.select(F.lit("absent"), "conversation_id", F.lit(1).cast("long"), "key"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS line FROM documents)
 SELECT lang || '.jsonl' AS file, line, CASE WHEN doc_id % 11 = 3 THEN 'not JSON' WHEN doc_id % 11 = 5 THEN 'not an object' WHEN doc_id % 11 = 7 THEN 'does not fit the schema' END AS reason, CASE WHEN doc_id % 11 NOT IN (3, 5, 7) THEN doc_id END AS id FROM d WHERE doc_id % 11 <> 9""")
def line_imports(t):
    """Documents as JSON lines, some broken in three ways, some blank: good rows and refused lines with their numbers."""
    i, path = F.col("doc_id"), folders.scratch(t.spark)
    good = F.to_json(F.struct(i.alias("id"), "text"))
    line = F.when(i % 11 == 3, F.concat(F.lit("{"), good)).when(i % 11 == 5, "[1, 2]").when(i % 11 == 7, '{"id": {"a": 1}}').when(i % 11 == 9, "  ").otherwise(good)
    sinks.write_files(t.documents.select(F.concat("lang", F.lit(".jsonl")).alias("file"), F.lpad(i.cast("string"), 12, "0").alias("name"), line.alias("payload")), path, "lines", in_order=True)
    rows, bad = archives.json_lines(t.spark, f"{path}/{sinks.manifest(t.spark, path)['folder']}/files", "id long, text string", parts=True)
    file = F.substring_index("file", "/", -1).alias("file")
    return rows.select(file, "line", F.lit(None).cast("string").alias("reason"), "id").union(bad.select(file, "line", "reason", F.lit(None).cast("long")))


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT 'a' || conv_id % 3 || '.zip' AS path, 'c' || conv_id || '/raw.json' AS name, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE 0 END AS position, CASE conv_id % 4 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no mapping' ELSE 'no id' END AS reason FROM c WHERE conv_id % 4 < 3
 UNION ALL SELECT 'a' || conv_id || '.zip', '../x/raw.json', NULL, 'unsafe name' FROM c WHERE conv_id < 3""")
def import_rejections(t):
    """Conversations in archives, three of four damaged in one of three ways; every loss is told with its file and reason."""
    i = F.col("conv_id")
    name = F.concat(F.lit("c"), i.cast("string"), F.lit("/raw.json"))
    text = F.when(i % 4 == 0, "{").when(i % 4 == 1, '{"id": "x"}').when(i % 4 == 2, '{"mapping": {}}').otherwise('{"id": "x", "mapping": {}}')
    convs = t.conversations.select("conv_id").distinct()
    rows = convs.select(F.concat(F.lit("a"), (i % 3).cast("string"), F.lit(".zip")).alias("a"), name.alias("n"), text.alias("p"))
    bad = convs.where("conv_id < 3").select(F.concat(F.lit("a"), i.cast("string"), F.lit(".zip")), F.lit("../x/raw.json"), F.lit("{}"))
    return archives.rejected(archives.entries(archives.packed(rows.union(bad), "a", "n", "p")))


def paged(t, folder, by, rounds):
    """Items of a paged source streamed into a table; each round reads the pages that are there by then, and goes on where the one before ended."""
    t.spark.dataSource.register(PagedSource)
    out, size = folders.scratch(t.spark), 50
    for most in rounds:
        path = folders.scratch(t.spark)
        rows = t.documents.where(F.col("doc_id") < most) if most is not None else t.documents
        page = F.format_string("page-%05d.jsonl", F.call_function("div", F.col("doc_id"), F.lit(size)))  # longer numbers stay whole
        sinks.write_files(rows.select(page.alias("file"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), F.concat(F.to_json(F.struct("doc_id", "lang")), F.lit("\n")).alias("payload")), path)
        at = f"{path}/{sinks.manifest(t.spark, path)['folder']}/files"
        source = t.spark.readStream.format("paged").option("fetch", f"palimpsest.sources.paged:stored_{by}s").option("by", by).option("at", at).option("limit", 30).option("pages", 1_000_000).load()
        source.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").select("position", F.get_json_object("item", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("item", "$.lang").alias("lang"))


PAGED_SQL = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, lang FROM documents"


@query(PAGED_SQL)
def offset_stream(t):
    """Offset pages as a stream that is stopped after 175 items and goes on when there are more."""
    return paged(t, "o", "offset", (175, None))


@query(PAGED_SQL)
def cursor_stream(t):
    """Cursor pages as a stream; the last page of the first run grows before the second."""
    return paged(t, "c", "cursor", (175, None))


# --- jobs as a stream ------------------------------------------------------------

KIND_SQL = "CASE event_type WHEN 'view' THEN 'found' WHEN 'click' THEN 'saved' WHEN 'purchase' THEN 'asset' WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'indexed' WHEN 1 THEN 'exported' ELSE 'finished' END ELSE CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'resumed' END END"
WEEK = 7 * 24 * 3600 * 1000


@query(f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms, {KIND_SQL} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
r AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS at_ms, CAST(0 AS BIGINT) AS seq, 'indexing' AS phase, '' AS before, CAST(0 AS BIGINT) AS found, CAST(0 AS BIGINT) AS saved, CAST(0 AS BIGINT) AS assets, CAST(0 AS BIGINT) AS ignored, CAST(0 AS BIGINT) AS pending, CAST(-1 AS BIGINT) AS told, CAST(NULL AS VARCHAR) AS reason FROM events
  UNION ALL
  SELECT user_id, k, at_ms, seq, next, CASE WHEN next = 'failed' AND phase <> 'failed' THEN phase ELSE before END, found + (f AND kind = 'found')::BIGINT, saved + (f AND kind = 'saved')::BIGINT, assets + (f AND kind = 'asset')::BIGINT,
    ignored + (NOT f AND next = phase)::BIGINT, CASE WHEN why IS NULL THEN pending + f::BIGINT ELSE 0 END, CASE WHEN why IS NULL THEN told ELSE at_ms END, why
  FROM (SELECT *, CASE WHEN next <> phase THEN kind WHEN f AND pending + 1 >= 3 THEN 'items' WHEN f AND at_ms - told >= {WEEK} THEN 'time' END AS why FROM (
    SELECT r.user_id, e.k, e.at_ms, e.event_id AS seq, e.kind, r.phase, r.before, r.found, r.saved, r.assets, r.ignored, r.pending, CASE WHEN r.told < 0 THEN e.at_ms ELSE r.told END AS told,
      (phase = 'indexing' AND kind = 'found') OR (phase = 'exporting' AND kind = 'saved') OR (phase = 'assets' AND kind = 'asset') AS f,
      CASE WHEN kind = 'failed' AND phase NOT IN ('failed', 'done') THEN 'failed' WHEN kind = 'resumed' AND phase = 'failed' THEN before WHEN phase = 'indexing' AND kind = 'indexed' THEN 'exporting'
        WHEN phase = 'exporting' AND kind = 'exported' THEN 'assets' WHEN phase = 'assets' AND kind = 'finished' THEN 'done' ELSE phase END AS next
    FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)))
SELECT CAST(user_id AS VARCHAR) AS job_id, at_ms, seq, phase, reason, found, saved, assets, ignored FROM r WHERE reason IS NOT NULL""")
def job_transitions(t):
    """Events of users as jobs of a state machine in the state store: every transition, and a row for each three items or week."""
    base = folders.scratch(t.spark)
    rows = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    rows = rows.select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.expr(KIND_SQL).alias("kind"))
    jobs.drained(jobs.transitions(rows, 3, WEEK), base).awaitTermination()
    return t.spark.read.schema(jobs.OUTPUT).parquet(f"{base}/rows")


# --- a stored index ----------------------------------------------------------------


def indexed(t):
    """An index of all turns built in two deltas, after which every seventh turn has another text, and every fifth is taken out."""
    store, number = folders.scratch(t.spark), F.col("conv_id") * 31 + F.col("turn")
    rows = messages(t)
    index.add(t.spark, store, rows.where("turn = 0").select("key", "text"))
    index.add(t.spark, store, rows.where("turn > 0").select("key", "text"))
    index.add(t.spark, store, rows.where(number % 7 == 3).select("key", F.lit("The new text, and more").alias("text")))
    index.remove(t.spark, store, rows.where(number % 5 == 2).select("key"))
    return store


INDEX_SQL = f"""SELECT concat_ws(':', conv_id, turn) AS key FROM conversations WHERE (conv_id * 31 + turn) % 5 <> 2
 AND CASE WHEN (conv_id * 31 + turn) % 7 = 3 THEN true ELSE list_contains({WORDS_SQL}, 'the') AND list_contains({WORDS_SQL}, 'and') END"""


@query(INDEX_SQL)
def index_lookup(t):
    """Turns that hold both words, by a stored index of which only the words' buckets are read."""
    return index.holding_all(t.spark, indexed(t), "the and")


@query(INDEX_SQL)
def index_compacted(t):
    """The same after the deltas were merged."""
    store = indexed(t)
    index.compact(t.spark, store)
    return index.holding_all(t.spark, store, "the and")


# --- packages by every rule, stored assets -----------------------------------------


def damaged(t):
    """A package of all documents in which each rule is broken by some of them."""
    i = F.col("doc_id")
    n = i.cast("string")
    form = lambda name, bad: F.when(bad, "other").otherwise(packages.FORMATS[name]).alias("format")
    one = F.lit(1).alias("schema_version")
    base = t.documents.select(n.alias("id"), F.col("source").alias("project_id"), F.when(i % 13 == 0, "").otherwise(F.col("lang")).alias("title"), "text", F.lit(1).alias("revision"), "doc_id")
    hashed = base.withColumn("digest", packages.content_digest("id", "project_id", "title", "text", "revision"))
    bad = F.when(i % 11 == 0, F.concat("digest", F.lit("x"))).otherwise(F.col("digest"))
    cited = F.array(T.content_uri(n, F.when(i % 5 == 0, 9).otherwise(1).cast("string"), F.when(i % 7 == 0, "sha256:no").otherwise(F.col("digest"))))
    things = hashed.select("id", "project_id", "title", "text", "revision", bad.alias("digest"), form("objects", i % 17 == 0), F.when(i % 19 == 0, 2).otherwise(1).alias("schema_version"), cited.alias("evidence_uris"))
    versions = hashed.select(F.concat(n, F.lit(":v1")).alias("key"), n.alias("object_id"), "title", "revision", "digest", form("versions", F.lit(False)), one)
    none = F.lit(None).cast("string")
    relations = t.documents.select(F.when(i % 23 != 0, n).alias("id"), form("relations", F.lit(False)), one, none.alias("evidence_uri"))
    operations = t.documents.select(F.call_function("div", i, F.lit(2)).cast("string").alias("id"), form("operations", F.lit(False)), one)
    promotions = t.documents.select(n.alias("id"), form("promotions", F.lit(False)), one, none.alias("source_evidence_uri"))
    return {"objects": things, "versions": versions, "relations": relations, "operations": operations, "promotions": promotions}


@query("""SELECT code, CAST(count(*) AS BIGINT) AS items FROM (
 SELECT unnest([CASE WHEN doc_id % 13 = 0 THEN 'INVALID_CONTENT_OBJECT' END, CASE WHEN doc_id % 13 = 0 THEN 'INVALID_VERSION_SNAPSHOT' END, CASE WHEN doc_id % 19 = 0 THEN 'INVALID_CONTENT_OBJECT' END, CASE WHEN doc_id % 11 = 0 THEN 'CONTENT_HASH_MISMATCH' END,
  CASE WHEN doc_id % 17 = 0 THEN 'FORMAT_MISMATCH' END, CASE WHEN doc_id % 19 = 0 THEN 'SCHEMA_VERSION_MISMATCH' END, CASE WHEN doc_id % 23 = 0 THEN 'MISSING_KEY' END, CASE WHEN doc_id % 5 = 0 THEN 'EXTERNAL_CONTENT_EVIDENCE' END, CASE WHEN doc_id % 7 = 0 AND doc_id % 5 > 0 THEN 'EVIDENCE_HASH_MISMATCH' END]) AS code FROM documents
 UNION ALL SELECT 'DUPLICATE_KEY' FROM documents GROUP BY doc_id // 2 HAVING count(*) > 1
 UNION ALL SELECT unnest(['PACKAGE_FORMAT_MISMATCH', 'PAYLOAD_HASH_MISMATCH', 'PACKAGE_ID_MISMATCH', 'COUNT_MISMATCH']) UNION ALL SELECT 'SCOPE_UNBOUND_MISMATCH' FROM documents) WHERE code IS NOT NULL GROUP BY code""")
def package_records(t):
    """How often each rule is broken, by records, citations and what stands beside them."""
    rows = damaged(t)
    told = packages.envelope(rows) | {"format": "x", "payload_hash": "0", "package_id": "capture-package:1", "unbound": True}
    told["counts"] = told["counts"] | {"promotions": -1}
    found = packages.record_issues(rows, ["id", "project_id", "title", "text", "revision"]).union(packages.envelope_issues(told, rows))
    return found.groupBy("code").agg(F.count("*").alias("items"))


@query("""SELECT doc_id AS key, lang AS file_name, CASE WHEN doc_id % 3 > 0 THEN 'e' || doc_id || '|' || CASE WHEN doc_id % 2 = 0 THEN 'success' ELSE 'failed' END || '|x Bearer <redacted> <redacted-url> y|' || CASE WHEN doc_id % 2 = 0 THEN '200.0' ELSE '' END || '|a.example.org:80' END AS diagnostics FROM documents""")
def stored_asset_records(t):
    """Asset records with fields, tokens and addresses that are not to be kept."""
    i = F.col("doc_id")
    attempt = F.struct(F.lit("sign").alias("label"), F.when(i % 2 == 0, "success").otherwise("odd").alias("result"), F.when(i % 2 == 0, "200").otherwise("n/a").alias("status"), F.lit("x Bearer abc.def https://a.example.org/p?q=1 y").alias("message"))
    about = F.struct(F.concat(F.lit("e"), i.cast("string")).alias("signing_endpoint"), F.array(attempt).alias("signing_attempts"), F.lit("7").alias("binary_status"), F.lit("a.exa_mple.org:80/").alias("download_host"))
    rows = web.stored_assets(t.documents.select(i.alias("key"), F.col("lang").alias("file_name"), F.lit("https://secret").alias("download_url"), F.when(i % 3 > 0, about).alias("diagnostics")))
    d = F.col("diagnostics")
    a = d["signing_attempts"][0]
    text = F.concat_ws("|", d["signing_endpoint"], a["result"], a["message"], F.coalesce(a["status"].cast("string"), F.lit("")), d["download_host"])
    return rows.select("key", "file_name", F.when(d.isNotNull(), text).alias("diagnostics"), *(F.col(c) for c in rows.columns if c not in ("key", "file_name", "diagnostics")))


# --- answers of receivers ----------------------------------------------------------


def answered(t):
    """Documents as cases: answer keys and answers that miss a decision, name one too many, cite what is not there, or leave out blockers."""
    i = F.col("doc_id")
    none, texts = F.array().cast("array<string>"), lambda *x: F.array(*map(F.lit, x))
    record = lambda id_, title: F.struct(id_.alias("id"), title.alias("title"), F.lit("active").alias("status"), F.lit("high").alias("priority"))
    one, odd = record(F.lit("d1"), F.col("lang")), record(F.lit("zz"), F.lit("invented"))
    no_records = F.filter(F.array(one), lambda _: F.lit(False))
    base = {"project_title": F.lit("The Project"), "summary": F.lit(None).cast("string"), "phase": F.col("lang"), "progress": F.lit(5.0), "tasks": F.array(one), "next_actions": none}
    key = base | {"project_id": F.col("source"), "health": F.lit("good"), "decisions": F.array(one, record(F.lit("d2"), F.lit("second"))), "blockers": texts("wait for the review"), "evidence": texts("u1")}
    answer = base | {
        "project_id": F.when(i % 11 == 0, "other").otherwise(F.col("source")), "health": F.when(i % 4 == 0, "Good ").otherwise("bad"), "decisions": F.when(i % 5 == 0, F.array(one, odd)).when(i % 2 == 0, F.array(one)).otherwise(key["decisions"]),
        "blockers": F.when(i % 3 == 0, texts("Wait for the  review")).otherwise(none), "evidence": F.when(i % 7 == 0, texts("u9")).otherwise(texts("u1")),
    }
    rows = lambda cols, docs: docs.select(i.alias("case"), *(c.alias(n) for n, c in cols.items()))
    return rows(key | {"tasks": no_records}, t.documents), rows(answer | {"tasks": no_records}, t.documents.where(i % 13 > 0)), t.spark.createDataFrame([("u1",)], "uri string")


EVALUATED_SQL = """SELECT *, CASE WHEN len(critical) > 0 THEN 'FAIL' WHEN score >= 85 THEN 'PASS' WHEN score >= 65 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM (
 SELECT *, round(identity + status + decisions + tasks + actions + evidence, 2) AS score FROM (SELECT doc_id AS "case",
 CASE WHEN doc_id % 13 = 0 THEN 0.0 WHEN doc_id % 11 = 0 THEN 5.0 ELSE 10.0 END AS identity, CASE WHEN doc_id % 13 = 0 THEN 5.0 WHEN doc_id % 4 = 0 THEN 20.0 ELSE 15.0 END AS status,
 CASE WHEN doc_id % 13 = 0 THEN 0.0 WHEN doc_id % 5 = 0 OR doc_id % 2 = 0 THEN 10.0 ELSE 20.0 END AS decisions, 20.0 AS tasks, 7.5 + CASE WHEN doc_id % 13 > 0 AND doc_id % 3 = 0 THEN 7.5 ELSE 0.0 END AS actions,
 CASE WHEN doc_id % 13 = 0 OR doc_id % 7 = 0 THEN 0.0 ELSE 15.0 END AS evidence,
 list_filter([CASE WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 THEN 'project' END, CASE WHEN doc_id % 13 > 0 AND doc_id % 5 = 0 THEN 'unsupported_decisions' END, CASE WHEN doc_id % 13 > 0 AND doc_id % 7 = 0 THEN 'invalid_evidence' END], lambda x: x IS NOT NULL) AS critical FROM documents))"""


@query(f"""SELECT "case", identity, status, decisions, tasks, actions, evidence, score, array_to_string(critical, ',') AS critical, verdict FROM ({EVALUATED_SQL})""")
def evaluated_answers(t):
    """Six dimensions, critical errors and the verdict of every answer; a case without an answer scores as an empty one."""
    return scoring.evaluated(*answered(t)).withColumn("critical", F.array_join("critical", ","))


@query(f"""SELECT handoff_id, CASE WHEN against <> '' THEN 'BLOCKED' WHEN verdict = 'PASS' AND len(critical) = 0 THEN 'VERIFIED_PASS' ELSE 'VERIFIED_FAIL' END AS status,
 CASE WHEN against <> '' THEN against ELSE concat_ws(',', CASE WHEN verdict <> 'PASS' THEN 'CONTINUITY_BENCHMARK_FAILED' END, CASE WHEN len(critical) > 0 THEN 'CRITICAL_CONTINUITY_ERROR' END) END AS failures, CASE WHEN against = '' THEN score END AS score
 FROM (SELECT "case" AS handoff_id, score, verdict, critical, concat_ws(',', CASE WHEN "case" % 17 = 0 THEN 'PREFLIGHT_NOT_PASSED' END, CASE WHEN "case" % 19 = 0 THEN 'VERIFICATION_KIT_INVALID' END, CASE WHEN "case" % 23 = 0 AND "case" % 19 > 0 THEN 'RECEIVER_PACKAGE_HASH_MISMATCH' END,
 CASE WHEN "case" % 29 = 0 THEN 'RECEIVER_PREFLIGHT_NOT_PASSED' END, CASE WHEN "case" % 31 = 0 THEN 'APPROVED_STATE_MUTATION_CLAIM' END) AS against FROM ({EVALUATED_SQL}))""")
def verified_handoffs(t):
    """Handoffs with their kits, receipts and evaluated answers: blocked, failed or verified."""
    i, one = F.col("doc_id"), F.lit("h")
    sent = t.documents.select(i.alias("handoff_id"), one.alias("package_hash"), one.alias("payload_hash"), F.when(i % 17 == 0, "BLOCKED").otherwise("PASS").alias("preflight"))
    kits = t.documents.where(i % 19 > 0).select(i.alias("case"), i.alias("handoff_id"), F.when(i % 23 == 0, "x").otherwise("h").alias("package_hash"), one.alias("payload_hash"))
    told = t.documents.select(i.alias("case"), i.alias("handoff_id"), one.alias("package_hash"), F.when(i % 29 == 0, "BLOCKED").otherwise("PASS").alias("status"), (i % 31 == 0).alias("mutated"))
    found = versions.verified_answers(sent, kits, told, scoring.evaluated(*answered(t)))
    return found.select("handoff_id", "status", F.array_join("failures", ",").alias("failures"), "score")
