"""Registered queries of governance, providers, jobs, versions and the query surface, with their SQL.

Tables are read as in the catalogue: documents are objects of a project (source), events a log of jobs
and proposals by user, conversations messages, pages captured addresses.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import api
from palimpsest.functions import text as T
from palimpsest.operators import canonical, governance, integrity, jobs, providers, versions

from .catalogue import SCORE_SQL, L, query, raw

# --- governance ---------------------------------------------------------------


@query("""SELECT project_id, coalesce(nullif(t, ''), project_id) AS title, greatest(0, floor(v)::BIGINT) AS version, nullif(h, '') AS hash, sid, rt FROM (
 SELECT CAST(doc_id AS VARCHAR) AS project_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS t, doc_id % 7 - 2.5 AS v, CASE WHEN doc_id % 2 = 0 THEN 'h' || doc_id ELSE '' END AS h,
  CASE WHEN doc_id % 4 = 0 THEN 'supersession-1' ELSE 's-' || doc_id END AS sid, CASE WHEN doc_id % 5 = 0 THEN 'task' ELSE 'decision' END AS rt FROM documents WHERE doc_id % 11 <> 0)""")
def state_records(t):
    i = F.col("doc_id")
    rows = t.documents.select(
        F.when(i % 11 == 0, " ").otherwise(i.cast("string")).alias("project_id"), F.when(i % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "lang")).alias("title"), ((i % 7) - 2.5).cast("double").alias("version"), F.when(i % 2 == 0, F.concat(F.lit("h"), i.cast("string"))).alias("hash"),
        F.array(F.struct(F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("s/"), i.cast("string"))).alias("id"), F.when(i % 5 == 0, "task").otherwise("note").alias("record_type"), F.lit("t").alias("target_id"), F.lit("r").alias("reason"))).alias("supersessions"),
    )
    return governance.states(rows).select("project_id", "title", "version", "hash", F.col("supersessions")[0]["id"].alias("sid"), F.col("supersessions")[0]["record_type"].alias("rt"))


@query("""SELECT doc_id, sha256('{"a":[{"c":2}],"id":' || doc_id || ',"lang":"' || lang || '"}') AS digest FROM documents""")
def stable_digests(t):
    """Keys in any order, and the hash itself at two levels, do not change the digest."""
    text = F.concat(F.lit('{"lang": "'), "lang", F.lit('", "stateHash": "x", "id": '), F.col("doc_id").cast("string"), F.lit(', "a": [{"stateHash": 1, "c": 2}]}'))
    return governance.stable_digest(t.documents.select("doc_id", text.alias("digest")), "digest", ("stateHash",))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'status' WHEN 1 THEN 'decision:' || user_id WHEN 2 THEN 'task:' || user_id ELSE 'task:' || user_id || CASE WHEN event_id % 8 = 3 THEN ',task:' || event_id ELSE '' END END AS keys FROM events""")
def touched_keys(t):
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("project_status", "decision", "task", "supersede"))), (i % 4 + 1).cast("int"))
    keys = governance.touched(kind, F.col("user_id").cast("string"), F.lit("task"), F.col("user_id").cast("string"), F.when(i % 8 == 3, i.cast("string")))
    return t.events.select("event_id", F.array_join(keys, ",").alias("keys"))


def proposed(t):
    """Events as proposals of their user's state, which every third user has at version user_id % 4."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = t.events.select(e.alias("id"), u.alias("project_id"), F.when(e % 5 == 0, "approved").when(e % 7 == 0, "rejected").otherwise("pending").alias("status"), F.when(u % 3 == 0, u % 4).otherwise(e % 2).alias("base_version"), F.when(u % 3 == 0, F.concat(F.lit("h"), u.cast("string"))).alias("base_hash"), F.col("ts").alias("created_at"))
    current = t.events.where("user_id % 3 = 0").select(u.alias("project_id")).distinct().withColumn("version", F.col("project_id") % 4).withColumn("hash", F.concat(F.lit("h"), F.col("project_id").cast("string")))
    return rows, current


def approved(t):
    rows, current = proposed(t)
    return governance.approvals(rows, current, rows.where("id % 11 = 0").select("id"))


APPROVAL_SQL = """SELECT id, project_id, from_version, CASE WHEN outcome = 'approved' AND row_number() OVER (PARTITION BY project_id, outcome ORDER BY ts, id) > 1 THEN 'refused:state_changed' ELSE outcome END AS outcome FROM (
 SELECT event_id AS id, user_id AS project_id, ts, CASE WHEN user_id % 3 = 0 THEN user_id % 4 ELSE 0 END AS from_version,
 CASE WHEN event_id % 5 = 0 THEN 'refused:already_approved' WHEN event_id % 7 = 0 THEN 'refused:already_rejected' WHEN event_id % 11 = 0 THEN 'refused:conflict' WHEN user_id % 3 <> 0 AND event_id % 2 = 1 THEN 'refused:state_changed' ELSE 'approved' END AS outcome FROM events)"""


@query(f"SELECT id, project_id, outcome, from_version, CASE WHEN outcome = 'approved' THEN from_version + 1 END AS to_version FROM ({APPROVAL_SQL})")
def proposal_approvals(t):
    return approved(t)


@query(f"SELECT action, count(*) AS n, CAST(sum(version) AS BIGINT) AS versions FROM (SELECT 'approved' AS action, from_version + 1 AS version FROM ({APPROVAL_SQL}) WHERE outcome = 'approved' UNION ALL SELECT 'initial', 0 FROM ({APPROVAL_SQL}) WHERE outcome = 'approved' AND from_version = 0) GROUP BY action")
def approval_versions(t):
    return governance.approval_rows(approved(t)).groupBy("action").agg(F.count("*").alias("n"), F.sum("version").alias("versions"))


@query("SELECT i AS id, CASE WHEN i < 0 THEN 'not_found' WHEN i % 5 = 0 THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN i < 0 OR i % 5 = 0 OR i % 7 = 0 THEN NULL ELSE 'proposal_rejected' END AS event FROM (SELECT event_id AS i FROM events WHERE event_id % 3 = 0 UNION ALL SELECT -1)")
def proposal_rejections(t):
    rows = proposed(t)[0]
    return governance.rejections(rows, rows.where("id % 3 = 0").select("id").union(rows.where("id = 0").select(F.lit(-1).cast("long"))))


@query("""SELECT source AS project_id, CASE WHEN n % 3 = 0 THEN 'refused:version_not_found' WHEN n % 3 = 1 THEN 'refused:already_current' ELSE 'restored' END AS outcome, CASE WHEN n % 3 = 2 THEN 3 END AS version, CASE WHEN n % 3 = 2 THEN 1 END AS restored_from, CASE WHEN n % 3 = 2 THEN 'h1' END AS hash FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def state_rollbacks(t):
    n = t.documents.groupBy(F.col("source").alias("project_id")).agg(F.count("*").alias("n"))
    targets = n.select("project_id", F.when(F.col("n") % 3 == 0, 9).when(F.col("n") % 3 == 1, 2).otherwise(1).cast("long").alias("target"))
    have = n.select("project_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("version")).withColumn("hash", F.concat(F.lit("h"), F.col("version").cast("string")))
    return governance.rollbacks(targets, n.select("project_id", F.lit(2).cast("long").alias("version")), have)


@query("""SELECT doc_id AS project_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'unchanged' WHEN doc_id % 5 = 0 THEN 'refused:state_changed' ELSE 'approved' END AS outcome,
 CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN (doc_id % 2 = 0 AND doc_id % 3 = 0) OR doc_id % 5 = 0 THEN 0 ELSE 1 END AS version FROM documents""")
def memory_approvals(t):
    d = t.documents.select(F.col("doc_id").alias("project_id"))
    i = F.col("project_id")
    candidates = d.select("project_id", F.when(i % 3 == 0, "same").otherwise("new").alias("hash"), F.when(i % 5 == 0, 7).otherwise(8).cast("long").alias("state_version"), F.lit("s").alias("state_hash"))
    profiles = d.where("project_id % 2 = 0").select("project_id", F.lit(4).cast("long").alias("version"), F.lit("same").alias("hash"))
    return governance.memory_approvals(candidates, profiles, d.select("project_id", F.lit(8).cast("long").alias("version"), F.lit("s").alias("hash")))


CONFIG_SQL = """SELECT project_id, version, policy, target, token_budget, sha256(concat_ws(chr(10), project_id, version, policy, target, token_budget)) AS hash FROM (SELECT doc_id AS project_id, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 1 END AS version, CASE doc_id % 3 WHEN 0 THEN 'broad' ELSE 'balanced' END AS policy,
 CASE doc_id % 4 WHEN 0 THEN 'external' ELSE 'internal' END AS target, CASE WHEN doc_id % 5 = 0 THEN 2048 ELSE greatest(128, n_chars) END AS token_budget FROM documents)"""


def configured(t):
    i = F.col("doc_id")
    rows = t.documents.select(i.alias("project_id"), F.when(i % 3 == 0, "broad").otherwise("odd").alias("policy"), F.when(i % 4 == 0, "external").otherwise("odd").alias("target"), F.when(i % 5 == 0, "many").otherwise(F.col("n_chars").cast("string")).alias("token_budget"))
    return rows, t.documents.where("doc_id % 2 = 0").select(i.alias("project_id"), F.explode(F.array(*map(F.lit, (1, 3, 2)))).alias("version"))


@query(CONFIG_SQL)
def gate_configurations(t):
    return governance.configurations(*configured(t))


@query(f"SELECT *, 'run-' || project_id AS from_run FROM ({CONFIG_SQL}) WHERE project_id % 9 = 0")
def gate_configuration_restores(t):
    rows, existing = configured(t)
    return governance.restored_configuration(rows.where("project_id % 9 = 0").withColumn("id", F.concat(F.lit("run-"), F.col("project_id").cast("string"))), existing)


@query("SELECT user_id AS id, event_id, CASE WHEN user_id % 4 = 0 OR row_number() OVER (PARTITION BY user_id ORDER BY ts) > 1 THEN 'refused:exists' ELSE 'added' END AS outcome FROM events")
def run_receipts(t):
    rows = t.events.select(F.col("user_id").alias("id"), "event_id", F.col("ts").alias("created_at"))
    return governance.receipts(rows.where("id % 4 = 0").select("id"), rows).select("id", "event_id", "outcome")


@query("SELECT user_id, row_number() OVER (ORDER BY ts, event_id) AS version FROM events WHERE user_id = 8 ORDER BY version DESC")
def memory_versions(t):
    from pyspark.sql import Window

    rows = t.events.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("version"))
    return governance.versions_of(rows, "user_id", 8)


@query("SELECT min(source) AS project_id FROM documents WHERE contains(lower(source), 'rc1')")
def state_lookup(t):
    rows = t.documents.select(F.col("source").alias("project_id"), F.initcap("source").alias("title")).distinct()
    return governance.found_state(rows, " RC1 ").select("project_id")


@query("SELECT source AS project_id, count(*) FILTER (doc_id % 3 = 0) AS included, count(*) FILTER (doc_id % 3 = 1) AS excluded, count(*) FILTER (doc_id % 3 = 2) AS review, CAST(coalesce(sum(n_chars) FILTER (doc_id % 3 = 0), 0) AS BIGINT) AS used_tokens FROM documents GROUP BY source")
def gate_manifests(t):
    return governance.manifest(reported(t))


def reported(t, project=None):
    verdict = F.element_at(F.array(*map(F.lit, ("INCLUDE", "EXCLUDE", "REVIEW"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.documents.select((F.col("source") if project is None else project).alias("project_id"), F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), F.col("lang").alias("text"), verdict.alias("decision"), F.lit("CODE").alias("reason"), F.col("n_chars").alias("tokens"))


@query("""SELECT project_id, '# ' || project_id || chr(10) || chr(10) || '- Token budget: 2048' || chr(10) || '- Used: ' || CAST(coalesce(sum(n_chars) FILTER (doc_id % 3 = 0), 0) AS BIGINT) || chr(10) || chr(10) || '## Included' || chr(10) || chr(10) ||
 coalesce(string_agg('### ' || doc_id || chr(10) || chr(10) || lang, chr(10) || chr(10) ORDER BY doc_id) FILTER (doc_id % 3 = 0), '- None') || chr(10) || chr(10) || '## Review' || chr(10) || chr(10) || coalesce(string_agg('- ' || doc_id || ': CODE', chr(10) ORDER BY doc_id) FILTER (doc_id % 3 = 2), '- None')
 || chr(10) || chr(10) || '## Excluded' || chr(10) || chr(10) || coalesce(string_agg('- ' || doc_id || ': CODE', chr(10) ORDER BY doc_id) FILTER (doc_id % 3 = 1), '- None') || chr(10) AS markdown FROM (SELECT *, source || '-' || doc_id // 1000 AS project_id FROM documents) GROUP BY project_id""")
def gate_markdown(t):
    """A report for each source and thousand documents."""
    return governance.gate_markdown(reported(t, F.concat_ws("-", "source", F.call_function("div", F.col("doc_id"), F.lit(1000)).cast("string"))), 2048)


# --- providers ----------------------------------------------------------------


@query("SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN 'graph' WHEN conv_id % 3 = 1 THEN 'messages' ELSE 'unknown' END AS shape, count(*) AS messages FROM conversations WHERE conv_id % 3 < 2 GROUP BY conv_id")
def provider_dispatch(t):
    """Two readers, one for graphs and one for message lists; what is neither is left out."""
    linear = canonical.raw_of(t.conversations.where("conv_id % 3 = 0")).select("conv_id", "raw", F.lit("any").alias("provider"))
    texts = t.conversations.where("conv_id % 3 > 0").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("messages"))
    lists = texts.select("conv_id", F.when(F.col("conv_id") % 3 == 1, F.to_json(F.struct("messages"))).otherwise("{}").alias("raw"), F.lit("any").alias("provider"))
    count = lambda name, path: lambda df: df.select(F.col("conv_id").alias("id"), F.lit(name).alias("shape"), L(F.size(path), "messages"))
    graph = F.json_object_keys(F.get_json_object("raw", "$.mapping"))
    return providers.dispatched(linear.union(lists), {"graph": count("graph", graph), "messages": count("messages", F.from_json(F.get_json_object("raw", "$.messages"), "array<string>"))})


HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"
PATH_SQL = "coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/')"


@query(f"SELECT page_id, coalesce(CASE WHEN suffix(h, '.net') THEN regexp_matches(p, '^/en(/|$)') WHEN suffix(h, '.org') THEN h = 'blog.example.org' OR regexp_matches(p, '^/(fr|de)/') WHEN suffix(h, '.com') THEN true END, false) AS conversation, nullif(regexp_extract(url || '/c/' || page_id, '/c/([^/?#]+)', 1), '') AS conversation_id FROM (SELECT page_id, url, {HOST_SQL} AS h, {PATH_SQL} AS p FROM pages)")
def conversation_addresses(t):
    from palimpsest.operators.web import provider

    who = provider(F.col("url"), {"example.net": "net", "example.org": "org", "example.com": "com"})
    shapes = [("net", None, "^/en(?:/|$)"), ("org", "blog.example.org", "^/(?:fr|de)/")]
    return t.pages.select("page_id", providers.is_conversation(F.col("url"), who, shapes).alias("conversation"), providers.conversation_id(F.concat("url", F.lit("/c/"), F.col("page_id").cast("string"))).alias("conversation_id"))


@query("SELECT page_id, coalesce(level, 'unsupported') AS level, coalesce(level IN ('verified', 'experimental', 'visible-only'), false) AS supported FROM (SELECT page_id, page_id % 5 AS p FROM pages) LEFT JOIN (VALUES (0, 'verified'), (1, 'planned'), (2, 'experimental')) d(k, level) ON p = k")
def provider_capabilities(t):
    levels = t.spark.createDataFrame([("p0", "search", "verified"), ("p1", "search", "planned"), ("p2", "search", "experimental")], "provider string, capability string, level string")
    rows = t.pages.select("page_id", F.concat(F.lit("p"), (F.col("page_id") % 5).cast("string")).alias("provider"), F.lit("search").alias("capability"))
    return providers.supports(rows, levels).select("page_id", "level", "supported")


@query("SELECT 'p' || doc_id AS project_id, CASE WHEN doc_id % 4 = 3 THEN 'untitled project' ELSE lang END AS title, CASE WHEN doc_id % 3 = 1 THEN 'w' END AS workspace_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n_files FROM documents WHERE doc_id % 7 <> 0")
def project_entries(t):
    i = F.col("doc_id")
    core = F.concat(F.lit('{"id": "'), F.when(i % 7 != 0, F.concat(F.lit("p"), i.cast("string"))).otherwise(" "), F.lit('", "display": {'), F.when(i % 4 != 3, F.concat(F.lit('"name": " '), "lang", F.lit('"'))).otherwise(""), F.lit("}"), F.when(i % 3 == 0, ', "files": [{"id": "a"}, {"id": "b"}]').otherwise(""), F.lit("}"))
    raw_ = F.when(i % 3 == 0, core).when(i % 3 == 1, F.concat(F.lit('{"workspace_id": "w", "gizmo": '), core, F.lit("}"))).otherwise(F.concat(F.lit('{"gizmo": {"gizmo": '), core, F.lit("}}")))
    return providers.project_metadata(t.documents.select(raw_.alias("raw"))).select("project_id", "title", "workspace_id", "n_files")


@query("SELECT doc_id AS project_id, k AS position, 'file-' || doc_id || k AS file_id, CASE WHEN k = 0 THEN 'n' END AS name, CASE WHEN k = 1 THEN 'text/plain' END AS mime FROM documents, (VALUES (0), (1)) v(k)")
def project_files(t):
    i = F.col("doc_id").cast("string")
    files = F.concat(F.lit('[{"file_id": "file-'), i, F.lit('0", "name": "n"}, {"file": {"id": "file-'), i, F.lit('1", "mime_type": "text/plain"}}, {"name": "no id"}]'))
    return providers.project_files(t.documents.select(F.col("doc_id").alias("project_id"), files.alias("files")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'https://x/' || doc_id END AS url, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS file_name, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS size_bytes, CASE WHEN doc_id % 3 = 2 THEN 'no download address' END AS error FROM documents")
def signed_assets(t):
    i = F.col("doc_id")
    field = F.when(i % 3 == 0, "download_url").when(i % 3 == 1, "url").otherwise("other")
    raw_ = F.concat(F.lit('{"'), field, F.lit('": "https://x/'), i.cast("string"), F.lit('", "size": '), F.when(i % 5 == 0, '"many"').otherwise(F.col("n_chars").cast("string")), F.when(i % 2 == 0, F.concat(F.lit(', "filename": "'), "lang", F.lit('"'))).otherwise(""), F.lit("}"))
    return providers.signed_asset(t.documents.select("doc_id", "source", raw_.alias("raw")), name="source").select("doc_id", "url", "file_name", "size_bytes", "error")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN turn WHEN turn % 3 = 1 THEN conv_id END AS ordinal FROM conversations")
def turn_ordinals(t):
    n = lambda c: F.col(c).cast("string")
    name = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("conversation-turn-"), n("turn"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(" Turn:"), n("conv_id"), F.lit("-x"))).otherwise(F.concat(F.lit("row-"), n("turn")))
    return t.conversations.select("conv_id", "turn", providers.turn_ordinal(name).alias("ordinal"))


@query("SELECT CAST(conv_id AS VARCHAR) AS conversation_id, count(*) AS message_nodes, true AS root_reached, 0 AS parent_breaks, false AS cycle FROM conversations GROUP BY conv_id")
def raw_traces(t):
    r = raw(t)
    return providers.raw_trace(canonical.nodes(r), canonical.heads(r))


# --- branching graphs ----------------------------------------------------------

# Messages of the answer by doc_id % 8: JSON without its id, and the role, class, parts and text that come of it.
ANSWERS = [
    ('"author":{"role":"assistant"},"content":{"content_type":"text","parts":["x",{"content_type":"code","text":"y"}]}', "assistant", "assistant_final", "text,code", "x|y"),
    ('"author":{"role":"assistant"},"channel":"analysis","content":{"content_type":"text","parts":["x"]}', "assistant", "reasoning", "reasoning_summary", "x"),
    ('"author":{"role":"assistant"},"recipient":"browser","content":{"content_type":"text","parts":["x"]}', "assistant", "tool_call", "tool_call", "x"),
    ('"author":{"role":"assistant"},"status":"in_progress","content":{"content_type":"text","parts":["x"]}', "assistant", "assistant_intermediate", "text", "x"),
    ('"author":{"role":"tool"},"content":{"content_type":"text","parts":["x"]}', "tool", "tool_result", "tool_result", "x"),
    ('"author":{"role":"assistant"},"content":{"content_type":"execution_output","text":"x"}', "assistant", "tool_result", "tool_result", "x"),
    ('"author":{"role":"user"},"metadata":{"is_voice":true},"content":{"content_type":"text","transcript":"x"}', "user", "user_voice_transcript", "text", "x"),
    ('"author":{"role":"developer"},"content":{"content_type":"text","parts":[{"content_type":"some_widget","text":"x"}]}', "system", "developer", "unknown", "x"),
]


def forked(t):
    """A raw graph for each document: a silent top, two questions below it, three answers below the first, one of them current; every tenth breaks off above its questions."""
    i = F.col("doc_id").cast("string")
    answer = F.element_at(F.array(*(F.lit(a[0]) for a in ANSWERS)), (F.col("doc_id") % 8 + 1).cast("int"))
    say = lambda node, parent, body: F.concat(F.lit(f'"{node}":{{"parent":'), parent, F.lit(f',"children":[],"message":{{"id":"{node}-'), i, F.lit('",'), body, F.lit("}}"))
    other = F.lit('"author":{"role":"assistant"},"content":{"content_type":"text","parts":["z"]}')
    ask = F.lit('"author":{"role":"user"},"content":{"content_type":"text","parts":["q"]}')
    top = F.when(F.col("doc_id") % 10 == 0, '"nowhere"').otherwise('"top"')
    nodes = [F.lit('"top":{"parent":null,"children":[],"message":null}'), say("ask", top, ask), say("ask2", top, ask), say("left", F.lit('"ask"'), other), say("mid", F.lit('"ask"'), answer), say("right", F.lit('"ask"'), other)]
    return t.documents.select("doc_id", F.concat(F.lit('{"id":"d'), i, F.lit('","title":"t","current_node":"mid","mapping":{'), F.concat_ws(",", *nodes), F.lit("}}")).alias("raw"))


def by_answer(k: int) -> str:
    return "CASE doc_id % 8 " + " ".join(f"WHEN {n} THEN '{a[k]}'" for n, a in enumerate(ANSWERS)) + " END"


@query(f"""SELECT 'd' || doc_id AS conversation_id, node AS node_id, CASE WHEN node IN ('ask', 'ask2') THEN CASE WHEN doc_id % 10 = 0 THEN 'nowhere' ELSE 'top' END WHEN node <> 'top' THEN 'ask' END AS parent_id,
 CASE node WHEN 'top' THEN 'unknown' WHEN 'ask' THEN 'user' WHEN 'ask2' THEN 'user' WHEN 'mid' THEN {by_answer(1)} ELSE 'assistant' END AS role, CASE node WHEN 'top' THEN 'unknown' WHEN 'ask' THEN 'user' WHEN 'ask2' THEN 'user' WHEN 'mid' THEN {by_answer(2)} ELSE 'assistant_final' END AS semantic,
 CASE node WHEN 'top' THEN '' WHEN 'mid' THEN {by_answer(3)} ELSE 'text' END AS kinds, CASE node WHEN 'top' THEN '' WHEN 'ask' THEN 'q' WHEN 'ask2' THEN 'q' WHEN 'mid' THEN {by_answer(4)} ELSE 'z' END AS text FROM documents, (VALUES ('top'), ('ask'), ('ask2'), ('left'), ('mid'), ('right')) v(node)""")
def canonical_classes(t):
    part = lambda name: F.transform("content", lambda p: p[name])
    return canonical.nodes(forked(t)).select("conversation_id", "node_id", "parent_id", "role", "semantic", F.array_join(part("type"), ",").alias("kinds"), F.array_join(part("text"), "|").alias("text"))


@query("SELECT 'd' || doc_id AS conversation_id, 2 AS message_nodes, doc_id % 10 <> 0 AS root_reached, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS parent_breaks, false AS cycle FROM documents")
def forked_traces(t):
    r = forked(t)
    return providers.raw_trace(canonical.nodes(r), canonical.heads(r))


@query("SELECT 'd' || doc_id AS conversation_id, 6 AS total_nodes, 2 AS active_messages, CASE WHEN doc_id % 8 = 6 THEN 2 ELSE 1 END AS user_messages, CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END AS final_messages, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 0 END AS missing FROM documents")
def forked_integrity(t):
    r = forked(t)
    rows = integrity.report(canonical.nodes(r), canonical.heads(r))
    return rows.select("conversation_id", "total_nodes", "active_messages", "user_messages", "final_messages", F.col("orphan_nodes").alias("missing"))


# --- jobs ---------------------------------------------------------------------


@query("""SELECT doc_id AS id, 3 AS version, CASE WHEN doc_id % 2 = 0 THEN 'selected' ELSE 'all' END AS scope, CASE WHEN doc_id % 4 < 2 THEN 'indexing' ELSE 'done' END AS status, CASE WHEN doc_id % 4 < 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'complete' ELSE 'pending' END ELSE 'complete' END AS regular_status, 2 AS completed,
 CASE WHEN doc_id % 4 < 2 THEN 'migrated from version 1' WHEN doc_id % 4 = 2 THEN 'migrated from version 2' END AS warning FROM documents WHERE doc_id % 13 <> 0""")
def job_migrations(t):
    i = F.col("doc_id")
    rows = t.documents.select(
        i.alias("id"), F.when(i % 13 == 0, 9).when(i % 4 == 0, F.lit(None)).otherwise(i % 4).cast("int").alias("version"), F.when(i % 4 < 2, i % 3 == 0).alias("pagination_complete"), F.when(i % 2 == 0, "selected").otherwise("odd").alias("scope"), F.lit("done").alias("status"),
        F.lit("complete").alias("regular_status"), F.array(i, i, i + 1).alias("completed_ids"),
    )
    return jobs.migrated(rows).withColumn("completed", F.size("completed_ids")).drop("completed_ids")


def work(t):
    """Events as conversations that jobs (users) list: id, version, and whether they are archived."""
    return t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("id"), F.col("event_type").alias("version"), (F.col("event_id") % 4 == 0).alias("archived"))


@query("SELECT user_id AS job_id, event_id AS id, CASE WHEN event_id % 6 = 0 OR event_id % 5 = 1 THEN 'noted' ELSE event_type END AS version FROM events WHERE event_id % 3 = 0")
def reconciled_progress(t):
    rows = work(t)
    artifacts = rows.where("id % 3 = 0").select("job_id", "id")
    stray = artifacts.withColumn("id", -F.col("id") - 1)
    return jobs.reconciled(rows, artifacts.union(artifacts).union(stray), rows.where("id % 6 = 0 OR id % 5 = 1").withColumn("version", F.lit("noted")))


@query("SELECT doc_id AS plan_id, k AS volume FROM documents, (VALUES (1), (2), (3)) v(k) WHERE k <= doc_id % 4 AND NOT (k <= 2 AND doc_id % 2 = 1 AND doc_id % 3 <> 0)")
def resumed_volumes(t):
    i = F.col("doc_id")
    plans = t.documents.select(i.alias("plan_id"), F.lit("g").alias("graph_hash"), (i % 4).alias("volumes"))
    runs = t.documents.where("doc_id % 2 = 1").select((i + 100).alias("run_id"), i.alias("plan_id"), F.when(i % 3 == 0, "old").otherwise("g").alias("graph_hash"))
    return jobs.resumed(plans, runs, runs.select("run_id", F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 2, 2)))).alias("volume")))


@query("SELECT user_id AS job_id, event_id AS id, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END AS attempt FROM events WHERE user_id % 2 = 0 AND event_id % 4 <> 1 AND event_id % 4 <> 2")
def selected_runs(t):
    rows = work(t)
    i, j = F.col("id"), F.col("job_id")
    selected = rows.select("job_id", "id", F.when(j % 2 == 0, "m").otherwise("changed").alias("mark"))
    progress = rows.where("id % 4 < 3").select("job_id", "id", (i % 4 == 1).alias("done"), F.when(i % 4 == 2, 2).otherwise(1).alias("attempts"))
    return jobs.to_run(selected, progress, rows.select("job_id", F.lit("m").alias("mark")).distinct())


@query("SELECT user_id AS id, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status, 'inventory_only' AS asset_status FROM events GROUP BY user_id")
def finalised_jobs(t):
    return jobs.finalised(t.events.groupBy(F.col("user_id").alias("id")).agg(F.nullif(F.count_if(F.col("event_type") == "error"), F.lit(0)).alias("failures")))


@query("""SELECT job_id, total AS selected_total, saved, greatest(0, total - saved) AS remaining, failed, total > saved AS partial, saved - archived AS regular, archived FROM (SELECT user_id AS job_id, CASE WHEN user_id % 2 = 0 THEN 20 ELSE count(*) END AS total, count(*) FILTER (event_id % 3 = 0) AS saved,
 count(*) FILTER (event_id % 3 <> 0 AND event_id % 5 = 0) AS failed, count(*) FILTER (event_id % 3 = 0 AND event_id % 4 = 0) AS archived FROM events GROUP BY user_id) WHERE saved > 0""")
def export_counters(t):
    rows = work(t)
    return jobs.export_counters(rows, rows.where("id % 3 = 0"), rows.where("id % 5 = 0"), rows.where("job_id % 2 = 0").select("job_id").distinct().withColumn("total", F.lit(20).cast("long")))


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def catalogue_cache(t):
    rows = t.events.select("user_id", "event_type", "event_id")
    return jobs.cached(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ("user_id", "event_type"), "event_id")


@query("SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20")
def run_history(t):
    return jobs.newest(t.events.where("event_type = 'error'"), "ts", "event_id", 20).select("event_id")


@query("SELECT name, n FROM (SELECT 'jobs' AS name, count(*) AS n FROM events WHERE user_id <> 8 UNION ALL SELECT 'postings', 0 UNION ALL SELECT 'states', count(*) FROM documents)")
def cleared_tables(t):
    """One job's rows go from its tables; of the index all rows go, and nothing else."""
    mine = jobs.cleared({"jobs": t.events.withColumnRenamed("user_id", "job_id")}, 8)
    rest = jobs.cleared_index({"postings": t.conversations, "states": t.documents})
    out = None
    for name, df in {**mine, **rest}.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


@query("SELECT user_id AS project_id, max(ts) AS updated_at, max_by(event_id, ts) AS run FROM events GROUP BY user_id")
def latest_runs(t):
    return jobs.latest_run(t.events.select(F.col("user_id").alias("project_id"), F.col("ts").alias("updated_at"), F.col("event_id").alias("run")))


@query("SELECT source AS project_id, doc_id AS node_id, CASE WHEN source = 'src1' THEN 'new' ELSE 'old' END AS path FROM documents WHERE source <> 'src1' OR doc_id % 3 = 0")
def export_profiles(t):
    rows = t.documents.select(F.col("source").alias("project_id"), F.col("doc_id").alias("node_id"), F.lit("old").alias("path"))
    return jobs.replaced(rows, rows.where("project_id = 'src1' AND node_id % 3 = 0").withColumn("path", F.lit("new")))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def import_log(t):
    rows = t.events.select(F.col("event_id").alias("id"))
    new = rows.where("id % 3 = 0").withColumn("origin", F.lit("new"))
    return jobs.appended(rows.where("id % 2 = 0").withColumn("origin", F.lit("old")), new.union(new))


@query("""SELECT doc_id AS id, doc_id % 2 = 0 AS enabled, CASE doc_id % 4 WHEN 0 THEN '09:30' WHEN 1 THEN '23:59' WHEN 2 THEN '03:30' ELSE '07:05' END AS local_time, CASE WHEN doc_id % 4 = 0 THEN 'download' ELSE 'references-only' END AS asset_policy, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE least(greatest(doc_id, 1), 365) END AS interval_days,
 120 AS idle_seconds, 67108864 AS max_asset_bytes, 30 AS max_snapshots, 1 AS max_age_days FROM documents""")
def schedule_settings(t):
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    rows = t.documents.select(
        i.alias("id"), F.when(i % 2 == 0, True).alias("enabled"), F.when(i % 4 == 0, "9:30").when(i % 4 == 1, "24:75").when(i % 4 == 2, "noon").otherwise("07:05").alias("local_time"), F.when(i % 4 == 0, "download").otherwise("all").alias("asset_policy"), F.when(i % 5 != 0, i.cast("string")).alias("interval_days"),
        none.alias("idle_seconds"), F.lit("1e12").alias("max_asset_bytes"), F.lit("x").alias("max_snapshots"), F.lit("-4").alias("max_age_days"),
    )
    return jobs.schedule(rows)


@query("SELECT doc_id, 'assets/' || CASE WHEN doc_id % 2 = 0 THEN 'file-' || doc_id ELSE 'k-' || doc_id END || '_' || CASE WHEN doc_id % 3 = 0 THEN 'attachment' ELSE lang || '-x.txt' END AS path, strlen(text) AS size FROM documents")
def asset_paths(t):
    i = F.col("doc_id")
    path = jobs.archive_path(F.when(i % 2 == 0, F.concat(F.lit("file-"), i.cast("string"))), F.concat(F.lit("k:/"), i.cast("string")), F.when(i % 3 != 0, F.concat("lang", F.lit("/x.txt"))))
    return t.documents.select("doc_id", path.alias("path"), jobs.rough_size(F.col("text")).alias("size"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'archive' WHEN 1 THEN 'trash' ELSE 'none' END AS undo, CASE doc_id % 4 WHEN 0 THEN 'false:a:' WHEN 1 THEN 'true:a:b' WHEN 2 THEN 'true:b:a' ELSE 'true:a:c' END AS ends,
 CASE WHEN doc_id % 7 = 0 THEN 'needs-chat' WHEN doc_id % 5 = 0 THEN 'resume-backup' WHEN doc_id % 5 = 1 THEN 'finish-computer-backup' WHEN doc_id % 5 = 2 THEN 'index-library' WHEN doc_id % 5 = 3 THEN 'search-library' ELSE 'save-current' END AS guidance FROM documents""")
def next_steps(t):
    i = F.col("doc_id")
    five = lambda *v: F.element_at(F.array(*map(F.lit, v)), (i % 5 + 1).cast("int"))
    ids = F.when(i % 4 == 0, F.array(F.lit("a"), F.lit("a"), F.lit(""))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    ends = jobs.relation_ends(ids, F.when(i % 4 == 2, "b").otherwise("x"), F.when(i % 4 == 3, "c").when(i % 4 == 2, "b"))
    status = five("running", "completed", "completed_with_errors", "completed", None)
    guide = jobs.guidance(i % 7 != 0, five(9, 9, 0, 9, 0), status, five(1, 1, 1, 1, 0), five(0, 3, 1, 1, 0), five(0, 1, 1, 1, 0))
    return t.documents.select("doc_id", jobs.undo(F.when(i % 3 == 0, "archived").when(i % 3 == 1, "trashed").otherwise("active")).alias("undo"), F.concat_ws(":", ends["ready"].cast("string"), ends["from_id"], ends["to_id"]).alias("ends"), guide.alias("guidance"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 7 + doc_id % 5 WHEN doc_id % 3 = 1 THEN nullif(doc_id, 0) END AS conversations, CASE WHEN doc_id % 2 = 0 THEN greatest(0, 1000 - doc_id) END AS free_bytes, doc_id % 4 = 0 AS resume FROM documents")
def backup_preflight(t):
    i, none = F.col("doc_id"), F.lit(None).cast("long")
    rows = t.documents.select(
        i.alias("id"), F.when(i % 3 == 0, 7).cast("long").alias("regular_total"), F.when(i % 3 == 0, i % 5).alias("archived_total"), F.when((i % 3 == 1) & (i % 2 == 0), i).otherwise(none).alias("listed"), F.when(i % 3 == 1, i).otherwise(none).alias("saved"),
        F.when(i % 2 == 0, 1000).cast("long").alias("quota"), i.alias("usage"), F.when(i % 4 == 0, "exporting").when(i % 4 == 1, "completed").alias("status"),
    )
    return jobs.preflight(rows)


@query("""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'src1' WHEN 1 THEN 'new-' || doc_id WHEN 2 THEN NULL ELSE lang END AS project_id, CASE doc_id % 4 WHEN 0 THEN 'SRC1' WHEN 1 THEN 'New ' || doc_id WHEN 2 THEN NULL ELSE lang END AS title, doc_id % 4 = 1 AS created,
 CASE WHEN doc_id % 4 = 2 THEN 'title takes another project''s id' END AS error FROM documents""")
def project_choices(t):
    i = F.col("doc_id")
    forms = t.documents.select(i.alias("id"), F.col("lang").alias("selected_id"), F.lit("").alias("selected_title"), F.when(i % 4 == 0, " src1 ").when(i % 4 == 1, F.concat(F.lit("New "), i.cast("string"))).when(i % 4 == 2, "src 2").alias("new_title"))
    existing = t.spark.createDataFrame([("src1", "SRC1"), ("src-2", "Another")], "project_id string, title string")
    return jobs.chosen_project(forms, existing)


@query(r"""SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'flash' ELSE 'note' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'my-' || lang END AS project_id, CASE WHEN doc_id % 4 = 0 THEN 'T' WHEN doc_id % 2 = 0 THEN left(regexp_replace(b, '\s+', ' ', 'g'), 42) ELSE 'Untitled note' END AS title, 2 AS tags, CASE WHEN doc_id % 5 = 0 THEN 'web' ELSE 'mobile' END AS provider
 FROM (SELECT *, trim(text, ' ' || chr(10)) AS b FROM documents) WHERE b <> ''""")
def capture_forms(t):
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    forms = t.documents.select(i.alias("id"), F.when(i % 2 == 1, "note").alias("kind"), F.when(i % 3 == 0, F.concat(F.lit(" My "), "lang")).alias("project_title"), F.when(i % 4 == 0, " T ").otherwise(none).alias("title"), F.col("text").alias("body"), F.lit("a, b,a").alias("tags"), F.when(i % 5 == 0, "https://x/").otherwise(none).alias("source_url"))
    return jobs.captured(forms).select("id", "kind", "project_id", "title", L(F.size("tags"), "tags"), "provider")


# --- versions -----------------------------------------------------------------


def history(t):
    """Documents as objects at revision doc_id % 3 + 1 with all their versions."""
    i = F.col("doc_id")
    objects = t.documents.select(i.alias("id"), F.col("source").alias("project_id"), (i % 3 + 1).alias("revision"), F.timestamp_add("DAY", (i % 100).cast("int"), F.to_timestamp(F.lit("2024-01-01"))).alias("updated_at"))
    rows = objects.select(F.col("id").alias("object_id"), F.explode(F.sequence(F.lit(1).cast("long"), "revision")).alias("revision"))
    return objects, rows.withColumn("digest", F.concat_ws("v", "object_id", "revision"))


@query("SELECT doc_id AS object_id, k AS revision FROM documents, (VALUES (1), (2), (3)) v(k) WHERE source = 'src1' AND k <= doc_id % 3 + 1")
def project_versions(t):
    objects, rows = history(t)
    return versions.listed(rows, objects, "src1").select("object_id", "revision")


@query("SELECT doc_id AS object_id, CASE WHEN doc_id % 5 = 0 THEN 'refused:object_not_found' WHEN doc_id % 3 = 0 THEN 'refused:version_not_found' ELSE 'restored' END AS outcome, CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN doc_id % 3 + 2 END AS revision, CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN 2 END AS restored_from, CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN doc_id || 'v2' END AS digest FROM documents")
def version_restores(t):
    objects, rows = history(t)
    return versions.restored(objects.select(F.col("id").alias("object_id"), F.lit(2).cast("long").alias("revision")), rows, objects.where("id % 5 <> 0"))


RELATION_SQL = "SELECT doc_id AS id, doc_id AS from_id, doc_id * 2 AS to_id FROM documents"


@query(f"""SELECT r.id, r.from_id, r.to_id, CASE WHEN b.doc_id IS NULL THEN 'refused:endpoint_missing' WHEN a.source <> b.source THEN 'refused:cross_project' ELSE 'linked' END AS outcome, CASE WHEN a.source = b.source THEN a.source END AS project_id
 FROM ({RELATION_SQL}) r JOIN documents a ON a.doc_id = from_id LEFT JOIN documents b ON b.doc_id = to_id""")
def relation_links(t):
    objects, _ = history(t)
    return versions.linked(objects.select("id", F.col("id").alias("from_id"), (F.col("id") * 2).alias("to_id")), objects)


@query(f"SELECT id, 'stays' AS what FROM ({RELATION_SQL}) WHERE id % 4 <> 0 AND (from_id = 6 OR to_id = 6) UNION ALL SELECT id, 'unlink' FROM ({RELATION_SQL}) WHERE id % 4 = 0")
def relation_removals(t):
    i = F.col("doc_id")
    relations = t.documents.select(i.alias("id"), i.alias("from_id"), (i * 2).alias("to_id"), i.alias("created_at"))
    stay, log = versions.unlinked(relations, relations.where("id % 4 = 0"))
    return versions.relations_of(stay, 6).select("id", F.lit("stays").alias("what")).union(log.select("relation_id", "type"))


@query("""WITH o AS (SELECT doc_id, doc_id % 3 + 1 AS revision FROM documents WHERE source = 'src1' AND doc_id % 100 BETWEEN 31 AND 59)
SELECT 'objects' AS name, count(*) AS n FROM o UNION ALL SELECT 'versions', CAST(coalesce(sum(revision), 0) AS BIGINT) FROM o UNION ALL SELECT 'relations', count(*) FROM o WHERE doc_id * 2 IN (SELECT doc_id FROM o) UNION ALL SELECT 'operations', count(*) FROM o UNION ALL SELECT 'promotions', count(*) FROM o WHERE doc_id % 2 = 0""")
def capture_exports(t):
    objects, rows = history(t)
    relations = objects.select("id", F.col("id").alias("from_id"), (F.col("id") * 2).alias("to_id"))
    found = versions.exported(objects, rows, relations, objects.select(F.col("id").alias("object_id")), objects.where("id % 2 = 0").select(F.col("id").alias("source_id")), "src1", date_from="2024-02-01", date_to="2024-02-29")
    out = None
    for name, df in found.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


@query("SELECT 'r1' AS source_receipt, CASE WHEN doc_id % 3 = 0 THEN 'delete_object' ELSE 'restore_object' END AS kind, count(*) AS rows FROM documents GROUP BY 2")
def rollback_receipts(t):
    actions = t.documents.select(F.when(F.col("doc_id") % 3 == 0, "delete_object").otherwise("restore_object").alias("kind"), F.col("doc_id").alias("id"))
    return versions.rollback_receipt(actions, "r1", "2024-01-01").select("source_receipt", "kind", "rows")


@query(f"SELECT conv_id, turn, CAST(score AS BIGINT) AS score FROM ({SCORE_SQL.replace('WHERE list_contains', 'WHERE true OR list_contains')}) WHERE score > CASE WHEN role = 'user' THEN 10 ELSE 8 END")
def memory_messages(t):
    m = t.conversations.select(F.col("conv_id").alias("conversation_id"), "conv_id", "turn", "role", "text", F.concat_ws(":", "conv_id", "turn").alias("key"), F.lit(True).alias("active"), F.lit(None).cast("timestamp").alias("created_at"))
    c = t.conversations.select(F.col("conv_id").alias("conversation_id"), F.lit(None).cast("timestamp").alias("updated_at")).distinct()
    return versions.memory_messages(m, c, "the and").select("conv_id", "turn", "score")


@query("""SELECT conv_id, position, kind, text FROM (
 SELECT conv_id, 1 AS position, 'text' AS kind, string_agg(CAST(turn AS VARCHAR) || '.', '' ORDER BY turn) AS text FROM conversations WHERE turn < 3 GROUP BY conv_id
 UNION ALL SELECT conv_id, 2, 'image', 'i' FROM conversations GROUP BY conv_id HAVING max(turn) >= 3)""")
def merged_parts(t):
    """Texts of the first three turns continue each other; behind them the same image comes again and again."""
    n = F.col("turn").cast("string")
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("turn") < 3, "text").otherwise("image").alias("kind"), F.lit(None).cast("string").alias("language"), F.when(F.col("turn") < 3, F.concat(n, F.lit("."))).otherwise("i").alias("text"))
    return versions.merged_parts(rows, "conv_id", "turn").select("conv_id", "position", "kind", "text")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def grouped_sets(t):
    return versions.grouped_sets(t.events, "user_id", "event_type").select("user_id", F.array_join("values", ",").alias("types"))


@query("""SELECT source AS project_id, count(*) FILTER (doc_id % 3 = 0) AS decisions, count(*) FILTER (doc_id % 5 < 3) AS tasks FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 < 3 GROUP BY source""")
def continuity_challenges(t):
    i = F.col("doc_id")
    rows = t.documents.select(F.col("source").alias("project_id"), i.cast("string").alias("id"), F.col("lang").alias("title"), i.alias("n"))
    decisions = rows.withColumn("status", F.when(F.col("n") % 3 > 0, "reversed"))
    tasks = rows.withColumn("status", F.element_at(F.array(*map(F.lit, ("todo", None, "blocked", "done", "cancelled"))), (F.col("n") % 5 + 1).cast("int"))).withColumn("priority", F.lit(None).cast("string"))
    return versions.challenge(decisions, tasks)[1].select("project_id", "decisions", "tasks")


@query("SELECT doc_id AS \"case\", source AS project_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS phase, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS DOUBLE) END AS progress, 1 AS decisions, 2 AS evidence FROM documents")
def normalised_responses(t):
    i = F.col("doc_id")
    raw_ = F.concat(
        F.lit('{"project": {"id": " '), "source", F.lit('"}, "status": {"phase": "'), F.when(i % 2 == 0, F.col("lang")).otherwise("  "), F.lit('", "progressPercent": "'), F.when(i % 3 == 0, i.cast("string")).otherwise("x"),
        F.lit('"}, "decisions": [{"id": "a", "title": "t"}, {"id": " "}], "evidenceUris": ["u", " u", "", "v"]}'),
    )
    return versions.responses(t.documents.select(i.alias("case"), raw_.alias("raw"))).select("case", "project_id", "phase", "progress", L(F.size("decisions"), "decisions"), L(F.size("evidence"), "evidence"))


@query("SELECT doc_id AS id, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS ok FROM documents")
def checked_sources(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("digest"))
    return versions.checked(d, d.where("id % 5 <> 0").withColumn("digest", F.when(F.col("id") % 4 == 0, "moved").otherwise(F.col("digest")))).select("id", "ok")


@query("""SELECT source AS project_id, name, CASE name WHEN 'manifest.json' THEN '{"project_id":"' || source || '","version":2,"hash":"h"}' WHEN 'evidence.md' THEN '# Evidence index' || chr(10) || chr(10) || '- u' || chr(10) || '- v' || chr(10) ELSE 'core of ' || source END AS text
 FROM (SELECT DISTINCT source FROM documents), (VALUES ('manifest.json'), ('core.md'), ('project.md'), ('evidence.md')) f(name)""")
def memory_bundles(t):
    rows = t.documents.select(F.col("source").alias("project_id")).distinct()
    return versions.bundle_files(rows.select("project_id", F.lit(2).alias("version"), F.lit("h").alias("hash"), F.concat(F.lit("core of "), "project_id").alias("core"), F.lit(None).cast("string").alias("project"), F.array(F.lit("u"), F.lit("v"), F.lit("u")).alias("sources")))


@query("SELECT part, part <> 'objects' AS ok FROM (VALUES ('objects'), ('gate'), ('pack'), ('key')) v(part)")
def handoff_verification(t):
    """A receiver that builds the parts anew finds the one that changed since."""
    i = F.col("doc_id")
    objects = t.documents.select(F.col("source").alias("project_id"), i.alias("id"), F.sha2("text", 256).alias("digest"))
    pack = t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("key"), T.estimate("text").alias("tokens"), (F.col("turn") == 0).alias("taken"))
    key = objects.where("id % 3 = 0").select("project_id", F.lit("decision").alias("kind"), "id")
    build = lambda o: versions.handoff(o, reported(t), pack, key, "src1", 1 << 40)
    return versions.verified_handoff(build(objects), build(objects.where("project_id <> 'src1' OR id % 7 <> 0"))).select("part", "ok")


# --- the query surface --------------------------------------------------------


def bundle(t):
    """Conversations as a bundle: dated by turn and id, every second one in a project; documents as its content objects."""
    day = lambda n: F.timestamp_add("HOUR", n.cast("int"), F.to_timestamp(F.lit("2024-01-01")))
    c, i = F.col("conv_id"), F.col("doc_id")
    messages = t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("key"), c.cast("string").alias("conversation_id"), F.concat(F.lit("n"), F.col("turn").cast("string")).alias("node_id"), "role", "text", F.lit(True).alias("active"), day(F.col("turn")).alias("created_at"), F.col("turn").alias("depth"))
    talks = t.conversations.select("conv_id").distinct().select(c.cast("string").alias("conversation_id"), F.lit("talk").alias("title"), F.when(c % 2 == 0, F.concat(F.lit("src"), (c % 8).cast("string"))).alias("project_id"), F.when(c % 2 == 0, F.concat(F.lit("Project "), (c % 8).cast("string"))).alias("project_title"), (c % 3 == 0).alias("archived"), day(c).alias("updated_at"), F.lit("e").alias("evidence_hash"))
    objects = t.documents.select(i.cast("string").alias("id"), F.when(i % 3 == 0, "flash").otherwise("note").alias("kind"), F.col("source").alias("project_id"), F.col("lang").alias("title"), F.col("text").alias("body"), F.array("lang").alias("tags"), F.when(i % 10 == 0, "trashed").otherwise("active").alias("status"), F.lit(1).alias("revision"), F.sha2("text", 256).alias("digest"), day(i).alias("updated_at"))
    states = t.documents.groupBy(F.col("source").alias("project_id")).agg((F.min("doc_id") + 1).alias("version"))
    return api.Bundle(messages, talks, objects, states)


@query("SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT count(*) FROM conversations) AS messages, (SELECT count(*) FROM documents) AS content_objects, (SELECT count(DISTINCT source) FROM documents) AS states, (SELECT count(DISTINCT p) FROM (SELECT 'src' || conv_id % 8 AS p FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT source FROM documents)) AS projects")
def tool_stats(t):
    return api.stats(bundle(t))


@query("""SELECT project_id, max(title) AS title, CAST(sum(c) AS BIGINT) AS conversations, CAST(sum(m) AS BIGINT) AS messages, CAST(sum(o) AS BIGINT) AS content_objects FROM (
 SELECT 'src' || conv_id % 8 AS project_id, 'Project ' || conv_id % 8 AS title, 1 AS c, count(*) AS m, 0 AS o FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id UNION ALL SELECT source, NULL, 0, 0, 1 FROM documents WHERE doc_id % 10 <> 0) GROUP BY project_id""")
def tool_list_projects(t):
    return api.list_projects(bundle(t)).drop("updated_at")


@query("""SELECT key, round(CAST((CASE WHEN contains(w, 'the and') THEN 100 ELSE 18 END) + 8 + (CASE WHEN role = 'user' THEN 2 ELSE 0 END) + least(5.0, epoch_ms(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * conv_id) / 1e13) AS DOUBLE), 6) AS score FROM (
 SELECT *, concat_ws(':', conv_id, turn) AS key, lower('talk' || chr(10) || text) AS w FROM conversations) WHERE list_contains(regexp_extract_all(w, '[a-z0-9][a-z0-9_+.-]{1,63}'), 'the') AND list_contains(regexp_extract_all(w, '[a-z0-9][a-z0-9_+.-]{1,63}'), 'and') ORDER BY score DESC, conv_id DESC, key LIMIT 50""")
def tool_search_messages(t):
    return api.search_messages(bundle(t), "the and", 50).select("key", "score")


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE source = 'src1' AND doc_id % 10 <> 0 ORDER BY doc_id DESC LIMIT 30")
def tool_list_content(t):
    return api.list_content(bundle(t), 30, project="src1").select("id")


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, round(CAST((CASE WHEN contains(lang, 'es') THEN 20 ELSE 0 END) + 3 + least(5.0, epoch_ms(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id) / 1e13) AS DOUBLE), 6) AS score
 FROM documents WHERE doc_id % 10 <> 0 AND list_contains(regexp_extract_all(lower(lang || chr(10) || text || chr(10) || lang), '[a-z0-9][a-z0-9_+.-]{1,63}'), 'es') ORDER BY score DESC, doc_id DESC LIMIT 200""")
def tool_search_content(t):
    """Titles, whole bodies and tags; the word is a language's title, and stands in texts of others."""
    return api.search_content(bundle(t), "es", 200).select("id", "score")


@query(r"SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(left(text, 182), '\s+$', '') || chr(10) || '…[truncated]' END AS body FROM documents WHERE doc_id = 7")
def tool_read_content(t):
    return api.read_content(bundle(t), "7", 200).select("id", "body")


@query(r"SELECT 'n' || turn AS node_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(left(text, 102), '\s+$', '') || chr(10) || '…[truncated]' END AS text FROM conversations WHERE conv_id = 3 AND role IN ('user', 'assistant')")
def tool_read_conversation(t):
    return api.read_conversation(bundle(t), "3", ("user", "assistant"), max_chars=120).select("node_id", "text")


@query("""SELECT (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 8 = 2) AS conversations, (SELECT count(*) FROM conversations WHERE conv_id % 8 = 2) AS messages, (SELECT count(*) FROM documents WHERE source = 'src2' AND doc_id % 10 <> 0) AS content_objects""")
def tool_project_snapshot(t):
    return api.project_snapshot(bundle(t), "src2").drop("updated_at")


@query("SELECT '5' AS conversation_id, left(string_agg(text, chr(10) ORDER BY turn), 300) AS canonical FROM conversations WHERE conv_id = 5")
def tool_source_evidence(t):
    rows = bundle(t)
    one = t.conversations.where("conv_id = 5").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("canonical"))
    rows.more["evidence"] = one.select(F.col("conv_id").cast("string").alias("conversation_id"), "canonical")
    return api.source_evidence(rows, "5", 300)


@query("SELECT 'state:src1:status' AS id, 'INCLUDE' AS decision, 'LOCKED_APPROVED_MEMORY' AS reason UNION ALL SELECT 'state:src1:next_action:1', 'INCLUDE', 'APPROVED_PROJECT_STATE' UNION ALL SELECT 'decision:d1', 'INCLUDE', 'EVIDENCE_VERIFIED' UNION ALL SELECT 'decision:d2', 'EXCLUDE', 'SUPERSEDED' UNION ALL SELECT 'task:t1', 'EXCLUDE', 'INACTIVE_RECORD' UNION ALL SELECT 'task:t2', 'REVIEW', 'MISSING_EVIDENCE'")
def tool_memory_gate(t):
    rows = bundle(t)
    record = "array<struct<id:string,title:string,summary:string,status:string,evidence:array<string>>>"
    task = "array<struct<id:string,title:string,notes:string,priority:string,status:string,evidence:array<string>>>"
    status = F.struct(F.lit("build").alias("phase"), F.lit("good").alias("health"), F.lit("going on").alias("summary"), F.array().cast("array<string>").alias("blockers"), F.array(F.lit("ship it")).alias("nextActions"))
    rows.states = rows.states.select(
        "project_id", F.lit(1).alias("updated_at"), status.alias("status"), F.from_json(F.lit('[{"id":"d1","title":"a","summary":"b","status":"active","evidence":["u"]},{"id":"d2","title":"a","summary":"b","status":"superseded","evidence":["u"]}]'), record).alias("decisions"),
        F.from_json(F.lit('[{"id":"t1","title":"a","notes":"b","priority":"high","status":"done","evidence":["u"]},{"id":"t2","title":"a","notes":"b","priority":"low","status":"todo","evidence":[]}]'), task).alias("tasks"),
    )
    return api.memory_gate(rows, "src1", "2024-01-01 00:00:00").select("id", "decision", "reason")


@query("""WITH m AS (SELECT concat_ws(':', conv_id, turn) AS key, conv_id, role, text, lower('talk' || chr(10) || text) AS w FROM conversations),
s AS (SELECT key, conv_id, text, round(CAST((CASE WHEN contains(w, 'the and') THEN 100 ELSE 0 END) + 8 + (CASE WHEN role = 'user' THEN 2 ELSE 0 END) + least(5.0, epoch_ms(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * conv_id) / 1e13) AS DOUBLE), 6)
 + CASE WHEN contains(w, 'the and') THEN 0 ELSE (CASE WHEN contains(w, 'the') THEN 9 ELSE 0 END) + (CASE WHEN contains(w, 'and') THEN 9 ELSE 0 END) END AS score FROM m
 WHERE list_contains(regexp_extract_all(w, '[a-z0-9][a-z0-9_+.-]{1,63}'), 'the') AND list_contains(regexp_extract_all(w, '[a-z0-9][a-z0-9_+.-]{1,63}'), 'and'))
SELECT key FROM (SELECT key, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, key) AS k FROM s) WHERE k <= 3""")
def tool_context_pack(t):
    return api.context_pack(bundle(t), "the and", 32768).select("key")


@query("SELECT 'src1' AS project_id, 'decision' AS kind, min(doc_id) + 1 AS base_version, 1 AS evidence FROM documents WHERE source = 'src1'")
def tool_propose(t):
    one = t.spark.createDataFrame([("change",)], "change string")
    cited = t.spark.createDataFrame([("archive://conversation/3/node/n0?evidence=e",), ("archive://conversation/3/node/none?evidence=e",)], "uri string")
    out = api.propose(bundle(t), "src1", "decision", one, cited)
    return out.select("project_id", "kind", "base_version", L(F.size("evidence"), "evidence"))
