import io
import json
import os
import zipfile

import pytest

from palimpsest import api
from palimpsest.sources import archives
from palimpsest.sources.paged import PagedSource
from palimpsest.streaming import ingest

CONVERSATION = {"id": "c1", "mapping": {"n": {"message": {"id": "m", "author": {"role": "user"}}}}}


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("conversations.json", json.dumps([CONVERSATION, {"id": "bad"}]))
        z.writestr("a/canonical.json", json.dumps({"conversationId": "c2"}))
        z.writestr("a/raw.json", json.dumps({**CONVERSATION, "id": "c2"}))
        z.writestr("../evil.json", "{}")
    (tmp_path / "x.zip").write_bytes(data.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 nothing")
    (tmp_path / "conversations-1.json").write_text(json.dumps({"conversations": [{**CONVERSATION, "id": "c3"}]}))
    found = archives.entries(archives.files(spark, f"file://{tmp_path}"))
    errors = {r["name"]: r["error"] for r in found.where("error IS NOT NULL").collect()}
    assert errors["../evil.json"] == "unsafe name" and None in errors
    ids = {json.loads(r["raw"])["id"] for r in archives.conversations(found).collect()}
    assert ids == {"c1", "c2", "c3"}
    assert archives.own_candidates(found).count() == 1


def test_bodies(spark):
    body = 'data: {"a": 1}\n\ndata: {"deep": "{\\"id\\": \\"x\\", \\"mapping\\": {}}"}\nnoise'
    rows = spark.createDataFrame([(body,), ('{"items": [{"id": 1}], "total": 7}',)], "body string")
    assert archives.stream_events(rows).count() == 3
    whole = rows.where("body LIKE '{%'").selectExpr("parse_json(body) AS v")
    assert whole.select(archives.first_total(whole["v"]).alias("n")).first()["n"] == 7
    wrapped = spark.createDataFrame([('{"deep": "{\\"id\\": \\"x\\", \\"mapping\\": {}}"}',)], "body string")
    assert [r["id"] for r in archives.graph_objects(wrapped).collect()] == ["x"]


def test_chunks(spark):
    rows = spark.createDataFrame([("k", 2, "bG8=", 5), ("k", 1, "aGVs", 5), ("bad", 1, "aGVs", 9)], "key string, n int, data string, size int")
    found = {r["key"]: (bytes(r["payload"]), r["ok"]) for r in archives.reassembled(rows, "key", "n", "data", "size").collect()}
    assert found == {"k": (b"hello", True), "bad": (b"hel", False)}


def test_bundle(spark, tmp_path):
    rows = spark.createDataFrame([("p1", 1), ("p2", 2)], "project_id string, n int")
    archives.write_bundle({"conversations": rows}, f"file://{tmp_path}/b", "p1")
    found = archives.read_bundle(spark, f"file://{tmp_path}/b", {"conversations": "project_id string, n int", "messages": "key string"})
    assert [tuple(r) for r in found["conversations"].collect()] == [("p1", 1)] and found["messages"].count() == 0


def fetch(offset, limit):
    return [{"id": i} for i in range(offset, min(offset + limit, 25))], 25


def test_paged(spark):
    spark.dataSource.register(PagedSource)
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH")]))
    rows = spark.read.format("paged").option("fetch", "tests.test_sources:fetch").option("limit", "10").load()
    assert sorted(r["position"] for r in rows.collect()) == list(range(25))


def follow(cursor, limit):
    at = int(cursor or 0)
    return [{"id": i} for i in range(at, min(at + limit, 25))], str(at + limit) if at + limit < 25 else None


def circle(cursor, limit):
    return [{"id": 1}], "same"


def test_cursors(spark):
    spark.dataSource.register(PagedSource)
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH")]))
    load = lambda name: spark.read.format("paged").option("fetch", f"tests.test_sources:{name}").option("by", "cursor").option("limit", "10").load()
    assert sorted(r["position"] for r in load("follow").collect()) == list(range(25))
    with pytest.raises(Exception, match="came again"):
        load("circle").collect()


def test_stream_replay(spark, tmp_path):
    """Draining twice adds nothing; a late older version keeps its evidence and never becomes current."""
    source, log, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "log", "checkpoint"))
    schema = "id long, updated_at long, digest string"
    put = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{name}")
    put([(1, 10, "a"), (2, 10, "b")], "one")
    drain = lambda: ingest.ingest(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source), log, checkpoint).awaitTermination()
    drain()
    drain()
    put([(1, 5, "old"), (2, 20, "new")], "two")
    drain()
    assert {(r["id"], r["digest"]) for r in ingest.current(spark, log).collect()} == {(1, "a"), (2, "new")}
    assert ingest.evidence(spark, log).count() == 4


@pytest.fixture(scope="module")
def bundle(spark):
    messages = spark.createDataFrame([("k1", "c1", "n1", "user", "the quick brown fox", True, 0), ("k2", "c1", "n2", "assistant", "a slow answer", True, 1), ("k3", "c2", "n1", "user", "quick brown again", False, 0)], "key string, conversation_id string, node_id string, role string, text string, active boolean, depth long").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS created_at")
    talks = spark.createDataFrame([("c1", "One", "p1", "P", False, "h1"), ("c2", "Two", "p1", "P", True, "h2")], "conversation_id string, title string, project_id string, project_title string, archived boolean, evidence_hash string").selectExpr("*", "timestamp'2024-01-02 00:00:00' AS updated_at", "array('api') AS source_kinds")
    things = spark.createDataFrame([("o1", "note", "p1", "Fox", "brown", "active", 1, "d"), ("o2", "note", "p1", "Old", "fox", "trashed", 1, "d")], "id string, kind string, project_id string, title string, body string, status string, revision int, digest string").selectExpr("*", "array('x') AS tags", "timestamp'2024-01-03 00:00:00' AS updated_at")
    state = "project_id string, version int, updated_at string, status struct<phase:string,health:string,summary:string,blockers:array<string>,nextActions:array<string>>, decisions array<struct<id:string,title:string,summary:string,status:string,evidence:array<string>>>, tasks array<struct<id:string,title:string,notes:string,status:string,priority:string,evidence:array<string>>>"
    states = spark.createDataFrame([("p1", 3, "2024", ("build", "green", "all well", ["no keys"], ["ship it"]), [("d1", "Use Spark", "because", "active", ["u"]), ("d2", "Use none", "no", "superseded", ["u"])], [("t1", "Write", "notes", "todo", "high", []), ("t2", "Done", "x", "done", "low", [])])], state)
    return api.Bundle(messages, talks, things, states, {"evidence": talks.selectExpr("conversation_id", "'{}' AS canonical")})


def test_surface(bundle):
    assert api.stats(bundle).first().asDict() == {"conversations": 2, "messages": 3, "content_objects": 2, "states": 1, "projects": 1}
    assert api.list_projects(bundle).first()["content_objects"] == 1
    found = api.search_messages(bundle, "quick brown").collect()
    assert [r["key"] for r in found] == ["k1", "k3"] and found[0]["uri"] == "archive://conversation/c1/node/n1?evidence=h1"
    assert [r["key"] for r in api.search_messages(bundle, "quick", archived=True).collect()] == ["k3"]
    assert [r["id"] for r in api.search_content(bundle, "fox").collect()] == ["o1"]
    assert [r["id"] for r in api.list_content(bundle, trashed=True).collect()] == ["o1", "o2"]
    assert api.read_content(bundle, "o1").first()["body"] == "brown"
    assert [r["node_id"] for r in api.read_conversation(bundle, "c1").collect()] == ["n1", "n2"]
    snap = api.project_snapshot(bundle, "p1").first()
    assert (snap["conversations"], snap["messages"], snap["content_objects"]) == (2, 3, 1)
    assert api.source_evidence(bundle, "c1").count() == 1
    gate = {r["id"]: (r["decision"], r["reason"]) for r in api.memory_gate(bundle, "p1", "2024-01-01 00:00:00").collect()}
    assert gate["decision:d1"] == ("INCLUDE", "EVIDENCE_VERIFIED") and gate["decision:d2"] == ("EXCLUDE", "SUPERSEDED")
    assert gate["task:t2"] == ("EXCLUDE", "INACTIVE_RECORD") and gate["state:p1:blocker:1"] == ("INCLUDE", "LOCKED_APPROVED_MEMORY")
    pack = api.context_pack(bundle, "quick brown", 2048).collect()
    assert all(r["taken"] for r in pack) and len(pack) == 2
    with pytest.raises(ValueError):
        api.context_pack(bundle, "x", 100)


def test_propose(spark, bundle):
    change = spark.createDataFrame([("t9", "New task")], "id string, title string")
    cited = spark.createDataFrame([("archive://conversation/c1/node/n1?evidence=h1",), ("archive://nothing",)], "uri string")
    row = api.propose(bundle, "p1", "task", change, cited).first()
    assert row["base_version"] == 3 and row["evidence"] == ["archive://conversation/c1/node/n1?evidence=h1"]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    """A file that is read in several blocks; every kind of bad line is told with its number."""
    lines = [json.dumps({"id": k, "text": "x" * (k % 90)}) for k in range(3000)]
    for k in range(0, 3000, 97):
        lines[k] = ["{", "7", '{"id": "no number"}', "   ", ""][k % 5]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('{"id": 1}\nnot')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, bad = archives.json_lines(spark, f"file://{tmp_path}", "id long, text string")
        good = {(r["file"][-7:], r["line"], r["id"]) for r in rows.collect()}
        told = {(r["file"][-7:], r["line"]): r["reason"] for r in bad.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    reasons = ["not JSON", "not an object", "does not fit the schema", None, None]
    assert told == {("a.jsonl", k + 1): reasons[k % 5] for k in range(0, 3000, 97) if reasons[k % 5]} | {("b.jsonl", 2): "not JSON"}
    assert good == {("a.jsonl", k + 1, k) for k in range(3000) if k % 97} | {("b.jsonl", 1, 1)}


def test_stream_of_pages_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    for by, steps in (("offset", (7, 7, 25, 26)), ("cursor", (7, 7, 25, 26))):
        source = tmp_path / by
        source.mkdir()
        for n in steps:
            for page in range(-(-n // 10)):
                (source / f"page-{page:05}.jsonl").write_text("".join(f'{{"n": {k}}}\n' for k in range(page * 10, min(n, page * 10 + 10))))
            rows = spark.readStream.format("paged").option("fetch", f"palimpsest.sources.paged:stored_{by}s").option("by", by).option("at", str(source)).option("limit", 4).load()
            rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/{by}-out").option("checkpointLocation", f"file://{tmp_path}/{by}-at").trigger(availableNow=True).start().awaitTermination()
        got = sorted((r["position"], json.loads(r["item"])["n"]) for r in spark.read.parquet(f"file://{tmp_path}/{by}-out").collect())
        assert got == [(k, k) for k in range(26)], by
