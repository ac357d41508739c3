"""A raw graph of three levels: two openings, one of them answered twice, a reply below one answer, and a node whose parent was never there."""

import json

import pytest

from palimpsest.operators import canonical, integrity


def said(name, who, at, content):
    return {"id": name, "author": {"role": who}, "create_time": 1_600_000_000 + at, "content": content}


def told(*parts):
    return {"content_type": "multimodal_text", "parts": list(parts)}


RAW = {
    "conversation_id": "weather", "title": "Rain or sun", "current_node": "w5",
    "mapping": {
        "w0": {"parent": None, "children": ["w1", "w2"], "message": said("s", "system", 0, told("Be brief."))},
        "w1": {"parent": "w0", "children": [], "message": said("u1", "user", 1, told("Will it rain?"))},
        "w2": {"parent": "w0", "children": ["w3", "w4"], "message": said("u2", "user", 2, told("Will it rain in May?", {"content_type": "image_asset_pointer", "name": "map.png"}))},
        "w3": {"parent": "w2", "children": [], "message": said("a1", "assistant", 3, told("Hard to say."))},
        "w4": {"parent": "w2", "children": ["w5"], "message": said("a2", "assistant", 4, told("Likely."))},
        "w5": {"parent": "w4", "children": [], "message": said("u3", "user", 5, told("Thanks", {"type": "code", "text": "rain = True", "language": "r"}, {"content_type": "mood_ring", "text": "blue"}))},
        "x1": {"parent": "x0", "children": [], "message": said("t", "tool", 6, {"content_type": "execution_output", "text": "42"})},
    },
}


@pytest.fixture(scope="module")
def graph(spark):
    raw = spark.createDataFrame([(json.dumps(RAW),)], "raw string")
    return canonical.nodes(raw), canonical.heads(raw)


def test_nodes(graph):
    rows = {r["node_id"]: r for r in graph[0].collect()}
    assert sorted(rows, key=lambda n: rows[n]["ordinal"]) == ["w0", "w1", "w2", "w3", "w4", "w5", "x1"]
    assert {n: r["semantic"] for n, r in rows.items()} == {"w0": "system", "w1": "user", "w2": "user", "w3": "assistant_final", "w4": "assistant_final", "w5": "user", "x1": "tool_result"}
    assert [p["type"] for p in rows["w2"]["content"]] == ["text", "image"]
    assert [(p["type"], p["text"]) for p in rows["w5"]["content"]] == [("text", "Thanks"), ("code", "rain = True"), ("unknown", "blue")]
    assert [(p["type"], p["text"]) for p in rows["x1"]["content"]] == [("tool_result", "42")]


@pytest.mark.parametrize(
    "message, expected",
    [
        ({"author": {"role": "developer"}}, "developer"),
        ({"author": {"role": "assistant"}, "channel": "analysis"}, "reasoning"),
        ({"author": {"role": "assistant"}, "recipient": "browser"}, "tool_call"),
        ({"author": {"role": "assistant", "name": "python"}}, "tool_call"),
        ({"author": {"role": "assistant"}, "status": "in_progress"}, "assistant_intermediate"),
        ({"author": {"role": "assistant"}, "content": {"content_type": "thoughts"}}, "reasoning"),
        ({"author": {"role": "user"}, "metadata": {"is_voice": True}, "content": {"content_type": "text", "transcript": "hello"}}, "user_voice_transcript"),
        ({"author": {"role": "critic"}}, "unknown"),
    ],
)
def test_semantics(spark, message, expected):
    raw = spark.createDataFrame([(json.dumps({"id": "c", "mapping": {"n": {"message": message}}}),)], "raw string")
    assert canonical.nodes(raw).first()["semantic"] == expected


def test_branch_and_report(graph):
    path, trace = canonical.branch(*graph)
    assert {r["node_id"]: r["depth"] for r in path.collect()} == {"w5": 0, "w4": 1, "w2": 2, "w0": 3}
    t = trace.first()
    assert t["root_reached"] and t["parent_breaks"] == 0 and not t["cycle"]
    assert {(r["code"], r["node_id"]) for r in integrity.issues(*graph).collect()} == {("MISSING_PARENT", "x1")}
    r = integrity.report(*graph).first()
    assert (r["total_nodes"], r["active_messages"], r["user_messages"], r["final_messages"]) == (7, 4, 2, 1)


def test_cycle_and_break(spark):
    loop = {"id": "loop", "current_node": "a", "mapping": {"a": {"parent": "b", "message": {"id": "1", "author": {"role": "user"}}}, "b": {"parent": "a", "message": {"id": "2", "author": {"role": "user"}}}}}
    torn = {"id": "torn", "current_node": "a", "mapping": {"a": {"parent": "gone", "message": {"id": "1", "author": {"role": "user"}}}}}
    raw = spark.createDataFrame([(json.dumps(x),) for x in (loop, torn)], "raw string")
    rows = {r["conversation_id"]: r for r in canonical.branch(canonical.nodes(raw), canonical.heads(raw))[1].collect()}
    assert rows["loop"]["cycle"] and not rows["loop"]["root_reached"]
    assert not rows["torn"]["cycle"] and rows["torn"]["parent_breaks"] == 1


def test_long_chain(spark):
    nodes = spark.range(3000).selectExpr("'c' conversation_id", "concat('n', id) node_id", "if(id > 0, concat('n', id - 1), null) parent_id")
    heads = spark.createDataFrame([("c", "n2999")], "conversation_id string, current_node string")
    path, trace = canonical.branch(nodes, heads)
    assert path.selectExpr("count(*)", "max(depth)").first() == (3000, 2999)
    assert trace.first()["root_reached"]
