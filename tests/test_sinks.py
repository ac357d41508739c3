"""Files as a sink: whole, hashed, listed once."""

import os
import types

import pyarrow as pa
import pytest

from palimpsest.sources import archives, sinks


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/out"


def rows(spark, n=60):
    return spark.createDataFrame([(f"dir {i % 4}/f+{i % 7}%.x", f"n{i:03}", f"text {i} é".encode()) for i in range(n)], "file string, name string, payload binary").repartition(5)


def test_zip_round_trip(spark, path):
    sinks.write_files(rows(spark), path, "zip")
    found = sinks.read_files(spark, path)
    assert found.where("NOT ok").count() == 0 and found.count() == 28
    inside = archives.entries(found.selectExpr("file AS path", "sha256 AS fingerprint", "content")).collect()
    want = {(r["file"], r["name"], bytes(r["payload"])) for r in rows(spark).collect()}
    assert {(r["path"], r["name"], bytes(r["payload"])) for r in inside} == want and all(r["error"] is None for r in inside)


def test_text_joins_the_rows_of_a_file_in_order(spark, path):
    sinks.write_files(rows(spark, 30), path)
    want = {}
    for r in sorted(rows(spark, 30).collect(), key=lambda r: r["name"]):
        want[r["file"]] = want.get(r["file"], b"") + bytes(r["payload"])
    assert {r["file"]: bytes(r["content"]) for r in sinks.read_files(spark, path).collect()} == want


def test_package_refuses_damaged_and_missing_files(spark, path):
    tables = {"one": spark.range(50).repartition(3), "two": spark.range(0)}
    sinks.write_package(tables, path)
    found = sinks.read_lines(spark, path, {"one": "id long", "two": "id long", "three": "id long"})
    assert sorted(r["id"] for r in found["one"].collect()) == list(range(50)) and found["two"].count() == found["three"].count() == 0
    told = sinks.manifest(spark, path)
    folder = f"{path.removeprefix('file://')}/{told['folder']}/files/one"
    victim = f"{folder}/{sorted(f for f in os.listdir(folder) if f.endswith('jsonl'))[0]}"
    with open(victim, "ab") as f:
        f.write(b"{}")
    with pytest.raises(ValueError, match="not as written"):
        sinks.read_lines(spark, path, {"one": "id long"})
    os.remove(victim)
    assert sinks.read_files(spark, path).where("NOT ok").count() == 1


def batches(*files):
    return iter([pa.RecordBatch.from_pydict({"file": [f], "name": ["n"], "payload": [p]}) for f, p in files])


def test_a_task_that_runs_again_leaves_one_file(spark, path, monkeypatch):
    monkeypatch.setattr(sinks.TaskContext, "get", classmethod(lambda cls: types.SimpleNamespace(partitionId=lambda: 3)))
    writer = sinks.FilesWriter({"path": path, "kind": "text"})
    writer.write(batches(("a", b"one"), ("b", b"two")))  # its message is lost with its executor
    told = writer.write(batches(("a", b"one"), ("b", b"two")))
    assert not os.path.exists(path.removeprefix("file://") + "/manifest.json")  # nothing is seen yet
    writer.commit([told, None])
    found = sinks.read_files(spark, path).collect()
    assert sorted((r["file"], bytes(r["content"]), r["ok"]) for r in found) == [("a", b"one", True), ("b", b"two", True)]
    assert not [f for _, _, names in os.walk(path.removeprefix("file://")) for f in names if "passing" in f]


def test_abort_and_sweep(spark, path, monkeypatch):
    monkeypatch.setattr(sinks.TaskContext, "get", classmethod(lambda cls: types.SimpleNamespace(partitionId=lambda: 0)))
    sinks.write_files(spark.createDataFrame([("a", "n", b"one")], "file string, name string, payload binary"), path)
    failed = sinks.FilesWriter({"path": path})
    failed.write(batches(("a", b"other")))
    failed.abort([])
    assert [bytes(r["content"]) for r in sinks.read_files(spark, path).collect()] == [b"one"]
    lost = sinks.FilesWriter({"path": path})
    lost.write(batches(("a", b"lost")))  # a driver that dies before it aborts
    assert sinks.swept(spark, path) == [lost.folder] and sinks.read_files(spark, path).where("ok").count() == 1
    with pytest.raises(ValueError, match="kind"):
        sinks.FilesWriter({"path": path, "kind": "x"})
    with pytest.raises(ValueError, match="unsafe"):
        failed.write(batches(("../x", b"")))


def test_a_failing_task_publishes_nothing(spark, path):
    bad = rows(spark).selectExpr("if(name = 'n013', '../evil', file) AS file", "name", "payload")
    with pytest.raises(Exception, match="unsafe"):
        sinks.write_files(bad, path)
    folder = path.removeprefix("file://")
    assert not os.path.exists(folder) or not os.listdir(folder)
