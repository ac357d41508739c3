"""What the findings of round 3 named, on small tables that show it."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import api
from palimpsest.functions import text as T
from palimpsest.operators import canonical, gate, integrity, packing
from palimpsest.plans import catalogue, governed, sourced, stored  # noqa: F401
from palimpsest.sources import paged, sinks


def like_sql(spark, name, folder):
    """Compare a query over a folder of tables with its SQL."""
    con = duckdb.connect()
    for f in folder.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}/*.parquet'")
    found = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    rows = found.fetchall()
    got = catalogue.QUERIES[name](spark, f"file://{folder}").select(*names).collect()
    assert rows and sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")


def test_device_names_are_the_sql_s(spark, tmp_path):
    texts = ["Aux.", "Con.", "nul", "Com1. ", "Aux de", "...", "a: b"]
    documents(spark, tmp_path, [(k, x, "fr", "src0", len(x)) for k, x in enumerate(texts)])
    like_sql(spark, "safe_filenames", tmp_path)
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(T.safe_filename("x")).collect()] == ["_Aux", "_Con", "_nul", "_Com1", "Aux de", "untitled", "a- b"]


@pytest.fixture
def talks(spark, tmp_path):
    """2,100 conversations that all hold the words, one of them 7 times."""
    rows = spark.range(2107).select((F.col("id") % 2100).alias("conv_id"), F.when(F.col("id") < 2100, 0).otherwise(F.col("id") - 2099).alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("the "), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), F.lit(" and")).alias("text"))
    rows.where("conv_id > 5").union(rows.where("conv_id <= 5").withColumn("conv_id", F.lit(5)).withColumn("turn", F.monotonically_increasing_id())).write.parquet(f"file://{tmp_path}/conversations.parquet")
    documents(spark, tmp_path, [(0, "a", "en", "src0", 1)])
    return tmp_path


def test_context_pack_ranks_all_that_is_found(spark, talks):
    like_sql(spark, "tool_context_pack", talks)


def test_context_pack_takes_what_fits(spark, talks):
    b = governed.bundle(catalogue.Tables(spark, f"file://{talks}"))
    found = api.context_pack(b, "the and", 2048)
    again = gate.stopped(found.drop("taken", "used"), 2048, "pack", "tokens", [F.desc("score"), "key"])
    rows = sorted(map(tuple, found.select("key", "tokens", "taken", "used").collect()))
    assert len(rows) > 2000 and 0 < sum(r[2] for r in rows) < len(rows) and rows == sorted(map(tuple, again.select("key", "tokens", "taken", "used").collect()))


def test_lines_of_one_file_are_spread(spark, tmp_path):
    """All documents are of one language: their file is written and numbered in parts, none of which has most of it."""
    folder = tmp_path / "in"
    folder.mkdir()
    documents(spark, folder, [(k, f"text {k} " + "x" * 200, "en", "src0", 1) for k in range(4000)])
    like_sql(spark, "line_imports", folder)
    rows = spark.range(4000).selectExpr("'en.jsonl' AS file", "lpad(id, 12, '0') AS name", "CAST(id AS STRING) AS payload")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small parts are put together again
    try:
        sinks.write_files(rows, f"file://{tmp_path}/out", "lines", in_order=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    told = sinks.read_files(spark, f"file://{tmp_path}/out").orderBy("file").collect()
    assert len(told) > 1 and max(r["rows"] for r in told) < 3000
    assert b"".join(bytes(r["content"]) for r in told) == b"".join(b"%d\n" % k for k in range(4000))


def test_tasks_of_pages_are_bounded(tmp_path):
    """Any number of pages is read by a bounded number of tasks, every position once, and the last page is found without reading those before it."""
    stored = tmp_path / "pages"
    stored.mkdir()
    for page in range(300):
        (stored / f"page-{page:05}.jsonl").write_text("".join(f"{k}\n" for k in range(page * 10, min(2995, page * 10 + 10))))
    reader = paged.OffsetStream({"fetch": "palimpsest.sources.paged:stored_offsets", "at": str(stored), "limit": "3", "tasks": "7"})
    end = reader.latestOffset()
    parts = reader.partitions({"position": 5}, end)
    assert end == {"position": 2995} and len(parts) <= 7
    assert [r for p in parts for r in reader.read(p)] == [(k, str(k)) for k in range(5, 2995)]
    batch = paged.PagedReader({"fetch": "palimpsest.sources.paged:stored_offsets", "at": str(stored), "limit": "4"})
    assert len(batch.partitions()) <= 256 and [r[0] for p in batch.partitions() for r in batch.read(p)] == list(range(2995))
    for page in range(100, 300):
        (stored / f"page-{page:05}.jsonl").unlink()
    assert paged.stored_offsets(str(stored), 998, 5) == ([998, 999], 1000)


def test_volumes_are_numbered_batch_by_batch(spark):
    """A task keeps the open volume between batches, not the rows: any cut of them gives the same volumes, and keys go on from batch to batch."""
    rnd = np.random.default_rng(3)
    for planned in (None, (2, 4, 5), (3, 1 << 62, 0)):
        for reserve in (0, 6):
            sizes = rnd.integers(0, 9, 60).astype(np.int64)
            whole = packing.Numbered(10, reserve, planned)(sizes)
            for step in (1, 4, 7):
                now = packing.Numbered(10, reserve, planned)
                assert np.concatenate([now(sizes[k : k + step]) for k in range(0, 60, step)]).tolist() == whole.tolist()
    rows = [(None if k % 5 == 0 else f"k{k % 5}", k, k * 7 % 11) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, s long")
    want = {(r["k"], r["i"]): r["volume"] for r in packing.volumes(df, 20, "k", "s", ["i"], 3).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r["k"], r["i"]): r["volume"] for r in packing.volumes(df, 20, "k", "s", ["i"], 3).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_graphs_are_parsed_once(spark, tmp_path):
    """The report reads nodes that are parsed and stored, not the raw texts again in each of its joins."""
    documents(spark, tmp_path, [(k, f"text {k}", "en", "src0", 1) for k in range(40)])
    raw = governed.forked(catalogue.Tables(spark, f"file://{tmp_path}"))
    plan = integrity.report(canonical.nodes(raw), canonical.heads(raw))._jdf.queryExecution().optimizedPlan().toString()
    assert "mapping" not in plan and "doc_id" not in plan
    like_sql(spark, "forked_integrity", tmp_path)
