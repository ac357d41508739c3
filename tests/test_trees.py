"""Hash trees: what a comparison and a restore read, and what they miss."""

from palimpsest.operators import objects


def nodes(spark, n, changed=()):
    return spark.createDataFrame([("c", k, f"n{k}", f"text {k}" + ("!" if k in changed else "")) for k in range(n)], "conversation_id string, ordinal long, node_id string, payload string")


def tops(plan):
    return plan.where("kind = 'manifest'").select("conversation_id", "key")


def test_an_appended_pair_reads_one_chunk_of_each_side(spark):
    old, new = objects.plan(nodes(spark, 1000), 64), objects.plan(nodes(spark, 1002, {5}), 64)
    changed, read, absent = objects.tree_difference(tops(old), tops(new), old.unionByName(new), 64)
    assert {(r["ordinal"], r["change"]) for r in changed.collect()} == {(5, "updated"), (1000, "added"), (1001, "added")}
    assert {(r["level"], r["n"]) for r in read.groupBy("level").agg(objects.F.count("*").alias("n")).collect()} == {("manifest", 2), ("chunk", 4)}
    assert absent.count() == 0
    gone, _, _ = objects.tree_difference(tops(new), tops(old), old.unionByName(new), 64)
    assert {r["change"] for r in gone.where("ordinal >= 1000").collect()} == {"removed"}
    assert objects.tree_difference(tops(old), tops(old), old, 64)[0].count() == 0


def test_missing_objects_are_told_by_level(spark):
    plan = objects.plan(nodes(spark, 100), 16)
    payloads = nodes(spark, 100).selectExpr("concat('node:', sha2(payload, 256)) AS key", "payload")
    rows, absent = objects.restore(tops(plan), plan, payloads, 16)
    assert [r["payload"] for r in rows.orderBy("ordinal").collect()] == [f"text {k}" for k in range(100)] and absent.count() == 0
    chunk = plan.where("kind = 'chunk'").first()["key"]
    rows, absent = objects.restore(tops(plan), plan.where(objects.F.col("key") != chunk), payloads, 16)
    assert rows.count() == 0 and [(r["level"], r["key"]) for r in absent.collect()] == [("chunk", chunk)]
    rows, absent = objects.restore(tops(plan), plan, payloads.where("payload <> 'text 7'"), 16)
    assert rows.count() == 0 and [r["level"] for r in absent.collect()] == ["node"]
