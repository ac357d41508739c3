"""A stored index against the texts themselves, and what a lookup reads."""

import random

from palimpsest.functions.driver import query_tokens
from palimpsest.operators import index
from palimpsest.sources import committed


def holding(texts, query):
    wanted = set(query_tokens(query))
    return sorted(k for k, t in texts.items() if wanted and wanted <= set(query_tokens(t or "")))


def test_equals_the_texts_through_changes(spark, tmp_path):
    rnd, store, texts = random.Random(4), f"file://{tmp_path}/i", {}
    words = ["alpha", "beta", "gamma", "delta.x", "検索", "eps-ilon"]
    for round_ in range(4):
        new = {f"k{rnd.randint(0, 40)}": " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))) for _ in range(25)}
        texts |= new
        index.add(spark, store, spark.createDataFrame(list(new.items()), "key string, text string"))
        gone = rnd.sample(sorted(texts), 4)
        index.remove(spark, store, spark.createDataFrame([(k,) for k in gone], "key string"))
        for k in gone:
            del texts[k]
        if round_ == 2:
            index.compact(spark, store)
        for query in ("alpha", "beta gamma", "検索 alpha", "nothing", "..."):
            assert sorted(r["key"] for r in index.holding_all(spark, store, query).collect()) == holding(texts, query)


def test_a_lookup_reads_its_buckets_only(spark, tmp_path):
    store = f"file://{tmp_path}/i"
    rows = spark.range(3000).selectExpr("cast(id AS string) key", "concat('common word', id % 300) text")
    index.add(spark, store, rows)
    found = index.lookup(spark, store, ["word7"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan, plan
    assert "word7" in plan.split("PushedFilters")[1].split("]")[0]
    every = committed.snapshot(spark, store).tables["postings"]
    assert found.count() == 10
    [only] = index.buckets_of(spark, ["word7"])
    assert {r["bucket"] for r in every.where("token = 'word7'").select("bucket").distinct().collect()} == {only}


def test_an_old_version_stays_readable(spark, tmp_path):
    store = f"file://{tmp_path}/i"
    first = index.add(spark, store, spark.createDataFrame([("a", "one two")], "key string, text string"))
    index.remove(spark, store, spark.createDataFrame([("a",)], "key string"))
    assert index.lookup(spark, store, ["one"]).count() == 0 and index.lookup(spark, store, ["one"], first).count() == 1
    index.compact(spark, store)
    assert index.lookup(spark, store, ["one"]).count() == 0 and index.lookup(spark, store, []).count() == 0
