from palimpsest.llm import sharding


def check(rows, limit):
    shards = {}
    for r in rows:
        shards.setdefault((r["depth"], r["prefix"]), []).append(r)
    for (depth, prefix), members in shards.items():
        total = sum(m["n_bytes"] for m in members)
        assert all((m["shard_bytes"], m["shard_rows"]) == (total, len(members)) for m in members)
        assert total <= limit or all(m["oversized"] for m in members)
        assert all(len(m["bits"]) == depth and int(m["bits"] or "0", 2) == prefix for m in members)
        if depth:  # the parent was too large: only such buckets split
            inside = [r for r in rows if r["bits"].startswith(members[0]["bits"][:-1])]
            assert sum(r["n_bytes"] for r in inside) > limit
    return shards


def test_buckets(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('x', cast(10 + id % 50 AS int)) AS text")
    rows = sharding.assign(docs, limit=400).collect()
    assert len(rows) == 500 and len(check(rows, 400)) > 30 and not any(r["oversized"] for r in rows)
    assert len(check(sharding.assign(docs, limit=10**9).collect(), 10**9)) == 1


def test_hot_key_and_giant(spark):
    """Rows of one key cannot be parted; they and a giant row stand marked, all else fits."""
    docs = spark.range(60).selectExpr("if(id < 30, 7, id) AS doc_id", "repeat('x', if(id = 59, 5000, 20)) AS text")
    rows = sharding.assign(docs, limit=100).collect()
    check(rows, 100)
    over = {r["doc_id"] for r in rows if r["oversized"]}
    assert over == {7, 59} and len(rows) == 60


def test_odd_rows(odd, empty):
    rows = sharding.assign(odd, limit=1000).collect()
    check(rows, 1000)
    assert len(rows) == odd.count() and sorted(r["n_bytes"] for r in rows) == sorted(len((r["text"] or "").encode()) for r in odd.collect())
    assert sharding.assign(empty).count() == 0
