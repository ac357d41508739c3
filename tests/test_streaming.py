from palimpsest.streaming import ingest

from .oracle import FOLDER, actual, expected


def test_windowed_counts_equal_the_batch(spark, tmp_path):
    source = f"{FOLDER}/events.parquet"
    schema = spark.read.parquet(source).schema
    spark.read.parquet(source).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in").selectExpr("cast(ts AS timestamp) ts", "event_type")
    query = ingest.windowed(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.table("windows").selectExpr("cast(date(start) AS string) AS d", "event_type", "n")
    assert actual(found) == expected("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, event_type, count(*) AS n FROM events GROUP BY ALL")


def test_search_without_tokens_is_a_substring_filter(spark):
    from palimpsest.operators import search

    rows = spark.createDataFrame([("k1", "a b"), ("k2", "c")], "key string, text string")
    assert [r["key"] for r in search.search(rows, "a").collect()] == ["k1"]
