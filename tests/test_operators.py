"""Properties: order of rows does not matter, repeating changes nothing."""

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import text as T
from palimpsest.functions.driver import query_tokens
from palimpsest.operators import gate, merge, objects, scoring, sequences


def test_cjk_tokens(spark):
    row = spark.createDataFrame([("検索abc",)], "t string").select(T.tokens("t").alias("x")).first()
    assert set(row["x"]) == {"abc", "検", "索", "検索"} == set(query_tokens("検索ABC"))


def test_estimates_differ(spark):
    row = spark.createDataFrame([("検索検索 abcd",)], "t string").select(T.estimate("t").alias("a"), T.estimate_package("t").alias("b")).first()
    assert (row["a"], row["b"]) == (6, 6)


def test_budget_skips(spark):
    rows = spark.createDataFrame([("p", 1, False, 60, 3, 0), ("p", 2, False, 50, 2, 0), ("p", 3, False, 30, 1, 0), ("p", 4, True, 20, 0, 0)], "project_id string, id int, locked boolean, tokens int, score int, updated_at int")
    found = {r["id"]: r["taken"] for r in gate.budgeted(rows, 100).collect()}
    assert found == {1: True, 2: False, 3: True, 4: True}
    stopped = gate.stopped(rows, 100, "project_id", "tokens", [rows["score"].desc()])
    assert {r["id"]: r["taken"] for r in stopped.collect()} == {1: True, 2: False, 3: False, 4: False}


def test_fragments(spark):
    rows = spark.createDataFrame([("c", i, g, t) for i, (g, t) in enumerate([("a", "He"), ("a", "Hello"), ("a", "Hell"), ("a", " you"), ("b", "x")])], "k string, i int, g string, text string")
    assert [r["text"] for r in sequences.coalesced(rows, "k", "i", ["g"]).orderBy("first").collect()] == ["Hello you", "x"]


def test_cyclic_closure(spark):
    rows = spark.createDataFrame([("a", ["b"]), ("b", ["c"]), ("c", ["a"]), ("z", ["a"])], "key string, refs array<string>")
    start = spark.createDataFrame([("a",)], "key string")
    assert {r["key"] for r in objects.closure(start, rows).collect()} == {"a", "b", "c"}
    assert {r["key"] for r in objects.garbage(rows, start).collect()} == {"z"}


def test_appending_changes_one_chunk(spark):
    nodes = spark.range(1000).selectExpr("'c' conversation_id", "id ordinal", "cast(id AS string) node_id", "concat('text ', id) payload")
    more = spark.range(1003).selectExpr("'c' conversation_id", "id ordinal", "cast(id AS string) node_id", "concat('text ', id) payload")
    got = {r["kind"]: (r["inserted"], r["reused"]) for r in objects.reuse(objects.plan(more), objects.plan(nodes).select("key").distinct()).collect()}
    assert got == {"node": (3, 1000), "chunk": (1, 3), "manifest": (1, 0)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=12), st.randoms())
def test_fingerprint_ignores_order(spark, rows, random):
    mixed = rows[:]
    random.shuffle(mixed)
    prints = [objects.fingerprint(spark.createDataFrame(r, "a int, b int"), "a", "b").first()[0] for r in (rows, mixed)]
    assert prints[0] == prints[1]


def test_upsert_again_is_duplicate(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "key int, digest string, updated_at int")
    none = rows.where("key < 0")
    once = merge.applied(none, rows)
    assert {r["status"] for r in merge.upsert(once, rows).collect()} == {"duplicate"}
    assert merge.applied(once, rows).count() == 2


def test_greedy_match(spark):
    """Against a loop over expected items in order; ties go to the smaller answer."""
    import random

    rnd = random.Random(6)
    pairs = [(c, e, a, round(rnd.choice([0.2, 0.5, 0.55, 0.7, 0.7, 0.9]), 2)) for c in range(6) for e in range(7) for a in range(rnd.randint(0, 7))]
    rnd.shuffle(pairs)
    want, used = set(), set()
    for c, e in sorted({(c, e) for c, e, _, _ in pairs}):
        able = [(-s, a) for c2, e2, a, s in pairs if (c2, e2) == (c, e) and s >= 0.55 and (c, a) not in used]
        if able:
            used.add((c, min(able)[1]))
            want.add((c, e, min(able)[1]))
    found = scoring.matched(spark.createDataFrame(pairs, "case int, e int, a int, score double").repartition(3)).where("taken")
    assert {(r["case"], r["e"], r["a"]) for r in found.collect()} == want


def test_closure_of_a_long_chain(spark):
    """A chain of more references than any fixed number of rounds."""
    chain = spark.range(80).selectExpr("concat('k', id) key", "array(concat('k', id + 1)) refs")
    assert objects.closure(spark.createDataFrame([("k0",)], "key string"), chain).count() == 81
