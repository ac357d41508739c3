"""The similarity join against scoring every pair."""

import random

import pytest

from palimpsest.operators import scoring
from palimpsest.functions.text import similarity


@pytest.mark.parametrize(("seed", "least"), [(1, 0.55), (2, 0.9), (3, 0.3), (4, 1.0)])
def test_equals_all_pairs(spark, seed, least):
    rnd = random.Random(seed)
    words = ["a", "the", "of", "alpha", "beta", "gamma", "検索", "検索する", "x.y", "...", "Über"]
    text = lambda: rnd.choice([None, "", " ", "ab", "a", "b a", "検", *[" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 7)))] * 9])
    one, two = ([(rnd.choice(["p", "q"]), k, text()) for k in range(70)] for _ in "ab")
    two += [(c, 100 + k, (t or "")[1:-1] + rnd.choice(["", "s"])) for c, k, t in one[:30]]
    a, b = (spark.createDataFrame(rows, "case string, id long, text string") for rows in (one, two))
    pairs = a.withColumnsRenamed({"id": "a", "text": "x"}).join(b.withColumnsRenamed({"id": "b", "text": "y"}), "case").select("case", "a", "b", similarity("x", "y").alias("similarity")).where(f"similarity >= {least}")
    want, got = (sorted(tuple(r) for r in df.collect()) for df in (pairs, scoring.alike(a, b, "case", least)))
    assert got == want and (least == 1.0 or len(want) > 50)
