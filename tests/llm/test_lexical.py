import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import lexical


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, most=10):
    """Every document of every item scored, in Python's whole numbers."""
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words(text)) if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        scored.sort(key=lambda x: x[:3])
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(scored[:most])]
    return sorted(out, key=repr)


def found(spark, docs, items, parts=3, **how):
    d = spark.createDataFrame([(t, i, "x", 1, 2) for i, t in docs], "text string, doc_id long, item string, n long, term int").repartition(parts)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in lexical.rank(d, q, **how).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def made(seed, size=400):
    rnd = random.Random(seed)
    common, rare = ["the", "of", "And", "naïve", "日本"], [f"w{i}" for i in range(80)]
    text = lambda most: " ".join(rnd.choice(common if rnd.random() < 0.6 else rare) + rnd.choice(["", "-", "_", ".x"]) for _ in range(rnd.randint(0, most)))
    docs = [(k, text(40)) for k in range(size)]
    docs += [(size + k, docs[rnd.randint(0, 9)][1]) for k in range(size // 2)]  # copies: ties beyond the tenth
    return docs + [(None, docs[3][1]), (3, docs[3][1]), (7777, None), (7778, ""), (7779, "...")], [(k, text(12)) for k in range(15)] + [(90, None), (91, ""), (5, "the w1"), (5, "the w1")]


@pytest.mark.parametrize(("seed", "parts", "shard"), [(1, 3, 1 << 15), (2, 1, 64), (3, 7, 1)])
def test_equals_scoring_every_document(spark, monkeypatch, seed, parts, shard):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "FAN", 4)
    docs, items = made(seed)
    assert found(spark, docs, items, parts) == plain(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    docs, items = made(4, 60)
    assert found(spark, docs, items, most=3) == plain(docs, items, 3)


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "quick brown FOX"), (2, "word1 more2 here"), (3, None)], "item_id int, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r) for r in lexical.rank(odd, items).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == plain(docs, [tuple(r) for r in items.collect()])
    assert lexical.rank(empty, items).count() == 0 and lexical.rank(odd, items.limit(0)).count() == 0


def test_bounds_leave_most_ranges_closed():
    """One document holds the rare terms: the trees lead to it without opening the rest."""
    size, opened = 1 << 14, []
    place = np.arange(size)
    trees = lexical.Trees(np.array([0, 1]), np.array([size, 10]), np.concatenate([place, place[100:110]]), np.concatenate([np.ones(size, np.int64), np.full(10, 50)]))
    real = trees.opened
    trees.opened = lambda level, entries: opened.append(len(entries)) or real(level, entries)
    best = lexical.best_first(trees, np.array([0, 1]), place, [], 10)
    assert best == [(-51, 100 + k) for k in range(10)] and sum(opened) < 100


def test_long_documents_leave_64_bits():
    n = np.array([10**7, 5])
    assert lexical.lengths(n, 10**11, 10**14).tolist() == [10 + 90 * 10**7 * 10**11 // 10**14, 10 + 90 * 5 * 10**11 // 10**14]
