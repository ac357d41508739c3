import random

from palimpsest.llm import neardup

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    words = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """Components of documents by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def corpus(seed=4, families=6, copies=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(families):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([6, 40, 120, 400]))]
        for _ in range(copies):
            words = base[:]
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 8])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((len(rows), rnd.choice([" ", "\n"]).join(words).upper() if rnd.random() < 0.2 else " ".join(words)))
    return rows


def test_components(spark):
    rows = corpus()
    found = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows)
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(shingles(t)) for i, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_mixed_buckets(spark):
    """Copies that each differ from the first too much, but link among themselves, are found across components."""
    base = [f"w{i}" for i in range(60)]
    far = base[:50] + [f"x{i}" for i in range(10)]
    rows = [(0, " ".join(base)), (1, " ".join(far)), (2, " ".join(far[:-1] + ["y"])), (3, " ".join(base[:-1]))]
    found = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows)


def test_across_loses_no_pair(spark):
    rows = corpus(9, 3, 15)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = neardup.packed(docs)
    pairs = {tuple(r) for r in neardup.across(docs.selectExpr("doc_id AS id", "doc_id AS c"), texts, 75).collect()}
    sets = [(i, shingles(t)) for i, t in rows]
    for i, a in sets:
        for j, b in sets[:i]:
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                assert (i, j) in pairs


def test_odd_rows(odd, empty):
    rows = neardup.groups(odd).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 10}
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    kept = neardup.keep(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IN (6, 8)").count() == 0 and kept.count() == odd.count() - 2
    assert neardup.groups(empty).count() == 0


def test_a_common_passage_in_few_components(spark):
    """Thousands of copies that share a long passage, in few components: tokens of one component bring none together, and none is lost."""
    rnd = random.Random(12)
    line = [f"legal{i}" for i in range(30)]
    rows = []
    for family in range(4):
        own = [f"f{family}x{i}" for i in range(8 + family)]
        for k in range(600):
            words = line + own
            words[rnd.randrange(len(words))] = f"o{family}k{k % 40}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.groups(docs).collect()}
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), i)
    # equal sets are one, so that the brute force compares different texts only
    want = brute([(i, next(t for j, t in rows if j == i)) for i in sets.values()])
    assert all(found[i] == want[sets[shingles(t)]] for i, t in rows)
