import random
import re
from collections import Counter, defaultdict

import pytest

from palimpsest.llm import divergence


def plain(rows, least, ranks=10):
    """The audit over (lang, source, text), every pair and every term, in Python's whole numbers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    holds, n = defaultdict(set), defaultdict(Counter)
    for k, (lang, source, text) in enumerate(rows):
        n[lang, source].update([])
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            holds[lang, w].add(k)
            n[lang, source][w] += 1
    out = []
    for lang in {g[0] for g in n}:
        kept = [w for (la, w), ids in holds.items() if la == lang and len(ids) >= least]
        groups = {s: {w: c[w] for w in kept} for (la, s), c in n.items() if la == lang}
        whole = {w: sum(c[w] for c in groups.values()) for w in kept}
        shares = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pair = [(-sum(f(p[s][w], p[o][w]) for w in kept), o) for o in groups if o != s]
            term = [(-f(p[s][w], q[w]), w) for w in kept if groups[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pair, None), ("term", term, ranks)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame([(k, t, la, s, 1, "g", "h") for k, (la, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, gid string, term string")
    return sorted(map(tuple, divergence.audit(df, **how).collect()))


def made(seed, size=120):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "naïve", "Ärger", "ärger", "日本", "x", *(f"w{chr(97 + i)}" for i in range(20))]
    text = lambda: " ".join(rnd.choice(words[: rnd.randint(1, len(words))]) + rnd.choice(["", ",", "1", "-"]) for _ in range(rnd.randint(0, 30)))
    return [(rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s3", "big", "big", "big", None]), rnd.choice([None, "", text(), text(), text(), text()])) for _ in range(size)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_every_pair_of_shares(spark, seed):
    rows = made(seed)
    assert found(spark, rows, least=3) == plain(rows, 3)


def test_blocks_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 2)
    entries = [(1, 5, 10, 1), (1, 3, 40, 2), (1, 9, 7, 1), (2, 9, 8, 1), (2, 3, 2, 2), (3, 3, 9, 2)]
    got = divergence.corrections(spark.createDataFrame(entries, "tid long, gid long, p long, zero long")).groupBy("g", "h").sum("value").collect()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    want = Counter()
    for t in (1, 2, 3):
        held = sorted((g, p, z) for i, g, p, z in entries if i == t)
        for i, (g, p, a) in enumerate(held):
            for h, q, b in held[i + 1 :]:
                want[g, h] += f(p, q) - f(p, b) - f(a, q) + f(a, b)
    assert {(g, h): v for g, h, v in got} == want


def test_odd_rows(spark, odd, empty):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, divergence.audit(odd, least=2).collect())) == plain(rows, 2)
    assert divergence.audit(empty).count() == 0
    # no kept term: pairs of value 0, ranked by name
    assert found(spark, [("en", "a", "one"), ("en", None, "two"), ("en", "b", None)]) == plain([("en", "a", "one"), ("en", "", "two"), ("en", "b", "")], 10)


def test_counts_beyond_64_bits_of_product(spark):
    got = spark.range(1).select(divergence.share(divergence.F.lit(10**12), divergence.F.lit(3 * 10**12)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (10**12 + 2) // (3 * 10**12)
