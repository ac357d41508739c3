import random
from collections import Counter

import numpy as np

from palimpsest.llm import decontam

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().translate(LOWER).split()


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(docs, items):
    """Pairs with a window of the item's size whose weighted similarity is 0.75 or more."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            want, n = bag(v), len(v)
            best = 0
            for s in range(max(1, len(w) - n + 1)) if w and v else ():
                have = bag(w[s : s + n])
                both, all_ = sum((want & have).values()), sum((want | have).values())
                best = max(best, both / all_)
            if best >= 0.75:
                out[d, i] = round(best, 9)
    return out


def corpus(seed=2):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(draw(rnd.choice([3, 5, 6, 12, 25, 40, 60])))) for i in range(20)]
    items += [(20, "a b a b a b a b a b a b"), (21, None), (22, ""), (23, "two words")]
    docs = []
    for d in range(80):
        w = draw(rnd.randint(0, 80))
        for _ in range(rnd.randint(0, 2)):
            part = (rnd.choice(items)[1] or "").split()
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                if part:
                    part[rnd.randrange(len(part))] = rnd.choice(vocabulary)
            at = rnd.randint(0, len(w))
            w[at:at] = part
        docs.append((d, " ".join(w).upper() if d % 7 == 0 else "\n".join(w)))
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    found = {(r["doc_id"], r["item_id"]): round(r["common"] / r["united"], 9) for r in decontam.leaks(frame, bench).collect()}
    assert found == want
    monkeypatch.setattr(decontam, "ITEMS", 5)  # several blocks
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(frame, bench).collect()} == set(want)
    kept = {r["doc_id"] for r in decontam.keep(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_multi_index_is_complete():
    """The tables give every item for every fingerprint within the radius of its own, and no other."""
    rng, items = np.random.default_rng(1), corpus()[1]
    index = decontam.Index([(i, t) for i, t in items if t])
    for sized in index.sizes:
        own = sized.sign.view(np.uint8).reshape(-1, 16)
        for _ in range(40):
            flips = np.zeros((len(own), 128), np.uint8)
            for row in flips:
                row[rng.choice(128, rng.integers(0, 45), replace=False)] = 1
            sign = own ^ np.packbits(flips, axis=1)
            want = {(a, b) for a in range(len(own)) for b in range(len(own)) if np.bitwise_count(sign[a] ^ own[b]).sum() <= decontam.RADIUS}
            at, item, distance = sized.near(sign.view(np.uint64))
            assert set(zip(at.tolist(), item.tolist(), strict=True)) == want and (distance <= decontam.RADIUS).all()


def test_recall_of_the_radius():
    """Of windows whose exact similarity is 0.75 or a little more, in short and long items, at least 99 % lie within the radius."""
    rnd, found, total = random.Random(4), 0, 0
    for n in (7, 8, 10, 12, 20, 40, 60):
        for _ in range(150):
            words = [f"w{rnd.randrange(10**6)}" for _ in range(n + 4)]
            other, gone = list(words), 0
            while 4 * (n - gone - 1) >= 3 * (n + gone + 1):  # cut shingles from the end, one at a time
                gone += 1
                other = [*words[: len(words) - gone], *(f"x{rnd.randrange(10**6)}" for _ in range(gone))]
            sized = decontam.Index([(1, " ".join(words))]).sizes[0]
            found += len(sized.near(decontam.Index([(1, " ".join(other))]).sizes[0].sign)[0])
            total += 1
    print(f"recall of the radius at the least similarity: {found / total:.4f}")
    assert found >= 0.99 * total


def test_few_unrelated_fingerprints_pass():
    """Of random fingerprints the tables let less than a tenth through to the comparison of whole distances, and that lets none to the exact one."""
    rng, rnd = np.random.default_rng(3), random.Random(3)
    items = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30))) for i in range(200)]
    [sized] = decontam.Index(items).sizes
    sign = rng.integers(0, 1 << 63, (2000, 2), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (2000, 2), dtype=np.uint64)
    value, own = sign.view(np.uint16).reshape(-1, 1, decontam.BLOCKS), sized.sign.view(np.uint16).reshape(1, -1, decontam.BLOCKS)
    share = float((np.bitwise_count(value ^ own) <= decontam.REACH).any(2).mean())
    print(f"random fingerprints that share a block: {share:.4f}")
    assert share < 0.1 and not len(sized.near(sign)[0])


def test_many_items_of_one_size():
    """20,000 items of one size with a prompt line, against a document of 50 kB full of the line: seconds, and bounded memory."""
    import resource
    import time

    rnd = random.Random(9)
    line = "answer the question below with one of the four letters".split()
    draw = lambda n: [f"x{rnd.randrange(10**5)}" for _ in range(n)]
    items = [(i, " ".join(line + draw(20))) for i in range(20_000)]
    index = decontam.Index(items)
    words = []
    while sum(map(len, words)) < 50_000:
        words += line + draw(11)
    text = " ".join([*words, items[777][1], *words[:40]]).encode()
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    found = index.leaks(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 75)
    took, grown = time.time() - began, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    print(f"{took:.1f} s, {grown:.0f} MB more")
    assert [(f[0], f[1]) for f in found] == [(0, 777)] and took < 60 and grown < 1000


def test_line_of_all_items(spark):
    """A line that every item holds costs each document its windows, not its windows times the items."""
    line = "answer the question below with one of the four letters"
    items = [(i, f"{line} q{i} a{i} b{i} c{i} d{i} e{i} f{i} g{i}") for i in range(1500)]
    docs = [(d, f"{line} " * 5 + (items[d][1] if d % 2 else "nothing")) for d in range(40)]
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, d) for d in range(40) if d % 2}


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (None, "naïve café — 日本語テキスト 😀 #*$%"), (3, None)], "item_id long, text string")
    found = decontam.leaks(odd, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found if r["item_id"]) == [(1, 1), (1, 1)] and [r["doc_id"] for r in found if r["item_id"] is None] == [9]
    kept = decontam.keep(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontam.leaks(empty, bench).count() == 0 and decontam.keep(odd, bench.limit(0)).count() == odd.count()
