import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import repeats


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - 99):
            if text[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(text[s : s + 100])
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        opens = gone & ~np.concatenate([[False], gone[:-1]]) if len(text) else gone
        out[i] = (len(text), int(gone.sum()), int(opens.sum()), hashlib.sha256(kept).hexdigest())
    return out


def results(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_cover():
    assert {(a - b) % repeats.V for a in repeats.D for b in repeats.D} == set(range(repeats.V))


def corpus(seed):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abcdefgh éß") for _ in range(4000))
    rows = []
    for i in range(40):
        parts = [base[a : a + rnd.choice([5, 99, 100, 101, 140, 260])] for a in (rnd.randrange(3700) for _ in range(rnd.randint(0, 6)))]
        rows.append((i, "".join(parts)))
    return [*rows, (50, "ab" * 300), (51, "ab" * 200), (52, "a" * 99), (53, "a" * 100), (54, "a" * 500), (55, "")]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        found = repeats.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert results(found) == brute([(i, t.encode()) for i, t in rows])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=30), st.lists(st.binary(min_size=50, max_size=50), max_size=9))
def test_pack(numbers, tuples):
    numbers, tuples = np.array(sorted(numbers), np.int64), np.array(tuples, "S50")
    a, b, c = repeats.unpack(repeats.pack(repeats.steps(numbers), tuples, numbers.astype(np.uint16)))
    assert (np.cumsum(a) == numbers).all() and (b == tuples).all() and (c == numbers.astype(np.uint16)).all()


def test_equal_fingerprints_decide_nothing(spark, monkeypatch):
    """Fingerprints of 4 bits put nearly every tuple among the candidates; bytes alone decide."""
    real = repeats.POLY.ranges
    monkeypatch.setattr(repeats.POLY, "ranges", lambda *a: real(*a) & np.uint64(15))
    rows = corpus(3)
    assert results(repeats.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute([(i, t.encode()) for i, t in rows])


def test_many_blocks_and_ranges(spark, monkeypatch):
    """Small chunks, blocks and ranges give the same rows."""
    for name, value in (("CHUNK", 700), ("BLOCK", 37), ("PART_BYTES", 1500)):
        monkeypatch.setattr(repeats, name, value)
    rows = corpus(4)
    assert results(repeats.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute([(i, t.encode()) for i, t in rows])


def test_kept_texts(spark):
    passage = "This passage is shared by many documents and is longer than one hundred bytes, so that all but one lose it. " * 2
    rows = [(i, f"Start {i} é. {passage} End {i}.", 5) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    out = {r["doc_id"]: r for r in repeats.keep(docs).collect()}
    assert out[0]["text"].count("shared by many") == 1 + (out[0]["text"] == rows[0][1])
    assert all("shared by many" not in out[i]["text"] and out[i]["text"].startswith(f"Start {i}") and out[i]["text"].endswith(f"{i}.") and out[i]["n_chars"] == len(out[i]["text"]) for i in (1, 2, 3))


def test_odd_rows(odd, empty):
    rows = repeats.digest(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_removed"] for r in by[1]] == [0, 0] and by[2][0]["n_bytes"] == 0 and by[10][0]["n_removed"] == 4999
    long = by[8][0]
    assert long["n_removed"] >= long["n_bytes"] - 4
    kept = repeats.keep(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert repeats.digest(empty).count() == 0 and repeats.keep(empty).count() == 0
