import itertools
import random
import re
from collections import Counter

import numpy as np

from palimpsest.llm import quality


def base(text):
    """The base counts, word by word."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def clean(k):
    rnd = random.Random(k)
    return "\n".join(" ".join(rnd.choice("plain words make a text that reads well enough for this small test of ours".split()) for _ in range(12)) + "." for _ in range(6))


def junk(k):
    return "\n".join("BUY!! NOW!! CHEAP!! " + " ".join(f"OFFER{k}{i}{j}!!" for j in range(9)) for i in range(5))


def test_counts(spark, odd):
    rows = [(i, t) for i, t in enumerate([r["text"] for r in odd.collect()] + [clean(1) + "\n" + clean(1), junk(2), "a b\na b\n\na b \n" * 9, "x " * 40])]
    found = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), quality.default_weights()).collect()}
    for i, text in rows:
        r, want = found[i], base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        model = {"emit": rng.normal(size=len(quality.FEATURES) + 1).tolist(), "step": rng.normal(size=(2, 2)).tolist()}
        code = rng.integers(0, 1 << len(quality.FEATURES), n)
        emit = quality.bits(code) @ np.array(model["emit"])
        score = lambda path: sum(emit[i] for i in range(n) if path[i]) + sum(model["step"][path[i]][path[i + 1]] for i in range(n - 1))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(quality.viterbi(np.zeros(n, int), code, model)) == best


def test_held_out(spark):
    """Fitted on some documents, the labels hold on others."""
    docs = spark.createDataFrame([(k, junk(k) if k % 3 == 0 else clean(k)) for k in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(60)], "doc_id long, quality int, toxic int")
    model = quality.train(spark, docs, labels)
    rest = quality.judge(docs.where("doc_id >= 60"), model).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 != 0) for r in rest)
    assert {r["doc_id"] for r in quality.keep(docs, model).collect()} == {k for k in range(120) if k % 3}


def test_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(spark, odd, none) == quality.default_weights()
    kept = quality.keep(odd, quality.default_weights())
    assert kept.columns == odd.columns
    assert quality.judge(odd, quality.default_weights()).count() == odd.count()
    assert quality.judge(empty, quality.default_weights()).count() == 0 and quality.keep(empty, quality.default_weights()).count() == 0


def test_fit_takes_chains_by_length(monkeypatch):
    """However the chains are cut into tables, the weights are the same."""
    import random

    import numpy as np

    rnd = random.Random(2)
    chains = [np.array([rnd.choice([0, 0, 1, 4, 33]) for _ in range(rnd.choice([1, 2, 5, 40, 90]))]) for _ in range(60)]
    labels = [rnd.randint(0, 1) for _ in chains]
    one = quality.fit(chains, labels)
    monkeypatch.setattr(quality, "by_length", lambda s: [[i] for i in range(len(s))])
    two = quality.fit(chains, labels)
    assert np.allclose(one["emit"], two["emit"], atol=1e-6) and np.allclose(one["step"], two["step"], atol=1e-6)


def test_held_out_labels(spark):
    """Kept documents are those of good quality on labelled rows that the chain was not fitted on."""
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit("split")), F.lit(2))
    model = quality.train(spark, docs, labels.where(half == 0))
    judged = quality.judge(docs, model).join(labels.where(half == 1), "doc_id")
    good, bad = (judged.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    print(f"kept of good {good:.3f}, of bad {bad:.3f}")
    assert good > 0.9 and (good + 1 - bad) / 2 >= 0.9  # balanced accuracy
