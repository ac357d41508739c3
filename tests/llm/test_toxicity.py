import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import toxicity

from ..oracle import FOLDER


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def made(n=1600, seed=3):
    """Texts of invented words; a tenth hold insults of a few stems, at a share of two in a hundred words at least."""
    rnd = random.Random(seed)
    clean = ["".join(rnd.choice("abdeghilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    bad = ["grumok", "zarpit", *(f"vexlo{e}" for e in ("a", "en", "tion", "ik", "ur", "os"))]
    docs, toxic = [], []
    for k in range(n):
        words = [clean[min(int(rnd.expovariate(0.004)), 2999)] for _ in range(rnd.choice([6, 30, 200, 900]))]
        toxic.append(int(rnd.random() < 0.1))
        for _ in range(toxic[-1] * (2 + len(words) // 60)):
            words.insert(rnd.randint(0, len(words)), rnd.choice(bad))
        docs.append((k, " ".join(words)))
    return docs, toxic


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "l", "s", 1, 2) for i, t in docs], "doc_id long, text string, lang string, source string, toxic int, member int")


@pytest.fixture(scope="module")
def world(spark):
    docs, toxic = made()
    labels = spark.createDataFrame([(k, t) for k, t in enumerate(toxic) if k % 3], "doc_id long, toxic int")
    return docs, toxic, labels, toxicity.train(frame(spark, docs), labels)


def test_held_out_accuracy(spark, world):
    docs, toxic, _, model = world
    rows = toxicity.score(frame(spark, docs), model).collect()
    assert all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    for part in (True, False):
        of = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] == part]
        hit = of.count((1, 1))
        assert hit / (hit + of.count((0, 1))) >= 0.9 and hit / (hit + of.count((1, 0))) >= 0.9


def test_held_out_labels_teach_nothing(spark, world):
    docs, toxic, labels, model = world
    lies = spark.createDataFrame([(k, 1 - t if fold(k) else t) for k, t in enumerate(toxic) if k % 3], "doc_id long, toxic int")
    again = toxicity.train(frame(spark, docs), lies)
    assert again.prior == model.prior and again.bias == model.bias and np.array_equal(again.weight, model.weight)


def test_a_score_is_of_the_text_alone(spark, world):
    model, text = world[3], "grumok vexlour some words"
    rows = toxicity.score(frame(spark, [(1, text), (2, text), (None, text), (1, text)]), model).collect()
    assert len({r["score"] for r in rows}) == 1 and [r["held_out"] for r in rows] == [fold(i) for i in (1, 2, None, 1)]
    # long texts are read to their end
    calm = " ".join(["tis an old and quiet word"] * 4000)
    a, b = (r["score"] for r in toxicity.score(frame(spark, [(1, calm), (2, calm + " grumok zarpit" * 400)]), model).orderBy("doc_id").collect())
    assert b > a


def test_odd_rows(spark, odd, empty, world):
    rows = toxicity.score(odd, world[3]).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 0), (5, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.train(odd, labels)).count() == odd.count()
    nothing = toxicity.train(empty, labels.limit(0))
    assert nothing.prior == 0 and {r["score"] for r in toxicity.score(odd, nothing).collect()} == {0.0}
    assert toxicity.score(empty, world[3]).count() == 0


def test_clean_risk_stays_non_negative():
    """Half of the unlabelled texts are as the confirmed ones, as the prior says; the walk back keeps the others' margins from running off."""
    rows = [np.array([1, 2, 3])] * 400 + [np.array([1, 2, 3]), np.array([4, 5, 6])] * 200
    weight, bias = toxicity.fit(rows, np.arange(800) < 400, 0.5)
    g = lambda r: bias + weight[r].sum() / np.sqrt(3)
    assert g(rows[0]) > 0 > g(rows[-1]) and max(abs(g(rows[0])), abs(g(rows[-1]))) < 30


def test_given_table(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == docs.count()
