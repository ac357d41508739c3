import numpy as np

import corpus_pipeline
from palimpsest.llm import pieces, quality
from palimpsest.llm.queries import tokenizer

from . import test_decontam, test_neardup, test_quality

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4]
    final = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()}
    model = pieces.load(tokenizer("piece_bpe_32k.model"))
    assert {r["doc_id"]: model.library.encode(r["text"], add_eos=True) for r in docs.collect()} == {i: r["ids"] for i, r in final.items()}
    whole = corpus_pipeline.run(spark, FOLDER)
    assert {(r["doc_id"], r["ids_sha256"]) for r in whole.collect()} == {(i, r["ids_sha256"]) for i, r in final.items()}


def test_stages_take_odd_rows(spark, odd, empty):
    """Null and repeated ids, null, empty and long texts, clashing names, and no rows at all, through every stage."""
    extra = ("id", "part", "kind", "clean_text", "gone_id")
    for rows in (odd, empty):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, stage(spark, docs, FOLDER).cache()
            assert docs.columns == before.columns and set(extra) <= set(docs.columns)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
        assert out.count() == docs.count()


def without_repeats(rows):
    """Texts without bytes that a string of 100 bytes covers which also starts earlier."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(data[s : s + 100])
        out[i] = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    return out


def test_against_brute_force(spark):
    """Each stage of the pipeline over the given table, document by document and pair by pair; ids by the library."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality.train(spark, frame, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = {}
    for i, text in docs.items():
        n, *_, repeated = test_quality.base(text)
        m = quality.measure(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
        content = m["line_words"][quality.viterbi(m["line_doc"], m["line_code"], model) == 0].sum()
        if n >= 20 and 100 * repeated <= 30 * n and content >= 0.5 * n:
            kept[i] = text
    root = test_neardup.brute(list(kept.items()))
    kept = without_repeats([(i, t) for i, t in kept.items() if root[i] == i])
    grams = {g for _, t in items for g in test_decontam.bag(test_decontam.words(t))}
    leaks = {i for i, t in kept.items() if grams & set(test_decontam.bag(test_decontam.words(t))) and test_decontam.brute([(i, t)], items)}
    library = pieces.load(tokenizer("piece_bpe_32k.model")).library
    want = {i: library.encode(t, add_eos=True) for i, t in kept.items() if i not in leaks}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and len(leaks) > 0 and len(want) < len(docs)
