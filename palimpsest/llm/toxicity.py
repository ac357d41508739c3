"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over hashed words and word beginnings are fitted from texts
that labels confirm as toxic and from unlabelled texts, whatever labels say of
those.  With a class prior c the risk of a classifier g is

    c E_toxic[loss(g)] + max(0, E_unlabelled[loss(-g)] - c E_toxic[loss(-g)])

whose second part is the clean texts' risk, as unlabelled texts are toxic in the
share c; where a batch makes it negative, which only overfitting can, its slope is
walked back.  Each of ``MEMBERS`` classifiers has all confirmed texts of the
sample and a share of the unlabelled ones, is fitted in a task of its own, and
their weights are averaged.  The prior is the toxic share of the labelled rows.

Labels are learned from rows of the training fold only (crc32 of the id's text
modulo 4 is not 2), and unlabelled texts are taken from it, too.  A score depends
on nothing but the text.

Defined cases: a null or empty text, or one without words, has the score of the
intercept; a null id is in the training fold; repeated rows are scored each and
learned once an id (the least text); an id with several labels is toxic if one
says so; other columns are ignored; without confirmed texts or without clean
labels the score is the prior (0 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .terms import ALNUM, terms

#: Bounds of the sample that classifiers are fitted on: about so many confirmed and unlabelled texts, of at most so many bytes.
SAMPLE_TOXIC, SAMPLE_UNLABELLED, SAMPLE_BYTES = 3000, 12_000, 20_000
#: Classifiers whose weights are averaged; buckets of hashed features; bytes of word beginnings.
MEMBERS, BUCKETS, BEGINNINGS = 3, 1 << 20, (4, 5)
#: Standard deviations by which the confirmed texts that hold a feature must miss their number by chance, for it to bear weight.
EVIDENCE = 5.0
THRESHOLD = 0.3
POLY = tk.Poly(12)


@dataclass(frozen=True)
class Model:
    prior: float
    weight: np.ndarray | None = None
    bias: float = 0.0


def buckets(words: pa.Array) -> np.ndarray:
    """Hashed features of distinct words, a row each: the word and its beginnings (a short word's are the word again)."""
    data, offsets = tk.flat(words)
    prefix, start, end = POLY.prefix(data), offsets[:-1], offsets[1:]
    kinds = [POLY.ranges(prefix, start, end)]
    kinds += [tk.mix(POLY.ranges(prefix, start, np.minimum(end, start + size)) + np.uint64(size)) for size in BEGINNINGS]
    return (np.stack(kinds, -1) & np.uint64(BUCKETS - 1)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(rows: list[np.ndarray], toxic: np.ndarray, prior: float, rounds: int = 600, batch: int = 256, rate: float = 0.2, decay: float = 1e-5, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights of all buckets and the intercept; ``rows`` are the buckets of each text's words, with repeats."""
    texts = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pair, count = np.unique(texts * BUCKETS + np.concatenate(rows), return_counts=True)
    texts, (names, place) = pair // BUCKETS, np.unique(pair % BUCKETS, return_inverse=True)
    holds = np.bincount(place, minlength=len(names))
    chance = toxic.sum() * (holds + 1) / len(rows)  # confirmed texts that would hold the feature if it told nothing
    use = (np.abs(np.bincount(place, toxic[texts], len(names)) - chance) >= EVIDENCE * np.sqrt(chance))[place]
    value = count / np.sqrt(np.maximum(1, [len(r) for r in rows]))[texts]
    names, texts, (place, value) = names[np.unique(place[use])], texts[use], (np.unique(place[use], return_inverse=True)[1], value[use])
    first = np.searchsorted(texts, np.arange(len(rows) + 1))
    weight, bias = np.zeros(len(names)), np.log(prior / (1 - prior))
    slope_mean, slope_square, rnd = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.random.default_rng(seed)
    pools = [np.flatnonzero(toxic), np.flatnonzero(~toxic)]

    def margins(chosen: np.ndarray):
        length = first[chosen + 1] - first[chosen]
        at = np.repeat(first[chosen] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        owner = np.repeat(np.arange(len(chosen)), length)
        return bias + np.bincount(owner, weight[place[at]] * value[at], len(chosen)), at, owner

    for step in range(1, rounds + 1):
        (known, known_at, known_of), (free, free_at, free_of) = (margins(rnd.choice(p, min(batch * (k + 1), len(p)), replace=False)) for k, p in enumerate(pools))
        up = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        clean = np.logaddexp(0, free).mean() - prior * np.logaddexp(0, known).mean()
        # slopes of the loss in each margin: of confirmed texts as toxic, of both as clean
        as_toxic, as_clean, of_free = prior * (up(known) - 1) / len(known), -prior * up(known) / len(known), up(free) / len(free)
        if clean >= 0:
            on_known, on_free = as_toxic + as_clean, of_free
        else:
            on_known, on_free = -as_clean, -of_free
        slope = np.bincount(place[known_at], on_known[known_of] * value[known_at], len(names)) + np.bincount(place[free_at], on_free[free_of] * value[free_at], len(names))
        slope = np.append(slope + decay * weight, on_known.sum() + on_free.sum())
        slope_mean += 0.1 * (slope - slope_mean)
        slope_square += 0.01 * (slope**2 - slope_square)
        move = rate * (slope_mean / (1 - 0.9**step)) / (np.sqrt(slope_square / (1 - 0.99**step)) + 1e-6)
        weight -= move[:-1]
        bias -= move[-1]
    out = np.zeros(BUCKETS, np.float32)
    out[names] = weight
    return out, float(bias)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The averaged classifier, from a sample of bounded size in the training fold."""
    tk.tune(docs.sparkSession)
    of = F.col("doc_id").cast("long").alias("doc_id")
    docs = docs.select(of, F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id")))
    told = labels.select(of, F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = told.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = toxic / n if n else 0.0
    if not 0 < toxic < n:
        return Model(prior)
    draw = F.pmod(F.xxhash64(F.lit(12), F.col("doc_id")), F.lit(1 << 30))  # a document's place in the order in which samples are drawn
    share = lambda most, of: int(min(1.0, most / max(1, of)) * (1 << 30))
    known = told.where((F.col("toxic") == 1) & (draw < share(SAMPLE_TOXIC, toxic))).select("doc_id", F.lit(True).alias("toxic"))  # bounded: about SAMPLE_TOXIC rows of an id
    free = draw < share(SAMPLE_UNLABELLED, docs.select("doc_id").count())
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(known), "doc_id", "left").withColumn("free", free)
    sample = short.where("free OR toxic").groupBy("doc_id", "toxic", "free").agg(F.min("text").alias("text"))
    roles = F.array_compact(F.array(F.when(F.col("toxic"), F.lit(-1)), F.when(F.col("free"), F.pmod(F.xxhash64(F.lit(13), F.col("doc_id")), F.lit(MEMBERS)).cast("int"))))
    sample = sample.select("doc_id", "text", F.explode(roles).alias("role"))
    member = F.when(F.col("role") < 0, F.sequence(F.lit(0), F.lit(MEMBERS - 1))).otherwise(F.array("role"))
    sample = sample.select(F.explode(member).alias("member"), (F.col("role") < 0).alias("toxic"), "doc_id", "text")

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by([("toxic", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        words, code, row = terms(table.column("text").combine_chunks(), ALNUM)
        features, known, member = buckets(words)[code], np.asarray(table.column("toxic").combine_chunks().cast(pa.uint8())) > 0, table.column("member")[0].as_py()
        cut = np.searchsorted(row, np.arange(len(known) + 1))
        if known.all() or not known.any():
            return pa.table({"weight": pa.array([], pa.binary()), "bias": pa.array([], pa.float64())})
        weight, bias = fit([features[a:b].ravel() for a, b in zip(cut[:-1], cut[1:], strict=True)], known, prior, seed=member)
        return pa.table({"weight": pa.array([weight.tobytes()], pa.binary()), "bias": pa.array([bias])})

    found = sample.groupBy("member").applyInArrow(fitted, "weight binary, bias double").collect()  # MEMBERS rows
    if not found:
        return Model(prior)
    return Model(prior, np.mean([np.frombuffer(r["weight"], np.float32) for r in found], 0), float(np.mean([r["bias"] for r in found])))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, from its whole text."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if model.weight is None:
                value = np.full(n, model.prior)
            else:
                words, code, row = terms(batch.column("text"), ALNUM)
                each = model.weight[buckets(words)].astype(np.float64).sum(-1)
                size = np.sqrt(np.maximum(1, np.bincount(row, minlength=n) * (1 + len(BEGINNINGS))))
                value = 1 / (1 + np.exp(-np.clip(model.bias + np.bincount(row, each[code], n) / size, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    tk.tune(docs.sparkSession)
    of = F.col("doc_id").cast("long")
    return docs.select(of.alias("doc_id"), held_out(of).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(tk.tidy(run), "doc_id long, held_out boolean, score double, predicted int")
