"""Ranked lexical search: the best documents of every item, by whole-number scores of the terms that they share.

A term's weight is w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document's length
counts as m = 10 + 90 n N div L, and a shared term gives w * (10**9 tf div
(1000 tf + 8 m)).  N, L and df are taken over all documents.

Documents are read once for a block of items.  What they hold of the block's
terms is kept as shards: postings of up to ``SHARD_DOCS`` documents in the order
of their ids, written where the documents were read, so nothing is shuffled.
Over a shard's postings stands one tree a term: a leaf is a document's share, a
node the largest share of ``FAN`` times the range of documents below it.  The sum
of an item's terms at a range bounds every score in it.  Ranges are opened from
the highest bound down, until the next bound is below the tenth best score; a
range whose bound equals it is opened if it can hold a smaller id.  A task
carries an item's best from shard to shard, and Spark ranks the tasks' bests.

Defined cases: a null text, or one without terms, is no document of N, L or any
result; an item without terms has no rows; documents that are repeated are ranked
each, equal items (id and text) once; of equal scores the smaller id comes first,
null ids last; other columns are ignored; no documents or no items give no rows.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .terms import ALNUM, terms

#: Items, and bytes of their texts, that are searched at once: what is sent to every task stays below this, whatever the number of items.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: Documents, and postings, of a shard.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 19
#: Ranges below a node of a tree.
FAN = 16
#: Ranges of one level that are opened together.
OPENED = 8
SHARDS = "docs long, terms long, ids array<long>, n array<long>, term array<int>, count array<int>, place array<int>, tf array<int>"
LAST = np.iinfo(np.int64).max


def blocks(items: DataFrame):
    """Lists of (item_id, text) of about the bounded size; an item is in one of them."""
    items = tk.stored(items.distinct())
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for k in range(parts):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()


def shards(docs: DataFrame, words: pa.Array) -> DataFrame:
    """Documents, terms, and postings of ``words``, of the documents that a task reads one after the other."""
    names = [c.split()[0] for c in SHARDS.split(", ")]

    def packed(parts: list[tuple]) -> pa.RecordBatch:
        ids, known, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        place = np.concatenate([p[3] + s for p, s in zip(parts, shift, strict=False)])
        word, tf = (np.concatenate([p[k] for p in parts]) for k in (4, 5))
        order = np.lexsort((ids, ~known))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by = np.lexsort((rank[place], word))
        term, count = np.unique(word, return_counts=True)
        lists = [pa.array(ids[order], mask=~known[order]), pa.array(n[order]), *(pa.array(x.astype(np.int32)) for x in (term, count, rank[place][by], tf[by]))]
        wrap = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        return pa.RecordBatch.from_arrays([pa.array([sum(p[6] for p in parts)]), pa.array([sum(p[7] for p in parts)]), *wrap], names)

    def run(batches):
        parts, size, held = [], 0, 0
        for batch in batches:
            found, code, row = terms(batch.column("text"), ALNUM)
            n = np.bincount(row, minlength=batch.num_rows)
            known = pc.index_in(found, value_set=words).fill_null(-1)
            word = np.asarray(known)[code] if len(code) else np.zeros(0, np.int64)
            hit = word >= 0
            pair, tf = np.unique(row[hit] * max(1, len(words)) + word[hit], return_counts=True)
            place, word = pair // max(1, len(words)), pair % max(1, len(words))
            with_hit, place = np.unique(place, return_inverse=True)
            ids = batch.column("doc_id")
            parts.append((np.asarray(ids.fill_null(LAST))[with_hit], np.asarray(ids.is_valid())[with_hit], n[with_hit], place, word, tf, int((n > 0).sum()), int(n.sum())))
            size, held = size + len(tf), held + len(with_hit)
            if size >= SHARD_POSTINGS or held >= SHARD_DOCS:
                yield packed(parts)
                parts, size, held = [], 0, 0
        if parts:
            yield packed(parts)

    return docs.mapInArrow(tk.tidy(run), SHARDS)


class Trees:
    """One tree a term over a shard's documents, all of them in the same arrays: ``node``, ``most`` and ``below`` a level."""

    def __init__(self, term: np.ndarray, count: np.ndarray, place: np.ndarray, value: np.ndarray):
        self.term = term
        owner = np.repeat(np.arange(len(term)), count)
        self.node, self.most, self.below = [place], [value], [np.zeros(0, np.int64)]
        while len(owner) > len(term) or (self.node[-1] > 0).any():
            up = self.node[-1] // FAN
            start = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (up[1:] != up[:-1])]))
            self.below.append(np.append(start, len(owner)))
            self.most.append(np.maximum.reduceat(self.most[-1], start))
            self.node.append(up[start])
            owner = owner[start]

    def roots(self, wanted: np.ndarray) -> np.ndarray:
        """Entries of the highest level of the terms ``wanted`` that the shard has."""
        at = np.searchsorted(self.term, wanted)
        return at[(at < len(self.term)) & (self.term[np.minimum(at, len(self.term) - 1)] == wanted)]

    def opened(self, level: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ranges below the ranges of ``entries``: (range, sum of the terms' largest shares, first of its entries, all entries by range)."""
        first, last = self.below[level][entries], self.below[level][entries + 1]
        size = last - first
        every = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        every = every[np.argsort(self.node[level - 1][every], kind="stable")]
        node = self.node[level - 1][every]
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        return node[start], np.add.reduceat(self.most[level - 1][every], start), start, every


def best_first(trees: Trees, wanted: np.ndarray, ids: np.ndarray, best: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """``best`` (score negated, id; in order), with the shard's documents that belong among the ``most`` best ones."""
    roots = trees.roots(wanted)
    if not len(roots):
        return best
    top = len(trees.node) - 1
    heap = [(-int(trees.most[top][roots].sum()), 0, top, roots)]
    if top == 0:  # a shard of one document
        return sorted([*best, (heap[0][0], int(ids[0]))])[:most] if heap[0][0] < 0 else best
    while heap:
        limit = best[-1] if len(best) == most else (0, LAST)

        def hopeless(bound: int, first: int, limit=limit) -> bool:
            """No document of the range comes before the last of the best: neither by score nor, at that score, by id."""
            return -bound > limit[0] or -bound == limit[0] and (limit[0] == 0 or ids[first] >= limit[1])

        if hopeless(-heap[0][0], heap[0][1]):
            break
        level, group = heap[0][2], []
        while heap and len(group) < OPENED and heap[0][2] == level and not hopeless(-heap[0][0], heap[0][1]):
            group.append(heapq.heappop(heap)[3])
        node, bound, start, every = trees.opened(level, group[0] if len(group) == 1 else np.concatenate(group))
        if level == 1:
            keep = bound > max(0, -limit[0] - 1)
            best = sorted([*best, *zip((-bound[keep]).tolist(), ids[node[keep]].tolist(), strict=True)])[:most]
            continue
        end = np.append(start[1:], len(every))
        for k in np.flatnonzero(bound >= -limit[0]):
            first = int(node[k]) * FAN ** (level - 1)
            if not hopeless(int(bound[k]), first):
                heapq.heappush(heap, (-int(bound[k]), first, level - 1, every[start[k] : end[k]]))
    return best


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of every document: whole numbers of 64 bits while the product fits, of any size else."""
    if len(n) and 90 * int(n.max()) * docs > LAST:
        return np.array([10 + 90 * int(x) * docs // total for x in n], np.int64)
    return 10 + 90 * n * docs // total


def searched(index: DataFrame, wanted: list[np.ndarray], weight: np.ndarray, docs: int, total: int, most: int) -> DataFrame:
    """(item, doc_id, score): the best of every item among the shards of a task."""

    def run(batches):
        best: list[list[tuple[int, int]]] = [[] for _ in wanted]
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n, term, count, place, tf = (np.asarray(batch.column(c)[k].values.cast(pa.int64()).fill_null(LAST)) for c in ("ids", "n", "term", "count", "place", "tf"))
                if not len(term):
                    continue
                m = lengths(n, docs, total)
                trees = Trees(term, count, place, np.repeat(weight[term], count) * (10**9 * tf // (1000 * tf + 8 * m[place])))
                for item, want in enumerate(wanted):
                    best[item] = best_first(trees, want, ids, best[item], most)
        rows = [(item, doc, -score) for item, found in enumerate(best) for score, doc in found]
        if rows:
            item, doc, score = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == LAST), pa.array(score)], ["item", "doc_id", "score"])

    return index.select("ids", "n", "term", "count", "place", "tf").mapInArrow(tk.tidy(run), "item long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """item_id, rank (from 1, highest first), doc_id, score of each item's ``most`` best documents.

    Each block's shards stay in the checkpoint folder, as the result reads them.
    """
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    tk.tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for block in blocks(items.select("item_id", F.col("text").cast("string").alias("text"))):
        words, code, row = terms(pa.array([r["text"] for r in block], pa.string()), ALNUM)
        words = words.cast(pa.string())
        each = np.unique(row * max(1, len(words)) + code)
        wanted = np.split(each % max(1, len(words)), np.searchsorted(each // max(1, len(words)), np.arange(1, len(block))))
        index = tk.stored(shards(docs, words.cast(pa.large_string())))
        n, total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        held = index.select(F.explode(F.arrays_zip("term", "count")).alias("x")).groupBy("x.term").agg(F.sum("x.count").alias("df"))
        weight = np.zeros(len(words), np.int64)
        for term, w in held.select("term", F.floor(1000 * F.ln((2.0 * n + 2) / (2.0 * F.col("df") + 1)))).collect():  # a row a term of the block
            weight[term] = w
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(block)], f"item long, item_id {kind}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = searched(index, wanted, weight, n, total, most).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        found.append(top.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
