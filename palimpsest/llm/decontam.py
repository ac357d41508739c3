"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

An item of L words is held against every window of L words of a document.  Both
get a 128-bit SimHash of their 5-word shingles, weighted by how often they occur.  The
bits form BLOCKS blocks of 16; fingerprints within RADIUS bits differ by at most
REACH = RADIUS // BLOCKS bits in one block at least.  A table for each item size holds
every item under its blocks' values and their neighbours within SPREAD bits; a window
asks for its own blocks' values and the neighbours within REACH - SPREAD bits, and so
finds every fingerprint within the radius.  Of unrelated fingerprints 8 % share a block
so closely, and their whole distance is compared then, which next to none passes.
Candidates are confirmed by the exact weighted Jaccard similarity of their shingles,
sum of least weights over sum of greatest, at 0.75 or more.  A window that shares
no shingle with any item of its size has similarity 0 and is not looked up.

The benchmark is the query set: it is broadcast in blocks of bounded size, one
after the other, against all documents.

Defined cases: null or empty texts and texts without words leak nothing; items
without words are skipped; an item of fewer than 5 words counts where its exact
word sequence stands; a document shorter than an item is one window; repeated
rows are judged each by itself; a null doc_id or item_id stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

POLY = tk.Poly(5)
WORDS, RADIUS, BLOCKS, SPREAD = 5, 31, 8, 1
REACH = RADIUS // BLOCKS
#: Bounds of one broadcast block of the benchmark.
ITEMS, ITEM_BYTES = 20_000, 32 << 20
#: Windows that are fingerprinted at once, cells of windows by items that are marked at once, and shingles that are compared at once.
WINDOWS, CELLS, COMPARED = 4096, 1 << 22, 1 << 20
#: Differences of two blocks, by how many bits they have.
FLIPS = [np.flatnonzero(np.bitwise_count(np.arange(1 << 16)) <= k) for k in range(REACH + 1)]
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, distance long, common long, united long"


def shingled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word fingerprints, first word of each row; shingles: fingerprint, row, first word."""
    low = tk.LOWER[data]
    start, end, first = tk.words(low, offsets)
    word = POLY.ranges(POLY.prefix(low), start, end)
    return word, first, *tk.windows(word, first, WORDS)


def marks(value: np.ndarray) -> np.ndarray:
    """A row of 128 signs for each shingle."""
    both = np.stack([tk.mix(value), tk.mix(value ^ tk.U(0x9E3779B97F4A7C15))], -1)
    return np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1).astype(np.int8) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Two numbers of 64 bits from rows of 128 sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint64).reshape(-1, 2)


def codes(sign: np.ndarray, bits: int) -> np.ndarray:
    """Block numbers with the blocks' values and their neighbours within ``bits``, a row for each fingerprint."""
    value = sign.view(np.uint16).reshape(-1, BLOCKS, 1).astype(np.int32) ^ FLIPS[bits].astype(np.int32)
    return (value + (np.arange(BLOCKS, dtype=np.int32) << 16)[:, None]).reshape(len(sign), -1)


class Sized:
    """Items of one size: SimHash, shingle weights, and the table of the multi-index."""

    def __init__(self, size: int, items: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]]):
        self.size, self.items = size, items
        keys, of = np.concatenate([k for k, _ in bags]), np.repeat(np.arange(len(bags)), [len(k) for k, _ in bags])
        self.shingle, rank = np.unique(keys, return_inverse=True)
        self.code, self.weight = of * len(self.shingle) + rank, np.concatenate([w for _, w in bags])  # sorted, as a bag's keys are
        self.total = np.bincount(of, self.weight, len(bags)).astype(np.int64)
        self.sign = np.concatenate([fingerprint((marks(k).astype(np.int64) * w[:, None]).sum(0)[None]) for k, w in bags])
        entry = codes(self.sign, SPREAD)
        order = np.argsort(entry, axis=None, kind="stable")
        #: The table: block values in order, the item of each, and a bit for each value that is there.
        self.value, self.item = entry.ravel()[order], (order // entry.shape[1]).astype(np.int32)
        there = np.zeros(BLOCKS << 16, bool)
        there[self.value] = True
        self.there = np.packbits(there, bitorder="little")

    def near(self, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, item of this size, distance) of fingerprints within the radius of an item's, by looking up each block."""
        out = []
        step = max(1, min(256, CELLS // len(self.items)))
        for low in range(0, len(sign), step):
            part = sign[low : low + step]
            asked = codes(part, REACH - SPREAD)
            at, k = np.nonzero((self.there[asked >> 3] >> (asked & 7)) & 1)
            asked = asked[at, k]
            first, last = np.searchsorted(self.value, asked), np.searchsorted(self.value, asked, "right")
            count = last - first
            entry = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else np.zeros(0, np.int64)
            met = np.zeros((len(part), len(self.items)), bool)
            met[np.repeat(at, count), self.item[entry]] = True
            at, item = np.nonzero(met)
            distance = np.bitwise_count(part[at] ^ self.sign[item]).sum(1)
            close = distance <= RADIUS
            out.append((at[close] + low, item[close], distance[close].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def common(self, values: np.ndarray, first: np.ndarray, width: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Sum of least weights of windows (first value, width) and items, pair by pair."""
        rank = np.minimum(np.searchsorted(self.shingle, values), len(self.shingle) - 1)
        rank = np.where(self.shingle[rank] == values, rank, -1)
        out, done = np.zeros(len(first), np.int64), np.concatenate([[0], np.cumsum(width)])
        low = 0
        while low < len(first):
            high = max(low + 1, int(np.searchsorted(done, done[low] + COMPARED, "right")) - 1)
            pair = np.repeat(np.arange(low, high), width[low:high])
            inside = rank[first[pair] + np.arange(len(pair)) - (done[pair] - done[low])]
            pair, inside = pair[inside >= 0], inside[inside >= 0]
            code = item[pair] * len(self.shingle) + inside
            spot = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            held = self.code[spot] == code
            key, times = np.unique(pair[held] * len(self.code) + spot[held], return_counts=True)
            out += np.bincount(key // len(self.code), np.minimum(times, self.weight[key % len(self.code)]), len(first)).astype(np.int64)
            low = high
        return out


class Index:
    """Items of one block of the benchmark, by size."""

    def __init__(self, items: list[tuple[int, str]]):
        data, offsets = tk.flat(pa.array([t for _, t in items], pa.string()))
        word, first, value, row, _ = shingled(data, offsets)
        self.ids, self.words = [i for i, _ in items], np.diff(first)
        cut = np.searchsorted(row, np.arange(len(items) + 1))
        bag = lambda i: np.unique(value[cut[i] : cut[i + 1]], return_counts=True)
        self.sizes = [Sized(int(n) - WORDS + 1, own, [bag(i) for i in own]) for n in np.unique(self.words[self.words >= WORDS]) for own in [np.flatnonzero(self.words == n)]]
        self.filter = np.zeros(1 << 20, bool)
        for sized in self.sizes:
            self.filter[(sized.shingle >> tk.U(44)).astype(np.int64)] = True
        self.short = {int(n): {int(value[cut[i]]): [] for i in np.flatnonzero(self.words == n)} for n in range(1, WORDS) if (self.words == n).any()}
        for n, table in self.short.items():
            for i in np.flatnonzero(self.words == n):
                table[int(value[cut[i]])].append(int(i))

    def leaks(self, data: np.ndarray, offsets: np.ndarray, percent: int) -> list[tuple[int, int, int, int, int, int, int]]:
        """(row, item, start word, words, distance, common, united) of the best window of each leak."""
        word, first, value, row, at = shingled(data, offsets)
        out = []
        for n, table in self.short.items():
            short, of, begin = tk.windows(word, first, n)
            keys = np.array(list(table), np.uint64)
            seen = set()
            for k in np.flatnonzero(np.isin(short, keys) & (np.diff(first)[of] >= n)):
                for item in table[int(short[k])]:
                    if (of[k], item) not in seen:
                        seen.add((of[k], item))
                        out.append((int(of[k]), item, int(begin[k] - first[of[k]]), n, 0, 1, 1))
        maybe = np.flatnonzero(self.filter[(value >> tk.U(44)).astype(np.int64)])
        if not len(maybe):
            return out
        cut = np.searchsorted(row, np.arange(len(offsets)))
        best: dict[tuple[int, int], tuple] = {}
        for sized in self.sizes:
            spot = np.minimum(np.searchsorted(sized.shingle, value[maybe]), len(sized.shingle) - 1)
            hit = maybe[sized.shingle[spot] == value[maybe]]
            if len(hit):
                self._windows(sized, value, row, cut, hit, percent, best)
        for (doc, item), (common, united, start, distance) in best.items():
            here = int(first[doc + 1] - first[doc])
            out.append((doc, item, int(at[start] - first[doc]), min(int(self.words[item]), here), distance, common, united))
        return out

    def _windows(self, sized: Sized, value, row, cut, hit, percent, best) -> None:
        """Fingerprints the windows of one size that hold a hit, looks them up and verifies what is near."""
        room = np.minimum(sized.size, np.diff(cut))  # shingles of a document's windows
        doc = row[hit]
        edge = np.zeros(len(value) + 1, np.int32)
        np.add.at(edge, np.maximum(hit - room[doc] + 1, cut[doc]), 1)
        np.add.at(edge, np.minimum(hit, cut[doc + 1] - room[doc]) + 1, -1)
        start = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        width = room[row[start]]
        edge[:] = 0
        np.add.at(edge, start, 1)
        np.add.at(edge, start + width, -1)
        held = np.cumsum(edge)[:-1] > 0
        inside, values = np.cumsum(held) - 1, value[held]  # the windows' shingles without the gaps between
        for low in range(0, len(start), WINDOWS):
            s, w = start[low : low + WINDOWS], width[low : low + WINDOWS]
            c = inside[s]
            a, b = int(c[0]), int((c + w).max())
            sums = np.zeros((b - a + 1, 128), np.int32)
            np.cumsum(marks(values[a:b]), axis=0, out=sums[1:])
            index, item, distance = sized.near(fingerprint(sums[c - a + w] - sums[c - a]))
            common = sized.common(values[a:b], c[index] - a, w[index], item)
            united = w[index] + sized.total[item] - common
            for k in np.flatnonzero(100 * common >= percent * united).tolist():
                begin = int(s[index[k]])
                key, now = (int(row[begin]), int(sized.items[item[k]])), (int(common[k]), int(united[k]), begin, int(distance[k]))
                if key not in best or now[0] * best[key][1] > best[key][0] * now[1]:
                    best[key] = now


def blocks(benchmark: DataFrame):
    """Indexes of the benchmark's items, a bounded block at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(r"text RLIKE '[^\\x20\\x09-\\x0D]'")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-count // ITEMS), -(-size // ITEM_BYTES))
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        yield Index([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """One row for each document and item found in it: the best window, its fingerprint distance and weights."""
    spark, out = docs.sparkSession, None
    tk.tune(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for index in blocks(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                data, offsets = tk.flat(batch.column("text"))
                ids, found = batch.column("doc_id"), []
                for row, part, off in tk.chunks(data, offsets):
                    found += [(ids[row + d].as_py(), sent.value.ids[i], *rest) for d, i, *rest in sent.value.leaks(part, off, percent)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(7)], [c.split()[0] for c in SCHEMA.split(", ")])

        part = source.mapInArrow(tk.tidy(run), SCHEMA)
        out = part if out is None else out.union(part)
    return out


def keep(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` without documents that hold an item, all columns as they were."""
    spark, names, schema = docs.sparkSession, docs.columns, docs.schema
    tk.tune(spark)
    for index in blocks(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                data, offsets = tk.flat(batch.column(names.index("text")).cast(pa.string()))
                clean = np.ones(len(offsets) - 1, bool)
                for row, part, off in tk.chunks(data, offsets):
                    for found in sent.value.leaks(part, off, percent):
                        clean[row + found[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(tk.tidy(run), schema)
    return docs
