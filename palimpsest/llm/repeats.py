"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
(smaller doc_id, or the same document and an earlier start).  Only the order of suffixes up
to LENGTH bytes matters, so the sort stops there:

1. Sampled tuples.  Positions whose residue modulo V lies in the difference
   cover D are sampled, with tuples of V bytes.  For any two positions i, j some shift
   below V takes both into the sample, so equal strings at i and j hold equal sampled
   tuples.  Tuples whose fingerprint occurs once are unique and leave the sort
   (equal fingerprints alone decide nothing).  The others are dealt by
   range and sorted by their bytes; the rank is a tuple's name.
2. Recursion on names.  A sample is sorted again by the names at V before, at and V
   after it, which order all strings over it.  V * 3 bytes hold every such string, so the
   recursion ends here.  Of samples with equal names all but the first repeat the first.
3. Merge of the remaining suffixes.  Where a tuple stands in several such classes, the
   suffixes over the classes' first members that are still open, sampled or not,
   lose those whose prefix of LENGTH bytes has a fingerprint that occurs once; the
   rest are dealt by range and sorted by their first LENGTH bytes.
4. Adjacent prefixes of LENGTH bytes that are equal: all but the first are repeats.

What a task holds twice is combined before each shuffle, so a tuple or string that many
documents share sends one member a task.  Tuples, ranks, positions and texts
travel as compressed arrays, a few rows for a task and range.  Ranges, buckets and
parts are counted from the input's bytes, PART_BYTES of text in each; the ranges'
borders come from a sample of tuples, and only the balance depends on it.

Defined cases: a null or empty text, and one shorter than LENGTH, loses nothing;
rows with one doc_id and equal texts are one document; rows with one doc_id and
different texts are ordered by their digest; a null doc_id comes before all others;
an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import time
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

LENGTH, V = 100, 50
#: A difference cover modulo V: every residue is a difference of two members.
D = np.array([0, 6, 9, 14, 16, 26, 27, 31])
POLY = tk.Poly(2)
#: Text bytes of a chunk of documents, and of a part, a bucket or a range.
CHUNK, PART_BYTES = 1 << 20, 12 << 20
#: Most ranges, and rows of sampled tuples (SPLITS in each) that the driver reads for each range.
MOST_RANGES, SPLIT_ROWS, SPLITS = 1 << 18, 4, 16
#: Tuples, or open strings, that are sorted at once before a shuffle.
BLOCK = 200_000
SAMPLES, FOUND, ASKED, RANKS, HELD, MEMBERS, REPEATS, EDGES, STRINGS, SPLIT, TEXT = range(11)
ROW = "part int, kind int, id long, blob binary, known binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]
RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
#: Marks the context of a sample that no other sample can have.
ALONE = 0xFFFF


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; numbers as planes of bytes."""
    head, body = [np.array([len(arrays)], np.int64).tobytes()], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(a.dtype.str.encode().ljust(8) + np.array([len(a)], np.int64).tobytes())
        raw = a.view(np.uint8).reshape(len(a), -1) if len(a) else a
        body.append((raw if a.dtype.kind == "S" else raw.T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 + 16 * int(np.frombuffer(raw, np.int64, 1)[0]), []
    for place in range(8, at, 16):
        kind, n = np.dtype(raw[place : place + 8].decode().strip()), int(np.frombuffer(raw, np.int64, 1, place + 8)[0])
        if kind.kind == "S" or not n:
            out.append(np.frombuffer(raw, kind, n, at))
        else:
            planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
            out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences, which compress well where ``x`` is sorted; ``np.cumsum`` takes them back."""
    return np.diff(x.astype(np.int64), prepend=0)


def joined(packs: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*packs, strict=True)]


def place(k: np.ndarray) -> np.ndarray:
    """Position of a document's k-th sample."""
    return k // len(D) * V + D[k % len(D)]


def samples(size: np.ndarray) -> np.ndarray:
    """How many samples documents of ``size`` bytes have: all whose tuple ends within the text."""
    room = np.where(size >= LENGTH, size - V + 1, 0)
    return room // V * len(D) + np.searchsorted(D, room % V, "left")


def position(k: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Position of a sample; the number after a document's last one stands for the tuple that ends the text."""
    return np.where(k == samples(size), size - V, place(k))


def strings_over(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings over a sample: those for which it is the shift of its residue."""
    return np.maximum(at - V + 1, 0), np.minimum(at, size - LENGTH)


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (tk.mix(ids.astype(np.uint64)) % tk.U(parts)).astype(np.int64)


def by_part(part: np.ndarray):
    """(part, indices in order) of every part."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
    for a, b in zip(cut, [*cut[1:], len(part)], strict=True):
        yield int(part[order[a]]), order[a:b]


def strings(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from each position, as an array that sorts by them."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, size)[at]).view(f"S{size}").ravel() if len(at) else np.zeros(0, f"S{size}")


class Rows:
    """Collects rows of ROW for an Arrow batch."""

    def __init__(self, parts: int):
        self.parts, self.rows, self.bytes = parts, [], 0
        self.held: dict[int, list] = {}

    def add(self, part: int, kind: int, id: int | None, blob: bytes, known: bytes | None = None) -> None:
        self.rows.append((part, kind, id, blob, known))
        self.bytes += len(blob)

    def positions(self, kind: int, ids: np.ndarray, number: np.ndarray, most: int = 1 << 20) -> None:
        """Keeps positions until there are many, so that few rows carry them; ``last`` ends it."""
        held = self.held.setdefault(kind, [])
        held.append((ids, number))
        if sum(len(i) for i, _ in held) >= most:
            self._flush()

    def names(self, ids: np.ndarray, number: np.ndarray, name: np.ndarray, buckets: int) -> None:
        """Fingerprints by bucket, each once; positions whose fingerprint stands here twice are FOUND already."""
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        again, often = np.zeros(len(name), bool), np.zeros(len(name), bool)
        again[order[1:]] = often[order[1:]] = same
        often[order[:-1]] |= same
        if often.any():
            self.positions(FOUND, ids[often], number[often])
        ids, number, name = ids[~again], number[~again], name[~again]
        for bucket, some in by_part(((name >> tk.U(40)) % tk.U(buckets)).astype(np.int64)):
            self.add(bucket, SAMPLES, None, pack(steps(ids[some]), steps(number[some]), name[some].astype(np.uint32)))

    def _flush(self) -> None:
        for kind, held in self.held.items():
            ids, number = joined(held)
            for part, at in by_part(part_of(ids, self.parts)):
                order = at[np.lexsort((number[at], ids[at]))]
                self.add(part, kind, None, pack(steps(ids[order]), steps(number[order])))
        self.held = {}

    def batch(self) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        cols = [pa.array([r[k] for r in self.rows], t) for k, t in enumerate(types)]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(cols, NAMES)

    def full(self):
        """The rows so far, once they are many."""
        if self.bytes >= CHUNK or len(self.rows) >= 1000:
            yield self.batch()

    def last(self):
        self._flush()
        yield self.batch()


def sampled(source: DataFrame, parts: int, buckets: int) -> DataFrame:
    """Step 1: fingerprints of sampled tuples by bucket, those the task saw before, and a few tuples for the ranges' borders."""

    def sample_tuples(batches):
        out = Rows(parts)
        for batch in batches:
            batch = batch.sort_by("id")
            ids = batch.column("id").to_numpy()
            data, offsets = tk.flat(batch.column("text"))
            for row, part, off in tk.chunks(data, offsets, CHUNK):
                size = np.diff(off)
                count = samples(size)
                count += count > 0  # the tuple that ends the text
                doc = np.repeat(np.arange(len(size)), count)
                if not len(doc):
                    continue
                k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                at = off[:-1][doc] + position(k, size[doc])
                name = POLY.ranges(POLY.prefix(part), at, at + V)
                out.add(int(part_of(ids[row : row + 1], parts)[0]), SPLIT, None, pack(strings(part, at[:: max(1, len(at) // SPLITS)], V)))
                out.names(ids[row + doc], k, name, buckets)
                yield from out.full()
        yield from out.last()

    return source.mapInArrow(tk.tidy(sample_tuples), ROW)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a part in one task, by kind and id."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "kind", "id")


def in_order(batches):
    """Rows as dicts, one batch of bounded bytes at a time."""
    for batch in batches:
        yield from batch.to_pylist()


def passed(kind: int, batches, out: Rows):
    """(part, rows of ``kind``) of every part; other rows go to ``out`` as they are."""
    for part, rows in groupby(in_order(batches), lambda r: r["part"]):
        mine = []
        for row in rows:
            if row["kind"] == kind:
                mine.append(row)
            else:
                out.add(*row.values())
        if mine:
            yield part, mine


def repeated(rows: DataFrame, parts: int) -> DataFrame:
    """Step 1: the samples whose fingerprint occurs twice or more."""

    def find_repeated(batches):
        out = Rows(parts)
        for _, got in passed(SAMPLES, batches, out):
            ids, k, name = joined([[np.cumsum(a), np.cumsum(b), c] for a, b, c in (unpack(r["blob"]) for r in got)])
            some = tk.twice(name)
            out.positions(FOUND, ids[some], k[some])
            yield from out.full()
        yield from out.last()

    return dealt(rows).mapInArrow(tk.tidy(find_repeated), ROW)


def borders(found: DataFrame, ranges: int, n_bytes: int) -> np.ndarray:
    """Tuples that cut the order of all tuples into about equal ranges; the driver reads at most about 16 * SPLIT_ROWS tuples for each."""
    rows = found.where(F.col("kind") == SPLIT).select("blob")
    # each chunk sent one row; a chunk ends where a batch or task ends as well
    every = max(1, n_bytes // CHUNK // max(256, SPLIT_ROWS * ranges))
    got = [unpack(r["blob"])[0] for r in rows.where(F.pmod(F.xxhash64("blob"), F.lit(every)) == 0).toLocalIterator()]
    if ranges == 1 or not got:
        return np.zeros(0, f"S{V}")
    tuples = np.sort(np.concatenate(got))
    return np.unique(tuples[np.arange(1, ranges) * len(tuples) // ranges])


def ranged(values: np.ndarray, cuts: np.ndarray):
    """(range, first, end) of the sorted ``values``, by their first V bytes."""
    edge = np.searchsorted(values.astype(cuts.dtype), cuts, "left")
    first, end = np.append(0, edge), np.append(edge, len(values))
    for r in np.flatnonzero(end > first).tolist():
        yield r, int(first[r]), int(end[r])


def texts(source: DataFrame, parts: int) -> DataFrame:
    """Compressed texts as rows of ROW."""

    def pack_texts(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            part, blob = part_of(ids, parts), [press.compress(t or b"") for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            n = len(ids)
            cols = [pa.array(part, pa.int32()), pa.array([TEXT] * n, pa.int32()), batch.column("id"), pa.array(blob, pa.binary()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, NAMES)

    return source.mapInArrow(tk.tidy(pack_texts), ROW)


def table(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (id, number), each once."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, number = joined([[np.cumsum(x) for x in unpack(r["blob"])] for r in rows])
    order = np.lexsort((number, ids))
    ids, number = ids[order], number[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (number[1:] != number[:-1])])
    return ids[new], number[new]


def chunks(batches, kinds: tuple[int, ...], limit: int = CHUNK):
    """(part, chunk number, tables of positions by kind, ids, bytes, offsets, rows) of documents in order of id; positions come before texts."""
    lift = zstandard.ZstdDecompressor()
    for part, rows in groupby(in_order(batches), lambda r: r["part"]):
        blobs, known, group, size, number = {kind: [] for kind in kinds}, None, [], 0, 0

        def close(part=part):
            data, off = tk.flat(pa.array([t for _, t in group], pa.large_binary()))
            return part, part << 24 | number, known, np.array([r["id"] for r, _ in group], np.int64), data, off, [r for r, _ in group]

        for row in rows:
            if row["kind"] in blobs:
                blobs[row["kind"]].append(row)
            elif row["kind"] == TEXT:
                if known is None:
                    known = {kind: table(got) for kind, got in blobs.items()}
                    blobs = {}
                text = lift.decompress(row["blob"])
                group.append((row, text))
                size += len(text)
                if size >= limit:
                    yield close()
                    group, size, number = [], 0, number + 1
        if group:
            yield close()


def spread(ids: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, number) of the sorted (id, number) ``known`` for the documents ``ids``."""
    low, high = np.searchsorted(known[0], ids, "left"), np.searchsorted(known[0], ids, "right")
    count = high - low
    doc = np.repeat(np.arange(len(ids)), count)
    return doc, known[1][np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]


def asked(rows: DataFrame, parts: int, cuts: np.ndarray) -> DataFrame:
    """Step 1: each chunk's distinct tuples by range, and which of its samples hold which."""

    def ask_ranks(batches):
        out = Rows(parts)
        for part, chunk, known, ids, data, off, _ in chunks(batches, (FOUND,)):
            doc, k = spread(ids, known[FOUND])
            size = np.diff(off)[doc]
            at, regular = position(k, size), k < samples(size)
            which, base = np.zeros(len(k), np.int32), 0
            for block, low in enumerate(range(0, len(k), BLOCK)):
                now = slice(low, low + BLOCK)
                tuples, back = np.unique(strings(data, off[:-1][doc[now]] + at[now], V), return_inverse=True)
                which[now] = base + back
                base += len(tuples)
                times = np.bincount(back[regular[now]], minlength=len(tuples))
                for r, first, end in ranged(tuples, cuts):
                    out.add(r, ASKED, chunk, pack(tuples[first:end], times[first:end], np.array([block])), part.to_bytes(4, "little"))
            if len(k):
                out.add(part, HELD, chunk, pack(steps(ids[doc]), k, which, size))
            yield from out.full()
        yield from out.last()

    return dealt(rows).mapInArrow(tk.tidy(ask_ranks), ROW)


def ranked(rows: DataFrame, parts: int) -> DataFrame:
    """Step 1: tuples of a range sorted by their bytes; answers hold their ranks and how often they occur."""

    def rank_tuples(batches):
        out = Rows(parts)
        for r, got in passed(ASKED, batches, out):
            tuples, times, block = zip(*(unpack(x["blob"]) for x in got), strict=True)
            cut = np.cumsum([0, *map(len, tuples)])
            order, back = np.unique(np.concatenate(tuples), return_inverse=True)
            total = np.zeros(len(order), np.int64)
            np.add.at(total, back, np.concatenate(times))
            for x, b, low, high in zip(got, block, cut[:-1], cut[1:], strict=True):
                mine = back[low:high]
                out.add(int.from_bytes(x["known"], "little"), RANKS, x["id"], pack(steps(mine), total[mine]), np.array([b[0], r], np.int64).tobytes())
            yield from out.full()
        yield from out.last()

    return dealt(rows).mapInArrow(tk.tidy(rank_tuples), ROW)


def compared(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order by ``columns``, the first of which counts most, ties as they come, and which rows of it equal the one before."""
    order = np.lexsort(columns[::-1])
    same = np.zeros(len(order), bool)
    same[1:] = True
    for c in columns:
        same[1:] &= c[order][1:] == c[order][:-1]
    return order, same


def grouped(rows: DataFrame, parts: int, buckets: int) -> DataFrame:
    """Step 2: names at V before, at and V after each sample, combined within a chunk."""

    def name_samples(batches):
        out = Rows(parts)
        for _, rows in groupby(in_order(batches), lambda r: r["id"]):
            held, answers = None, []
            for row in rows:
                if row["kind"] == HELD:
                    held = unpack(row["blob"])
                else:
                    b, r = np.frombuffer(row["known"], np.int64).tolist()
                    rank, total = unpack(row["blob"])
                    answers.append((b, r, np.cumsum(rank) | (r << 40), total))
            answers.sort(key=lambda x: x[:2])  # as the chunk dealt them
            rank, total = joined([x[2:] for x in answers])
            ids, k, which, size = held
            ids, n, at = np.cumsum(ids), samples(size), position(k, size)
            rank, total = rank[which], total[which]
            doc = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]))
            code = doc << 32 | k

            def name(of: np.ndarray) -> np.ndarray:
                """Names of the samples ``of`` of the same documents; -1 where the tuple is unique."""
                spot = np.minimum(np.searchsorted(code, doc << 32 | of), len(code) - 1)
                return np.where(code[spot] == (doc << 32 | of), rank[spot], -1)

            first, near_end = at < V, at + 2 * V > size
            before = name(np.where(first, 0, k - len(D)))
            after = name(np.where(near_end, n, k + len(D)))
            mark = np.minimum(at, V) << 8 | np.where(near_end, size - at, 2 * V)
            alone = (before < 0) | (after < 0)
            mine = np.flatnonzero((k < n) & (total > 1))
            single = mine[alone[mine]]
            out.positions(EDGES, ids[single], k[single])
            mine = mine[~alone[mine]]
            order, same = compared([c[mine] for c in (rank, before, after, mark)])
            order = mine[order]
            out.positions(REPEATS, ids[order[same]], k[order[same]])
            lead = np.flatnonzero(~same)
            times = np.diff(np.append(lead, len(order)))
            lead = order[lead]
            far = np.flatnonzero(times < total[lead])  # else all of the tuple's samples are in this class
            lead, times = lead[far], times[far]
            key = tk.mix(tk.mix(tk.mix(rank[lead].view(np.uint64)) + before[lead].view(np.uint64)) + after[lead].view(np.uint64))
            for bucket, some in by_part((key % tk.U(buckets)).astype(np.int64)):
                x = lead[some]
                out.add(bucket, MEMBERS, None, pack(steps(rank[x]), before[x], after[x], mark[x].astype(np.uint16), times[some], total[x], ids[x], k[x]))
            yield from out.full()
        yield from out.last()

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, "part").sortWithinPartitions("id", "kind").mapInArrow(tk.tidy(name_samples), ROW)


def classed(rows: DataFrame, parts: int) -> DataFrame:
    """Step 2: members of a class that repeat its first, and first members whose tuple stands in several classes."""

    def sort_names(batches):
        out = Rows(parts)
        for _, got in passed(MEMBERS, batches, out):
            rank, before, after, mark, times, total, ids, k = joined([[np.cumsum(x[0]), *x[1:]] for x in (unpack(r["blob"]) for r in got)])
            order = np.lexsort((k, ids))
            rank, before, after, mark, times, total, ids, k = (x[order] for x in (rank, before, after, mark, times, total, ids, k))
            order, same = compared([rank, before, after, mark])
            out.positions(REPEATS, ids[order[same]], k[order[same]])
            lead = np.flatnonzero(~same)
            edge = np.add.reduceat(times[order], lead) < total[order[lead]]
            out.positions(EDGES, ids[order[lead[edge]]], k[order[lead[edge]]])
            yield from out.full()
        yield from out.last()

    return dealt(rows).mapInArrow(tk.tidy(sort_names), ROW)


def settle(ids: np.ndarray, data: np.ndarray, off: np.ndarray, known: np.ndarray, which: np.ndarray, with_text: bool) -> pa.RecordBatch:
    """Results of the documents ``which`` from the starts of their repeated strings."""
    edge = np.zeros(len(data) + 1, np.int32)
    starts = np.flatnonzero(known)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + LENGTH, -1)  # a string ends within its document
    gone = np.cumsum(edge)[:-1] > 0
    opens = gone & ~np.concatenate([[False], gone[:-1]])
    opens[off[:-1][np.diff(off) > 0]] = gone[off[:-1][np.diff(off) > 0]]
    removed, spans = tk.total(gone, off), tk.total(opens, off)
    keep, hashes = [], []
    for d in which:
        piece = data[off[d] : off[d + 1]]
        if removed[d]:
            piece = piece[~gone[off[d] : off[d + 1]]]
        piece = piece.tobytes()
        hashes.append(hashlib.sha256(piece).hexdigest())
        keep.append(piece.decode("utf-8", "ignore") if with_text and removed[d] else None)
    cols = [ids[which], np.diff(off)[which], removed[which], spans[which]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(hashes, pa.string()), pa.array(keep, pa.string())], [c.split()[0] for c in RESULT.split(", ")])


def cover(k: np.ndarray, doc: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Marks the starts of all strings over the samples ``k``."""
    edge = np.zeros(off[-1] + 2, np.int32)
    low, high = strings_over(place(k), np.diff(off)[doc])
    some = high >= low
    np.add.at(edge, (off[:-1][doc] + low)[some], 1)
    np.add.at(edge, (off[:-1][doc] + high + 1)[some], -1)
    return np.cumsum(edge)[: off[-1]] > 0


#: Columns of RESULT behind the id, and rows of both kinds in one table.
BLANK = {c.split()[0]: {"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in RESULT.split(", ")[1:]}
EITHER = ROW + ", " + RESULT.replace("id long, ", "")


def widen(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = len(batch)
    if "part" in batch.schema.names:
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(n, t) for t in BLANK.values())], [*batch.schema.names, *BLANK])
    cols = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), batch.column("id"), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), *batch.columns[1:]]
    return pa.RecordBatch.from_arrays(cols, [*NAMES, *BLANK])


def passed_on(out: Rows, part: int, ids, data, off, own, done: np.ndarray, waits: np.ndarray, with_text: bool):
    """Documents that wait for a later step, with the starts that are done, and results of the others."""
    for d in np.flatnonzero(waits).tolist():
        runs = np.flatnonzero(np.diff(np.concatenate([[0], done[off[d] : off[d + 1]], [0]]))).astype(np.int64)
        out.add(part, TEXT, int(ids[d]), own[d]["blob"], runs.tobytes())
    yield from map(widen, out.full())
    yield widen(settle(ids, data, off, done, np.flatnonzero(~waits), with_text))


def known_starts(own: list[dict], off: np.ndarray) -> np.ndarray:
    """The starts that ``passed_on`` wrote down."""
    done = np.zeros(off[-1], bool)
    for d, row in enumerate(own):
        for a, b in np.frombuffer(row["known"], np.int64).reshape(-1, 2).tolist():
            done[off[d] + a : off[d] + b] = True
    return done


def opened(rows: DataFrame, parts: int, buckets: int, with_text: bool) -> DataFrame:
    """Step 3: fingerprints of the suffixes that are still open, documents that have such, and results of the others."""

    def open_strings(batches):
        out = Rows(parts)
        for part, _, known, ids, data, off, own in chunks(batches, (REPEATS, EDGES)):
            doc, k = spread(ids, known[REPEATS])
            done = cover(k, doc, off)
            doc, k = spread(ids, known[EDGES])
            at = np.flatnonzero(cover(k, doc, off) & ~done)
            waits = np.zeros(len(ids), bool)
            if len(at):
                doc = np.searchsorted(off, at, "right") - 1
                waits[doc] = True
                out.names(ids[doc], at - off[doc], POLY.ranges(POLY.prefix(data), at, at + LENGTH), buckets)
            yield from passed_on(out, part, ids, data, off, own, done, waits, with_text)
        yield from map(widen, out.last())

    return dealt(rows).mapInArrow(tk.tidy(open_strings), EITHER)


def sorted_strings(rows: DataFrame, parts: int, cuts: np.ndarray, with_text: bool) -> DataFrame:
    """Step 3: the suffixes that may repeat by range, each once for a block, documents that have such, and results of the others."""

    def deal_strings(batches):
        out = Rows(parts)
        for part, _, known, ids, data, off, own in chunks(batches, (FOUND,)):
            done = known_starts(own, off)
            doc, start = spread(ids, known[FOUND])
            open_at, waits = off[:-1][doc] + start, np.zeros(len(ids), bool)
            waits[doc] = True
            for low in range(0, len(open_at), BLOCK):
                at = open_at[low : low + BLOCK]
                suffix = strings(data, at, LENGTH)
                order = np.argsort(suffix, kind="stable")
                suffix, at = suffix[order], at[order]
                same = np.concatenate([[False], suffix[1:] == suffix[:-1]])
                done[at[same]] = True
                at, suffix = at[~same], suffix[~same]
                doc = np.searchsorted(off, at, "right") - 1
                for r, first, end in ranged(suffix, cuts):
                    out.add(r, STRINGS, None, pack(suffix[first:end], ids[doc[first:end]], (at - off[doc])[first:end]))
                    yield from map(widen, out.full())
            yield from passed_on(out, part, ids, data, off, own, done, waits, with_text)
        yield from map(widen, out.last())

    return dealt(rows).mapInArrow(tk.tidy(deal_strings), EITHER)


def merged(rows: DataFrame, parts: int) -> DataFrame:
    """Step 4: suffixes of a range sorted by their bytes; those whose prefix equals that of the one before."""

    def merge_strings(batches):
        out = Rows(parts)
        for _, got in passed(STRINGS, batches, out):
            suffix, ids, start = joined([unpack(r["blob"]) for r in got])
            # in document order first, so that of equal strings the first stands first
            order = np.lexsort((start, ids))
            order = order[np.argsort(suffix[order], kind="stable")]
            same = order[1:][suffix[order][1:] == suffix[order][:-1]]
            out.positions(STRINGS, ids[same], start[same])
            yield from out.full()
        yield from out.last()

    return dealt(rows).mapInArrow(tk.tidy(merge_strings), ROW)


def closed(rows: DataFrame, with_text: bool) -> DataFrame:
    """Results of the documents that waited for step 4."""

    def close_documents(batches):
        for _, _, known, ids, data, off, own in chunks(batches, (STRINGS,)):
            done = known_starts(own, off)
            doc, start = spread(ids, known[STRINGS])
            done[off[:-1][doc] + start] = True
            yield settle(ids, data, off, done, np.arange(len(ids)), with_text)

    return dealt(rows).mapInArrow(tk.tidy(close_documents), RESULT)


def release(spark, n_bytes: int) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are done with; it acts when the driver collects its garbage.  Small ones can wait."""
    for _ in range(2 if n_bytes > 1 << 26 else 0):  # what Python lets go, the JVM sees a moment later
        gc.collect()
        time.sleep(1)
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def spans(source: DataFrame, n_bytes: int, with_text: bool = False) -> DataFrame:
    """RESULT of rows (id, text) with unique ids and ``n_bytes`` of text; ``with_text`` gives what is left of cut texts."""
    spark = source.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))
    ranges = min(MOST_RANGES, parts)
    tk.tune(spark, 1000)
    found = tk.stored(repeated(sampled(source, parts, parts), parts), "uncompressed")
    release(spark, n_bytes)
    cuts = borders(found, ranges, n_bytes)
    answers = tk.stored(ranked(asked(found.where(F.col("kind") == FOUND).union(texts(source, parts)), parts, cuts), parts), "uncompressed")
    tk.drop(found)
    release(spark, n_bytes)
    classes = tk.stored(classed(grouped(answers, parts, parts), parts), "uncompressed")
    tk.drop(answers)
    release(spark, n_bytes)
    step = tk.stored(opened(classes.union(texts(source, parts)), parts, parts, with_text), "uncompressed")
    tk.drop(classes)
    release(spark, n_bytes)
    kind, names = F.col("kind"), [c.split()[0] for c in RESULT.split(", ")]
    often = repeated(step.where(kind.isin(SAMPLES, FOUND)).select(NAMES), parts)
    last_step = tk.stored(sorted_strings(often.union(step.where(kind == TEXT).select(NAMES)), parts, cuts, with_text), "uncompressed")
    settled = tk.stored(step.where(kind.isNull()).select(names))
    tk.drop(step)
    release(spark, n_bytes)
    starts = merged(last_step.where(kind == STRINGS).select(NAMES), parts)
    last = closed(starts.union(last_step.where(kind == TEXT).select(NAMES)), with_text)
    return settled.union(last_step.where(kind.isNull()).select(names)).union(last)


def numbered(docs: DataFrame) -> tuple[DataFrame, int, DataFrame | None]:
    """(id, text) with unique ids in document order, and its bytes; and, where doc_id is not unique, (id, doc_id, digest) beside it."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = source.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum(F.octet_length("text").cast("long")).alias("n"))
    n_bytes, clash = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.expr("k > 1 OR doc_id IS NULL")), F.lit(False))).first()
    if not clash:
        return source.withColumnRenamed("doc_id", "id"), n_bytes, None
    source = source.withColumn("digest", F.sha2("text", 256))
    # range partitions in order, so that growing ids follow (doc_id, digest)
    key = tk.stored(source.select("doc_id", "digest").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "digest").withColumn("id", F.monotonically_increasing_id()))
    one = source.dropDuplicates(["doc_id", "digest"]).join(key.withColumnsRenamed({"doc_id": "d", "digest": "g"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")))
    return tk.stored(one.select("id", "text")), n_bytes, key


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    source, n_bytes, key = numbered(docs)
    out = spans(source, n_bytes).drop("kept")
    if key is None:
        return out.withColumnRenamed("id", "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("digest"))
    found = key.join(out, "id").withColumnsRenamed({"doc_id": "d", "digest": "g"})
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))).drop("digest", "id", "d", "g")


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut from ``text`` (bytes of characters cut in two go as well), n_chars with it; all rows stay."""
    source, n_bytes, key = numbered(docs)
    clean = spans(source, n_bytes, with_text=True).where("n_removed > 0").select("id", F.col("kept").alias("clean_text"))
    mine = docs["doc_id"].cast("long")
    if key is not None:
        clean = key.join(clean, "id").drop("id")
        on = mine.eqNullSafe(clean["doc_id"]) & (F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256) == clean["digest"])
    else:
        on = mine == clean["id"]
    cut, text = clean["clean_text"], docs["text"].cast("string")
    cols = {"text": F.coalesce(cut, text)}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(cut.isNull(), docs["n_chars"]).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType)
    return docs.join(clean, on, "left").select(*(cols[c].alias(c) if c in cols else docs[c] for c in docs.columns))
