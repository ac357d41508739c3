"""Next-fit packing in which no task sees a whole key.

A volume that starts at a row ends before the first row at which the running sum
passes the sum in front of the volume by more than the capacity; so where a
volume that starts at *any* row ends is a binary search on running sums.

Rows are sorted into range partitions once, and kept there by a checkpoint.  A
key that stands in one partition is packed there.  A key that spans several is
cut into segments, of which a partition has two at most.  Within a segment every
row's chain of volumes is followed to the last one that starts there, by pointer
doubling in arrays.  Only rows within the first capacity of a segment can start
its first volume, so only those are nodes of a graph between segments: from a
node to the row behind its last volume, which is found by meeting the rows of a
bucket of running sums.  Pointer doubling over that graph, log2(segments) joins
from a key's first row on, tells where each segment is entered and at which volume.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import cut


def sums(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums in front of each row, and behind it."""
    behind = np.cumsum(sizes)
    return behind - sizes, behind


def nexts(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Of a volume that starts at each row, the row at which the one after it starts; the number of rows if none does."""
    front, behind = sums(sizes)
    return np.maximum(np.searchsorted(behind, front + capacity, "right"), np.arange(1, len(sizes) + 1))


def lasts(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start of the last volume on each row's chain, and the volumes opened on the way there."""
    n, at = len(following), np.arange(len(following))
    to, opened = np.where(following < n, following, at), (following < n).astype(np.int64)
    while True:
        further = to[to]
        if (further == to).all():
            return to, opened
        opened, to = opened + opened[to], further


def entered(sizes: np.ndarray, capacity: int, reserve: int) -> tuple[int, int]:
    """Where a key's first volume to start in its first segment starts, and its number; without a reserve volume 0 starts at the first row."""
    return (int(np.searchsorted(np.cumsum(sizes), capacity - reserve, "right")), 1) if reserve else (0, 0)


class Numbered:
    """Volumes of a segment's rows, batch by batch: ``before`` up to the row ``start``, where ``volume`` starts; without a ``start`` the segment is its key's first.

    What is kept between batches is the open volume, and the sums in front of it and of the next row.
    """

    def __init__(self, capacity: int, reserve: int, planned: tuple[int, int, int] | None):
        self.capacity, self.sum = capacity, 0
        self.volume, self.start, self.first = planned or (0, None if reserve else 0, 0)
        self.front = -reserve if planned is None and reserve else None

    def __call__(self, sizes: np.ndarray) -> np.ndarray:
        n, out = len(sizes), np.empty(len(sizes), np.int64)
        behind = self.sum + np.cumsum(sizes)
        at = 0
        if self.front is None:  # in front of the first volume that starts here
            at = min(n, self.start)
            out[:at], self.start = self.volume, self.start - at
            if at < n:
                self.front, self.volume = int(behind[at] - sizes[at]), self.first
                out[at] = self.first
                at += 1
        while at < n:
            end = at + int(np.searchsorted(behind[at:], self.front + self.capacity, "right"))
            out[at:end] = self.volume
            if end < n:  # this row opens a volume, and stands in it whatever its size
                self.front, self.volume = int(behind[end] - sizes[end]), self.volume + 1
                out[end] = self.volume
            at = end + 1
        self.sum = int(behind[-1]) if n else self.sum
        return out


def encoded(keys: pa.Array) -> np.ndarray:
    """A number for each key; null keys are one key."""
    return np.asarray(keys.dictionary_encode(null_encoding="encode").indices)


def cuts(code: np.ndarray) -> np.ndarray:
    """Where runs of equal codes start, and the end."""
    return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))


def segments(table: pa.Table, key: str, size: str):
    """(place, first row, sizes) of the runs of one key in a partition; place 0 is the first, 1 the last, None between."""
    if not table.num_rows:
        return
    code = encoded(table.column(key).combine_chunks())
    sizes = np.asarray(table.column(size).combine_chunks().cast(pa.int64()).fill_null(0))
    ends = cuts(code)
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        yield 0 if not k else 1 if k == len(ends) - 2 else None, int(a), sizes[a:b]


def volumes(rows: DataFrame, capacity: int, key: str, size: str, order: list, reserve: int = 0) -> DataFrame:
    """``rows`` with ``volume``: by key, in ``order``, a row that does not fit opens the next volume; the first starts with ``reserve`` used.

    A row larger than the capacity stands alone; a null size counts as 0, and null keys are one key.  The order should be total.
    """
    if capacity < 0 or reserve < 0:
        raise ValueError("capacity and reserve must not be negative")
    base = cut(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order))
    narrow, kind = base.select(key, size), base.schema[key].dataType.simpleString()

    def outer(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        for place, a, sizes in segments(table, key, size) if table else ():
            if place is not None:
                columns = [[TaskContext.get().partitionId()], [place], [a], table.column(key).slice(a, 1).combine_chunks(), [int(sizes.sum())]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:2]), pa.array(columns[2], pa.int64()), columns[3], pa.array(columns[4], pa.int64())], ["part", "place", "at", "key", "total"])

    # at most two rows a partition; keys that span partitions become chains of segments
    chains: list[list[tuple[int, int, int]]] = []
    before: tuple | None = None
    first = {}
    for part, place, at, name, total in sorted((tuple(r) for r in narrow.mapInArrow(outer, f"part int, place int, at long, key {kind}, total long").collect()), key=lambda r: r[:2]):
        first[part, place] = at
        if before is None or before[0] == part or before[1] != name:
            chains.append([])
        chains[-1].append((part, place, total))
        before = (part, name)
    chains = [c for c in chains if len(c) > 1]
    where = {(part, place): (c, k, sum(t for _, _, t in chain[:k]), k + 1 < len(chain)) for c, chain in enumerate(chains) for k, (part, place, _) in enumerate(chain)}
    plan = _chained(narrow, key, size, capacity, reserve, where, max(map(len, chains))) if chains else {}

    planned = {(part, first[part, place]): told for (part, place), told in plan.items()}

    def run(batches):
        """Rows stream: a task holds one batch, and of its key the open volume."""
        part, done, last, now = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(key)
            sizes, out = np.asarray(batch.column(size).cast(pa.int64()).fill_null(0)), []
            ends = cuts(encoded(names))
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if a or now is None or len(cuts(encoded(pa.concat_arrays([last, names.slice(0, 1)])))) > 2:
                    now = Numbered(capacity, reserve, planned.get((part, done + a)))
                out.append(now(sizes[a:b]))
            last, done = names.slice(batch.num_rows - 1, 1), done + batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, "volume"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{schema}, volume long")


NODE = ["chain", "segment", "at"]


def _chained(narrow: DataFrame, key: str, size: str, capacity: int, reserve: int, where: dict, longest: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(part, place) of each segment of a chain: the volume at its start, and the row and number of the first volume that starts in it."""

    def nodes(batches):
        batches, part = list(batches), TaskContext.get().partitionId()
        table = pa.Table.from_batches(batches) if batches and ((part, 0) in where or (part, 1) in where) else None
        for place, _, sizes in segments(table, key, size) if table else ():
            if (part, place) not in where:
                continue
            chain, k, shift, more = where[part, place]
            front, behind = sums(sizes)
            last, opened = lasts(nexts(sizes, capacity))
            n = int(np.searchsorted(front, capacity, "right"))  # rows that can start the segment's first volume
            at, low, high, aim, opened = np.arange(n), front[:n], behind[:n], front[last[:n]] + capacity, opened[:n]
            start = np.full(n, -1)
            if k == 0:
                entry, number = entered(sizes, capacity, reserve)
                if entry < len(sizes):
                    start[entry] = number
                else:  # the first volume goes on behind the segment
                    at, low, high, aim, opened, start = (np.append(x, v) for x, v in zip((at, low, high, aim, opened, start), (-1, 0, 0, capacity - reserve, 0, 0), strict=True))
            fixed = [np.full(len(at), x) for x in (chain, k)]
            flags = [pa.array(aim < behind[-1]), pa.array(np.full(len(at), more))]  # too large for its volume: the next segment's first row starts one
            yield pa.RecordBatch.from_arrays([*map(pa.array, (*fixed, at, low + shift, high + shift, aim + shift, opened, start)), *flags], [*NODE, "low", "high", "aim", "opened", "start", "forced", "more"])

    node = cut(narrow.mapInArrow(nodes, "chain long, segment long, at long, low long, high long, aim long, opened long, start long, forced boolean, more boolean"))
    width = capacity // 4 + 1
    bucket = lambda x: F.call_function("div", x, F.lit(width))
    reach = F.sequence(bucket(F.col("low")), bucket(F.least("high", F.col("low") + capacity + 1) - 1))
    target = node.where("high > low").select(*NODE, "low", "high", F.explode(reach).alias("bucket"))
    asked = node.where("more AND NOT forced").select(*(F.col(c).alias(f"from_{c}") for c in (*NODE, "aim", "opened")), bucket(F.col("aim")).alias("from_bucket"))  # names of its own, as both sides come of one table

    edge = ["chain", "segment", "at", "opened", "to_segment", "to_at"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in edge})
        left = left.sort_by("low")
        low, high, aim = (np.asarray(t.column(c).combine_chunks()) for t, c in ((left, "low"), (left, "high"), (right, "from_aim")))
        k = np.searchsorted(low, aim, "right") - 1
        hit = (k >= 0) & (aim < high[np.maximum(k, 0)])
        right, found = right.filter(pa.array(hit)), left.take(pa.array(k[hit]))
        return pa.table({c: right.column(f"from_{c}") for c in (*NODE, "opened")} | {f"to_{c}": found.column(c) for c in NODE[1:]})

    jump = target.groupBy("chain", "bucket").cogroup(asked.groupBy("from_chain", "from_bucket")).applyInArrow(meet, ", ".join(f"{c} long" for c in edge))
    forced = node.where("more AND forced").select(*NODE, "opened", (F.col("segment") + 1).alias("to_segment"), F.lit(0).cast("long").alias("to_at"))
    jump = cut(jump.unionByName(forced).select(*NODE, "to_segment", "to_at", (F.col("opened") + 1).alias("volumes")))
    found = node.where("start >= 0").select(*NODE, F.col("start").alias("volume"))
    for _ in range((longest - 1).bit_length()):
        further = found.join(jump, NODE).select("chain", F.col("to_segment").alias("segment"), F.col("to_at").alias("at"), F.col("volume") + F.col("volumes"))
        found = cut(found.union(further))
        second = jump.select("chain", F.col("segment").alias("to_segment"), F.col("at").alias("to_at"), F.col("to_segment").alias("s"), F.col("to_at").alias("a"), F.col("volumes").alias("v"))
        jump = cut(jump.join(second, ["chain", "to_segment", "to_at"]).select(*NODE, F.col("s").alias("to_segment"), F.col("a").alias("to_at"), (F.col("volumes") + F.col("v")).alias("volumes")))
    # one row a segment at most
    entry = {(r["chain"], r["segment"]): r for r in found.join(node, NODE).where("at >= 0").select(*NODE, "volume", "opened").collect()}
    plan, now = {}, {}
    for (part, place), (chain, k, _, _) in sorted(where.items(), key=lambda x: x[1][:2]):
        r = entry.get((chain, k))
        plan[part, place] = (now.get(chain, 0), r["at"] if r else 1 << 62, r["volume"] if r else 0)
        if r:
            now[chain] = r["volume"] + r["opened"]
    return plan
