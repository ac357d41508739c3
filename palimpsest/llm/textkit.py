"""Shared numpy kernels over whole Arrow text columns, and places to write tables.

Every kernel works on the flat UTF-8 bytes of several documents at once, so no
Python object is made per word.  Fingerprints are polynomials modulo 2**64 over
byte weights, finished with a mixer; windows never cross document borders.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
CHUNK = 1 << 20
WS = np.zeros(256, bool)
WS[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tune(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Keep an Arrow batch to ``rows`` and about ``size`` bytes of whole documents, so that Python holds few at once.

    These are session settings, read when a plan runs, so they stay set behind the operator that sets them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


#: Tables that a worker keeps from task to task, by the module that made them and a name.
HELD: dict[tuple[str, str], object] = {}


def held(module: str, name: str, make):
    """What ``make(name)`` returned when it was first asked for."""
    if (module, name) not in HELD:
        HELD[module, name] = make(name)
    return HELD[module, name]


def release() -> None:
    """Hand back memory that stays with the allocators of numpy, Arrow and the C library."""
    Poly.power = Poly.inverse = np.zeros(0, np.uint64)
    Poly.size = 0
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """``run`` for ``mapInArrow``.  A worker serves many tasks: it drops the tables of other operators first, and unused memory last."""

    def tidied(batches):
        for key in [k for k in HELD if k[0] != run.__module__]:
            del HELD[key]
        for batch in run(batches):
            yield batch
            pa.default_memory_pool().release_unused()
        release()

    tidied.__name__ = run.__name__
    return tidied


def workdir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; only a local session may have none and gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/palimpsest-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    spark, path = df.sparkSession, workdir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and nothing still to be computed reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK):
    """(first row, bytes, offsets) of runs of whole documents of about ``limit`` bytes."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Poly:
    """Fingerprints of byte ranges from prefix sums of ``weight[byte] * base**position``.

    Kinds of fingerprints differ by their weights; all share the powers of one base,
    which a worker holds once, from its first use on.
    """

    base, size = 0x5DEECE66D1CE4E5B, 0
    power = inverse = np.zeros(0, np.uint64)

    def __init__(self, seed: int):
        self.weight = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)

    @classmethod
    def _grow(cls, size: int) -> None:
        def powers(base: int) -> np.ndarray:
            out = np.full(size, base & ((1 << 64) - 1), np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        cls.power, cls.inverse, cls.size = powers(cls.base), powers(pow(cls.base, -1, 1 << 64)), size

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= self.size:
            self._grow(max(CHUNK, len(data) + len(data) // 8) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.weight[data] * self.power[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ``[^\\x20\\x09-\\x0D]+``, and the first word of each row (one more than rows)."""
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    text = ~WS[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = text[:-1], text[1:]
    start = np.flatnonzero(text & (~before | border[:-1]))
    end = np.flatnonzero(text & (~after | border[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def windows(values: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of ``size`` values in a row: (fingerprint, row, index of the first value).

    A row with fewer values, but at least one, gives one window of all of them.
    """
    n, count = len(values), np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    take = np.minimum(count, size)
    whole = np.arange(n) + take[row] <= first[1:][row] if n else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    out, length, factor = np.zeros(len(at), np.uint64), take[row[at]], 0x9E3779B97F4A7C15
    for j in range(size):
        inside = length > j
        out = np.where(inside, (out + values[np.minimum(at + j, n - 1)]) * U(factor), out) if n else out
    return mix(out + length.astype(np.uint64)), row[at], at


def total(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` within each row."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return np.diff(out[offsets])


def twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur two times or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    found = np.zeros(len(keys), bool)
    found[order[1:]] = same
    found[order[:-1]] |= same
    return found
