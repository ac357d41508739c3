"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set holds its
distinct 5-word shingles (with fewer words, the whole sequence).  Two
permutations make the signature: the first scatters the shingles, the second,
shifted by 0, 1, 2, ..., gives coordinate after coordinate.  32 bands of 4
coordinates miss a pair of Jaccard 0.75 with probability (1 - 0.75^4)^32 < 6e-6.

Documents with equal sets collapse to their smallest id first, so copies are
never paired.  Each bucket then proposes its members against its smallest one;
after these links are confirmed on full sets and joined to components, documents
of buckets that still hold several components meet across components, and only
there, behind size and prefix filters that every pair of the similarity passes.
So every pair of every bucket is confirmed, refuted, or already within one
component; nothing is capped.  Documents that many others meet get
several salted copies, so that no task holds all partners of one.

Defined cases: a null or empty text, or one without words, has an empty set and
is its own component; rows of one doc_id are one document; a null doc_id has a
null component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

POLY = tk.Poly(6)
WORDS = 5
BANDS, WIDTH = 32, 4
#: Partners of one document in one task.
SALT = 128
#: Tasks over which the members of one group of equal sets spread.
SLOTS = 1024


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row: (fingerprint, row), rows ascending."""
    low = tk.LOWER[data]
    start, end, first = tk.words(low, offsets)
    value, row, _ = tk.windows(POLY.ranges(POLY.prefix(low), start, end), first, WORDS)
    key = tk.mix(value + row.astype(np.uint64) * tk.U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[order[1:]] = key[order][1:] != key[order][:-1]
    return value[new], row[new]


def permute(x: np.ndarray) -> np.ndarray:
    """The second permutation, of the numbers below 2**32."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Coordinates (rows x BANDS * WIDTH) of sets whose shingles begin at ``begin``."""
    first = (tk.mix(value ^ tk.U(0x5851F42D4C957F2D)) >> tk.U(32)).astype(np.uint32)
    out = np.empty((len(begin), BANDS * WIDTH), np.uint32)
    for shift in range(out.shape[1]):
        out[:, shift] = np.minimum.reduceat(permute(first + np.uint32(shift)), begin)
    return out


def bands(sign: np.ndarray) -> np.ndarray:
    """A fingerprint of each band and its place."""
    out = np.zeros((len(sign), BANDS), np.uint64)
    for j in range(WIDTH):
        out = tk.mix(out + sign[:, j::WIDTH].astype(np.uint64) + tk.U(1))
    return tk.mix(out + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, bands (null for an empty set)."""
    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"

    def run(batches):
        for batch in batches:
            data, offsets = tk.flat(batch.column("text"))
            for row, part, off in tk.chunks(data, offsets):
                value, of = shingles(part, off)
                count = np.bincount(of, minlength=len(off) - 1)
                full = np.flatnonzero(count)
                begin = (np.cumsum(count) - count)[full]
                keys = [np.zeros(len(count), np.int64) for _ in range(2)]
                packed = [None] * len(count)
                if len(full):
                    for k, key in enumerate(keys):
                        key[full] = np.add.reduceat(tk.mix(value + tk.U(k + 1)), begin).view(np.int64)
                    flat = pa.array(bands(signature(value, begin)).ravel())
                    size = np.where(count > 0, BANDS, 0)
                    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    packed = pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(count == 0, False)), flat)
                else:
                    packed = pa.array(packed, pa.list_(pa.int64()))
                cols = [batch.column("doc_id").slice(row, len(count)), pa.array(count, pa.int64()), *map(pa.array, keys), packed]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

    tk.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tk.tidy(run), schema)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([press.compress(t or b"") for t in texts], pa.binary())], ["doc_id", "z"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tk.tidy(run), "doc_id long, z binary")


def sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted shingle sets."""
    data, offsets = tk.flat(pa.array(texts, pa.large_binary()))
    out = []
    for _, part, off in tk.chunks(data, offsets):
        value, of = shingles(part, off)
        out += [np.sort(s) for s in np.split(value, np.cumsum(np.bincount(of, minlength=len(off) - 1))[:-1])]
    return out


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full sets."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT).alias("copies"))
    left = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).alias("salt"))
    left = left.join(texts.withColumnRenamed("doc_id", "a"), "a").select("b", "salt", "a", "z")
    right = many.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"))
    right = right.join(texts.withColumnRenamed("doc_id", "b"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "z")

    def run(batches):
        press, key, own = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            b, salt, a = (batch.column(c).to_pylist() for c in ("b", "salt", "a"))
            # a text that stands in several pairs of a batch is taken apart once
            texts = batch.column("z").to_pylist()
            once = {z: k for k, z in enumerate(dict.fromkeys(texts))}
            full = sets([press.decompress(z) for z in once])
            found = []
            for i in range(len(b)):
                mine = full[once[texts[i]]]
                if (b[i], salt[i]) != key:
                    key, own = (b[i], salt[i]), []
                if a[i] is None:
                    own.append(mine)
                    continue
                for other in own:
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(other) - both):
                        found.append((a[i], b[i]))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    tk.tune(pairs.sparkSession, 300)
    return left.union(right).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first()).mapInArrow(tk.tidy(run), "a long, b long")


def across(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``rows`` (id, c) with different c that may have the similarity.

    Shingles are ordered by how few documents hold them.  Two sets of the similarity
    share one of the first n - ceil(percent / 100 * n) + 1 of both, and at their
    first shared one enough shingles follow in both; other pairs cannot have it.
    A shingle whose documents are all of one component brings none together.
    """

    def unpack(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            full = sets([press.decompress(z) for z in batch.column("z").to_pylist()])
            size = np.cumsum([0, *map(len, full)]).astype(np.int32)
            flat = np.concatenate([*full, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("c"), pa.ListArray.from_arrays(pa.array(size), pa.array(flat))], ["id", "c", "s"])

    source = rows.join(texts.withColumnRenamed("doc_id", "id"), "id").select("id", "c", "z")
    full = tk.stored(source.mapInArrow(tk.tidy(unpack), "id long, c long, s array<long>"))
    token = full.select("id", "c", F.explode("s").alias("s"))
    often = token.groupBy("s").agg(F.count("*").alias("k"), (F.min("c") < F.max("c")).alias("mixed"))
    # one document's shingles meet in its row
    ranked = token.drop("c").join(often, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "s", "mixed"))).alias("r"))
    n = F.size("r")
    ranked = ranked.select("id", n.alias("n"), F.posexplode(F.expr(f"slice(r, 1, size(r) - cast(ceil({percent} * size(r) / 100) AS int) + 1)")).alias("i", "r"))
    prefix = tk.stored(ranked.where("r.mixed").join(rows, "id").select("id", "n", "c", "i", F.col("r.s").alias("s")))
    tk.drop(full)
    other = prefix.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("i").alias("j"), "s")
    enough = f"1 + least(n - i - 1, m - j - 1) >= ceil({percent} * (n + m) / ({100 + percent}))"
    found = prefix.join(other, "s").where(f"id > b AND c <> d AND 100 * least(n, m) >= {percent} * greatest(n, m) AND {enough}")
    out = tk.stored(found.select(F.col("id").alias("a"), "b").distinct())
    tk.drop(prefix)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every linked id but the roots, by alternating large and small stars; root is the least id."""
    now = tk.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        old, now = now, tk.stored(large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).distinct())
        tk.drop(old)


def groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    sign = tk.stored(signed(docs))
    full = sign.where("n_shingles > 0 AND doc_id IS NOT NULL")
    rep = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k"))
    # members of a large group learn its least id in many slots, each of which asks once for it
    salted = full.select("doc_id", "k1", "k2", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot"))
    slots = salted.select("k1", "k2", "slot").distinct().join(rep.where("k > 1").drop("k"), ["k1", "k2"])
    member = salted.join(slots, ["k1", "k2", "slot"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    # a row for each set, and one bucket row for each of its bands
    lead = full.join(rep.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    bucket = lead.select(F.explode("bands").alias("band"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    pivot = bucket.groupBy("band").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("size")).where("size > 1")
    shared = tk.stored(bucket.join(pivot.select("band", F.col("p.id").alias("pid"), F.col("p.n").alias("pn")), "band"))
    near = f"100 * least(n, pn) >= {percent} * greatest(n, pn)"
    first = tk.stored(shared.where(f"id <> pid AND {near}").select(F.col("id").alias("a"), F.col("pid").alias("b")).distinct())

    needed = tk.stored(shared.select("id").distinct())
    texts = tk.stored(packed(docs.where(F.col("doc_id").isNotNull())).join(needed.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), "uncompressed")
    links = tk.stored(confirmed(first, texts, percent))
    roots = components(links)

    # documents of buckets that hold several components meet across these
    named = shared.select("band", "id").join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("c"))
    mixed = named.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("band")
    left = tk.stored(named.join(mixed, "band", "left_semi").select("id", "c").distinct())
    apart = across(left, texts, percent)
    second = tk.stored(apart.join(first, ["a", "b"], "left_anti"))
    tk.drop(shared, left, apart, needed)
    if not second.isEmpty():
        more = tk.stored(confirmed(second, texts, percent))
        if not more.isEmpty():
            roots = components(links.union(more))

    # rows of one id are one document: their sets' components join
    known = member.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("c"))
    clash = known.groupBy("doc_id").agg(F.min("c").alias("c"), F.max("c").alias("d"), F.count("*").alias("k"))
    clash = tk.stored(clash)
    tk.drop(first, second, texts, links)
    split = clash.where("c <> d").select(F.col("d").alias("a"), F.col("c").alias("b"))
    if not split.isEmpty():
        again = components(known.join(clash.where("c <> d").select("doc_id", F.col("c").alias("least")), "doc_id").select(F.col("c").alias("a"), F.col("least").alias("b")))
        clash = clash.join(again.withColumnRenamed("id", "c"), "c", "left").select("doc_id", F.coalesce("root", "c").alias("c"))
    out = sign.select("doc_id", "n_shingles").join(clash.select("doc_id", "c"), "doc_id", "left").withColumn("component_id", F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, all columns as they were."""
    gone = groups(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
