"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by the leading bits of a 60-bit hash of the key.  A bucket whose bytes
pass the limit, and only such a one, splits on its next bit until every bucket
fits.  Sizes are summed by hash prefix before anything else, so that no bucket's
rows ever meet in one task; the splits are worked out on these sums, ``STEP``
bits at a time, and only rows of buckets that are still too large go to the next
round.

Defined cases: a null or empty text has 0 bytes; a null key hashes as the empty
string.  Rows of one key have one hash, so that no bit parts them: such a bucket
ends at the full 60 bits and is marked ``oversized``, as is a single row larger
than the limit, alone in its bucket.  An empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

BITS, STEP = 60, 15


def hash_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Buckets of ``rows`` (h, n_bytes): depth, prefix, shard_bytes, shard_rows, oversized."""
    # A round of STEP bits: sums of the finest prefixes give the sums of all shorter ones.
    done, base, todo = [], 0, rows.groupBy("h").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("r"))
    while base < BITS:
        top = min(BITS, base + STEP)
        fine = todo.groupBy(F.shiftright("h", BITS - top).alias("p")).agg(F.sum("b").alias("b"), F.sum("r").alias("r"), F.count("*").alias("k"))
        levels = fine.select("*", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")).select(
            "depth", F.expr(f"shiftright(p, {top} - depth)").alias("prefix"), "b", "r", "k"
        )
        sums = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("r").alias("shard_rows"), F.sum("k").alias("k"))
        # It fits, or holds a single hash value that no further bit can part.
        ends = sums.where(f"shard_bytes <= {limit} OR k = 1")
        over = sums.where(f"shard_bytes > {limit} AND k > 1")
        # A fitting bucket stands if its parent does not fit.
        parent = over.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        if base == 0:
            parent = parent.union(sums.where("depth = 0").select("depth", "prefix"))
        else:
            parent = parent.union(last.select(F.lit(base).alias("depth"), "prefix"))
        found = tk.stored(ends.join(parent, ["depth", "prefix"], "left_semi").select("depth", "prefix", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversized")))
        done.append(found)
        last = tk.stored(over.where(f"depth = {top}").select("prefix"))
        if last.isEmpty():
            break
        todo = todo.join(last, F.shiftright(todo["h"], BITS - top) == last["prefix"], "left_semi")
        base = top
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 8 << 20) -> DataFrame:
    """One row per document: its key, n_bytes, and the depth, prefix, bits and sizes of its shard."""
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes")).withColumn("h", hash_of(F.col(key)))
    shards = directory(rows, limit)
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())  # at most BITS + 1 numbers
    # A document belongs to the one bucket, of whatever depth, that its hash begins with.
    out = rows.select("*", F.explode(F.array(*map(F.lit, depths))).alias("depth")) if depths else rows.withColumn("depth", F.lit(0))
    out = out.withColumn("prefix", F.expr(f"shiftright(h, {BITS} - depth)")).join(shards, ["depth", "prefix"])
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr(f"substring(lpad(bin(h), {BITS}, '0'), 1, depth)"))
    return out.select(key, "n_bytes", F.col("depth").cast("int").alias("depth"), "prefix", bits.alias("bits"), "shard_bytes", "shard_rows", "oversized")
