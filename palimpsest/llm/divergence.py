"""Source divergence audit: how far the term shares of a language's sources lie apart, and which terms set a source off.

Every occurring (lang, source) is a group.  A language keeps the V terms that at
least ``least`` of its documents hold; a group with ``count`` of a kept term and
N of all kept terms gives it p = 1 + floor(10**9 * (count + 2) / (N + 2 V)), and
two such shares lie f = floor((p - q)**2 / (p + q)) apart.

A pair of sources starts at V times f of their shares of a term with no count.
An inverted index, one posting of (source, count) a kept term, then emits only
corrections that are not zero: terms which one of the two holds are summed by
equal share first (a group has few different counts), terms which both hold meet
in their posting.  No pair of a source with a term that it lacks is made.

Defined cases: null text, lang and source count as ''; a language without kept
terms has pairs of value 0 and no terms; a null text has no terms, yet its group
occurs; repeated rows and ids are documents of their own; other columns are
ignored; an empty table gives no rows.  Products stay within 64 bits, or are
decimals where counts enter them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .terms import LETTERS, terms

#: Documents of a language that must hold a term; ranks of a group's terms that are reported.
LEAST_DOCS, TERM_RANKS = 10, 10
#: Pairs of a posting's sources that a task holds at once.
PAIRS = 1 << 20


def share(count: Column, total: Column) -> Column:
    """p of a count; exact, as the product is a decimal of 30 digits."""
    return 1 + F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)"), total.cast("decimal(19,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs that hold it), summed within an Arrow batch first, then by Spark."""

    def run(batches):
        for batch in batches:
            words, code, row = terms(batch.column("text"), LETTERS)
            group = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
            names, of = np.unique(np.array([f"{len(x['lang'])}:{x['lang']}{x['source']}" for x in group.to_pylist()], object), return_index=True, return_inverse=True)[1:]
            pair, n = np.unique(code.astype(np.int64) * batch.num_rows + row, return_counts=True)  # one a document and term
            key, place = np.unique(pair // max(1, batch.num_rows) * len(names) + of[pair % max(1, batch.num_rows)], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, place, n)
            at = pa.array(names[key % max(1, len(names))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(at), batch.column("source").take(at), words.take(pa.array(key // max(1, len(names)))).cast(pa.string()), pa.array(total), pa.array(np.bincount(place, minlength=len(key)))],
                ["lang", "source", "term", "n", "docs"],
            )

    partial = docs.mapInArrow(tk.tidy(run), "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def postings(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, held: array of (source, n)) of the kept terms; a posting has an entry a source that holds the term."""
    each = counted(docs).groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    return each.where(F.col("docs") >= least).select(F.monotonically_increasing_id().alias("tid"), "lang", "term", "total", "held")


def corrections(entries: DataFrame) -> DataFrame:
    """(g, h, value) with g < h of terms that both hold: f of the two shares, less what the sums by share and the start count for them."""

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    def run(batches):
        for batch in batches:
            held = batch.column("held")
            flat = held.flatten()
            g, p, zero = (np.asarray(flat.field(name)) for name in ("gid", "p", "zero"))
            ends = np.asarray(held.offsets).astype(np.int64) - held.offsets[0].as_py()
            row = np.repeat(np.arange(len(held)), np.diff(ends))
            order = np.lexsort((g, row))
            g, p, zero = g[order], p[order], zero[order]
            names, local = np.unique(g, return_inverse=True)
            partners = ends[1:][row] - np.arange(len(g)) - 1  # entries behind this one in its posting
            done = np.concatenate([[0], np.cumsum(partners)])
            first = 0
            while first < len(g):
                last = max(first + 1, int(np.searchsorted(done, done[first] + PAIRS, "right")) - 1)
                a = np.repeat(np.arange(first, last), partners[first:last])
                b = a + 1 + np.arange(len(a)) - (done[a] - done[first])
                value = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
                key, place = np.unique(local[a] * len(names) + local[b], return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, place, value)
                yield pa.RecordBatch.from_arrays([pa.array(names[key // len(names)]), pa.array(names[key % len(names)]), pa.array(total)], ["g", "h", "value"])
                first = last

    rows = entries.groupBy("tid").agg(F.collect_list(F.struct("gid", "p", "zero")).alias("held")).select("held")
    return rows.mapInArrow(tk.tidy(run), "g long, h long, value long")


def audit(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank.

    The tables of postings and groups stay in the checkpoint folder, as the result reads them.
    """
    tk.tune(docs.sparkSession, 4000, 8 << 20)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    index = tk.stored(postings(docs, least))
    entry = index.select("tid", "lang", "term", "total", F.inline("held"))
    kept = index.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = entry.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
    v, n = F.coalesce("v", F.lit(0)), F.coalesce("n", F.lit(0))
    groups = groups.select("lang", "source", v.alias("v"), (n + 2 * v).alias("m"), (F.coalesce("lang_n", F.lit(0)) + 2 * v).alias("lang_m"))
    groups = tk.stored(groups.select(F.monotonically_increasing_id().alias("gid"), "*", F.when(F.col("v") > 0, share(F.lit(0), F.col("m"))).alias("zero")))

    # stored tables have a size, so that Catalyst broadcasts the groups while they are few, and shuffles them else
    entry = entry.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("m")))
    q = share(F.col("total"), F.col("lang_m"))
    term = entry.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    one, two = (groups.select("lang", F.col("gid").alias(g), F.col("zero").alias(f"{g}0"), "v") for g in "gh")
    start = one.join(two.drop("v"), "lang").where("g < h").select("g", "h", F.coalesce(F.col("v") * apart(F.col("g0"), F.col("h0")), F.lit(0)).alias("value"))
    alike = entry.groupBy("lang", F.col("gid").alias("g"), F.col("zero").alias("g0"), "p").agg(F.count("*").alias("terms"))
    side = alike.join(two.drop("v"), "lang").where("g <> h").select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), (F.col("terms") * (apart(F.col("p"), F.col("h0")) - apart(F.col("g0"), F.col("h0")))).alias("value"))
    pairs = start.union(side).union(corrections(entry.select("tid", "gid", "p", "zero"))).groupBy("g", "h").agg(F.sum("value").alias("value"))
    both = pairs.union(pairs.select("h", "g", "value"))
    name = lambda g, *cols: groups.select(F.col("gid").alias(g), *cols)
    pair = both.join(name("g", "lang", "source"), "g").join(name("h", F.col("source").alias("item")), "h").select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    return pair.select("*", rank).union(term.select("*", rank).where(F.col("rank") <= ranks))
