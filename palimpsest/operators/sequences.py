"""Operators on ordered rows: runs, fragment merges, ranks, aliases, viewport merges, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .canonical import cut
from .fold import ordered


def runs(rows: DataFrame, key: str, order: str, same: list[str]) -> DataFrame:
    """Adds ``run``: neighbours equal in all of ``same`` (and not null) share a number from 1 on."""
    w = Window.partitionBy(key).orderBy(order)
    equal = F.lit(True)
    for c in same:
        equal = equal & F.coalesce(F.col(c) == F.lag(c).over(w), F.lit(False))
    return rows.withColumn("new", F.when(equal, 0).otherwise(1)).withColumn("run", F.sum("new").over(w).cast("long")).drop("new")


def coalesced(rows: DataFrame, key: str, order: str, same: list[str], text: str = "text") -> DataFrame:
    """One row a run; a fragment that begins with what came before replaces it, else it is added.

    Fragments stream in order through a fold, so a run of any length keeps one text.
    """
    rows = runs(rows, key, order, same)

    def step(state, row):
        run, body = state
        part = row[text] or ""
        if row["run"] != run:
            body = part
        elif part.startswith(body):
            body = part
        elif not body.startswith(part):
            body += part
        return (row["run"], body), (body,)

    folded = ordered(rows, key, [order], step, lambda: (None, ""), "merged string")
    last = folded.groupBy(key, "run").agg(F.max_by("merged", order).alias("text"), F.min(order).alias("first"), F.count("*").alias("fragments"), *(F.first(c).alias(c) for c in same))
    return last


def capped(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """At most ``n`` rows of each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def numbered(rows: DataFrame, order: list, name: str = "n") -> DataFrame:
    """Adds 1, 2, 3, ... in an order over all rows: a distributed sort, then each partition counts from where those before it end.

    Only one number a partition is gathered; the rows never meet in one task.
    """
    fixed = cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # one row a partition
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.coalesce("_before", F.lit(0)) + 1
    return fixed.join(before.select("_part", "_before"), "_part").withColumn(name, place).drop("_at", "_part", "_before")


def aliases(rows: DataFrame, key: str, order: str, prefix: str) -> DataFrame:
    """(key, alias): numbers in the order of first appearance."""
    first = rows.groupBy(key).agg(F.min(order).alias("first"))
    return numbered(first, ["first", key]).select(key, F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), 3, "0")).alias("alias"))


def parity_roles(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Fills an unknown role by the parity of the position."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("role", F.when(F.col("role").isNull() | (F.col("role") == "unknown"), F.when(n % 2 == 1, "user").otherwise("assistant")).otherwise(F.col("role")))


def days(rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, day, first, items): consecutive rows of one day."""
    return rows.groupBy(key, F.to_date(at).cast("string").alias("day")).agg(F.min(at).alias("first"), F.count("*").alias("items"))


def viewport(rows: DataFrame, key: str, batch: str, order: str, sign: str) -> DataFrame:
    """Rows of overlapping batches once: the longest end of what is known that the next batch begins with is skipped.

    Adds ``fresh``.  The state is the list of signatures seen last, at most one batch long.
    """

    def step(state, row):
        known, now, current, pending = state
        if row[batch] != now:
            known = (known + current)[-len(current) or None :] if current else known
            now, current, pending = row[batch], [], None
        if pending is None:
            size = row["batch_size"]
            signs = row["batch_signs"]
            pending = next((n for n in range(min(len(known), size), 0, -1) if known[-n:] == signs[:n]), 0)
        current = [*current, row[sign]]
        return (known, now, current, pending), (len(current) > pending,)

    w = Window.partitionBy(key, batch)
    rows = rows.withColumn("batch_size", F.count("*").over(w))
    rows = rows.withColumn("batch_signs", F.transform(F.array_sort(F.collect_list(F.struct(order, sign)).over(w)), lambda x: x[sign]))
    out = ordered(rows, key, [batch, order], step, lambda: ([], None, [], None), "fresh boolean")
    return out.drop("batch_size", "batch_signs")


def layout(rows: DataFrame, kind: str, order: str, step: int = 120, most: int = 200) -> DataFrame:
    """Adds x and y of canvas cards: a column for each kind, a row for each card."""
    ranked = capped(rows, kind, [order], most)
    columns = numbered(rows.select(kind).distinct(), [kind], "k")
    return ranked.join(columns, kind).withColumn("x", (F.col("k") - 1) * 400).withColumn("y", (F.col("rank") - 1) * step).drop("rank", "k")
