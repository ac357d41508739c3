"""Selections of conversations and memories, paging, proposal lists, render modes, comparisons."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import fnv1a, utf8_bytes

from .sequences import numbered

MODES = {
    "conversation": ("user", "user_voice_transcript", "assistant_final", "assistant_voice_transcript"),
    "assistant-only": ("assistant_final", "assistant_voice_transcript"),
}


def refs(rows: DataFrame, provider: str | None = None, collection: str | None = None, query: str = "") -> DataFrame:
    """Conversation references (provider, id, title, collections array) that fit."""
    if provider:
        rows = rows.where(F.col("provider") == provider)
    if collection:
        rows = rows.where(F.array_contains("collections", collection))
    if query.strip():
        rows = rows.where(F.lower(F.concat_ws("\n", "title", "id")).contains(query.strip().lower()))
    return rows


def chosen(rows: DataFrame) -> DataFrame:
    """A selection without repeats: (key, position) in the order of first choice (column ``at``)."""
    first = rows.groupBy(F.concat_ws(":", "provider", "id").alias("key")).agg(F.min("at").alias("at"))
    return numbered(first, ["at", "key"], "position").select("key", "position")


def selection_mark(rows: DataFrame, by: str, key: str = "key") -> DataFrame:
    """A 32-bit fingerprint of each small selection (one set of keys a row), whatever their order."""
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(key)), "\n").alias("keys")).select(by, fnv1a(utf8_bytes("keys")).alias("mark"))


def toggled(selection: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that stand in exactly one of both."""
    return selection.join(keys, "key", "left_anti").select("key").union(keys.join(selection, "key", "left_anti").select("key"))


def memories(objects: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Objects by how many white-space words of the query they contain, then the newest; without a query all."""
    words = query.lower().split()
    text = F.lower(F.concat_ws("\n", "title", "body"))
    rows = objects.where("status <> 'trashed'").withColumn("score", sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0)))
    rows = rows.where("score > 0") if words else rows
    rows = rows.orderBy(F.desc("score"), F.desc("updated_at"), "id")
    return rows.limit(limit) if limit else rows


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """The ``number``-th page (from 1): a sorted limit and offset."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def proposals(rows: DataFrame, limit: int = 200) -> DataFrame:
    """Pending first, then conflicts, approved and rejected ones; the newest of each first."""
    rank = F.when(F.col("status") == "pending_review", 0).when(F.col("status") == "conflict", 1).when(F.col("status") == "approved", 2).otherwise(3)
    return rows.orderBy(rank, F.desc("created_at"), "id").limit(limit)


def rendered(nodes: DataFrame, mode: str = "conversation") -> DataFrame:
    """Nodes that a render mode shows; the technical one shows all."""
    return nodes.where(F.col("semantic").isin(*MODES[mode])) if mode in MODES else nodes


def funnel(nodes: DataFrame, by: str, mode: str = "conversation") -> DataFrame:
    """Messages on the path, after joining fragments, in the mode, and with something to show."""
    w = Window.partitionBy(by).orderBy("turn")
    same = F.coalesce((F.col("semantic") == F.lag("semantic").over(w)) & (F.col("stream_group") == F.lag("stream_group").over(w)), F.lit(False))
    inside = F.col("semantic").isin(*MODES[mode]) if mode in MODES else F.lit(True)
    rows = nodes.withColumn("fresh", ~same).withColumn("inside", inside)
    shown = F.trim(F.coalesce("text", F.lit(""))) != ""
    return rows.groupBy(by).agg(F.count("*").alias("path_nodes"), F.count_if("fresh").alias("coalesced"), F.count_if(F.col("fresh") & F.col("inside")).alias("included"), F.count_if(F.col("fresh") & F.col("inside") & shown).alias("rendered"))


def compared(runs: DataFrame, by: str, arm: str, value: str) -> DataFrame:
    """Scores of an experiment's two arms and their difference."""
    pick = lambda name: F.max(F.when(F.col(arm) == name, F.col(value)))
    return runs.groupBy(by).agg(pick("off").alias("off"), pick("on").alias("on")).withColumn("delta", F.col("on") - F.col("off"))


def benchmark_total(dimensions: DataFrame, by: str) -> DataFrame:
    """Sum of a response's dimension scores between 0 and 100, two digits."""
    return dimensions.groupBy(by).agg(F.round(F.least(F.greatest(F.sum("score"), F.lit(0.0)), F.lit(100.0)), 2).alias("total"))


# Keys whose values are never kept, and names of asset references in raw payloads.
SECRET = re.compile("token|authorization|cookie|downloadurl|signedurl|sourceurl", re.I)
ASSET = re.compile(r"\bfile[-_][A-Za-z0-9]+")


def without_secrets(rows: DataFrame, column: str, depth: int = 8, most: int = 50) -> DataFrame:
    """JSON with secret keys dropped at every level, arrays up to ``most`` items, nesting up to ``depth``."""

    def walk(value, left):
        if left < 0:
            return None
        if isinstance(value, list):
            return [walk(v, left - 1) for v in value[:most]]
        if isinstance(value, dict):
            return {k: walk(v, left - 1) for k, v in value.items() if not SECRET.search(k)}
        return value

    return mapped(rows, column, lambda v: json.dumps(walk(v, depth), ensure_ascii=False, sort_keys=True))


def asset_refs(rows: DataFrame, column: str, depth: int = 18) -> DataFrame:
    """Distinct file ids anywhere in JSON, joined by commas."""

    def walk(value, left):
        if left < 0:
            return
        if isinstance(value, str):
            yield from ASSET.findall(value)
        for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            yield from walk(v, left - 1)

    return mapped(rows, column, lambda v: ",".join(sorted(set(walk(v, depth)))))


def mapped(rows: DataFrame, column: str, f) -> DataFrame:
    """``rows`` with ``f`` of the parsed JSON in a column; what does not parse is null."""
    names, schema, at = rows.columns, rows.schema, rows.columns.index(column)

    def one(text):
        try:
            return f(json.loads(text))
        except (TypeError, ValueError):
            return None

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([one(t) for t in c.to_pylist()], pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names)

    return rows.mapInArrow(run, schema)


def clamp(value: Column, low: int, high: int, fallback: int) -> Column:
    """A bounded integer from text or number."""
    return F.least(F.greatest(F.coalesce(F.floor(value.try_cast("double")), F.lit(fallback)), F.lit(low)), F.lit(high)).cast("long")


def yaml(entries: Column) -> Column:
    """Flat front matter of a map, keys in order, values quoted."""
    lines = F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(e["key"], F.lit(': "'), F.replace(F.coalesce(e["value"], F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---"))
