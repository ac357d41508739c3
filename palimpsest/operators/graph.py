"""Project knowledge graph: compile, validate, list connections, render."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import parsed_uri, safe_id


def node_id(kind: str, *parts):
    return F.concat_ws(":", F.lit(kind), *(safe_id(p) for p in parts))


def edges_of(df: DataFrame, from_, relation: str, to, uri=None) -> DataFrame:
    uri = F.lit(None).cast("string") if uri is None else uri
    rows = df.select(from_.alias("from_id"), F.lit(relation).alias("relation"), to.alias("to_id"), uri.alias("uri"))
    return rows.withColumn("id", F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat_ws("\0", "from_id", "relation", "to_id", F.coalesce("uri", F.lit(""))), 256), 1, 16)))


def compile(projects: DataFrame, conversations: DataFrame, records: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of projects (project_id, title), conversations (conversation_id, project_id, title), records
    (project_id, kind, id, title, depends_on, superseded_by, evidence array) and assets (id, title, conversations array)."""
    none = F.array().cast("array<string>")
    node = lambda df, id_, kind, title, uris: df.select(id_.alias("id"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), title.alias("title"), uris.alias("uris"), F.sha2(F.concat_ws("\0", id_, title), 256).alias("source_hash"))
    p, c = node_id("project", "project_id"), node_id("conversation", "conversation_id")
    r = lambda i: F.concat_ws(":", "kind", safe_id("project_id"), safe_id(i))
    nodes = node(projects, p, "project", F.col("title"), none).union(node(conversations, c, "conversation", F.col("title"), none))
    nodes = nodes.union(node(records, r("id"), F.col("kind"), F.col("title"), F.col("evidence"))).union(node(assets, node_id("asset", "id"), "asset", F.col("title"), none))
    cited = records.select("*", F.explode("evidence").alias("u")).withColumn("e", parsed_uri("u")).where("e.kind = 'conversation'")
    used = assets.select("*", F.explode("conversations").alias("c"))
    edges = edges_of(conversations, c, "belongs_to", p).union(edges_of(records, r("id"), "belongs_to", p))
    edges = edges.union(edges_of(records.where("depends_on IS NOT NULL"), r("id"), "depends_on", F.concat_ws(":", F.lit("decision"), safe_id("project_id"), safe_id("depends_on"))))
    edges = edges.union(edges_of(records.where("superseded_by IS NOT NULL"), r("superseded_by"), "supersedes", r("id")))
    edges = edges.union(edges_of(cited, r("id"), "evidenced_by", node_id("conversation", "e.id"), F.col("u"))).union(edges_of(used, node_id("conversation", "c"), "contains", node_id("asset", "id")))
    return nodes.dropDuplicates(["id"]), edges.dropDuplicates(["id"])


def validate(nodes: DataFrame, edges: DataFrame, project: str) -> DataFrame:
    """(code, item) of every broken invariant."""
    out = lambda df, code, c: df.select(F.lit(code).alias("code"), F.col(c).cast("string").alias("item"))
    twice = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("k"), F.max("id").alias("last")).where("k > 1")
    ids = nodes.select("id").distinct()
    issues = out(twice(nodes, "id").select("id"), "duplicate_node_id", "id").union(out(twice(edges, "id").select("id"), "duplicate_edge_id", "id"))
    lost = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").union(edges.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select("from_id", *[c for c in edges.columns if c != "from_id"]))
    issues = issues.union(out(lost.select("id").distinct(), "dangling_edge", "id"))
    same = edges.groupBy("from_id", "relation", "to_id", F.coalesce("uri", F.lit("")).alias("u")).agg(F.count("*").alias("k"), F.max("id").alias("id")).where("k > 1")
    issues = issues.union(out(same, "duplicate_edge", "id"))
    root = nodes.where((F.col("kind") == "project") & (F.col("id") == node_id("project", F.lit(project)))).agg(F.count("*").alias("k"))
    issues = issues.union(root.where("k = 0").select(F.lit("project_root_missing"), F.lit(project))).union(root.where("k > 1").select(F.lit("project_root_duplicate"), F.lit(project)))
    issues = issues.union(out(nodes.where("source_hash IS NULL OR trim(source_hash) = ''"), "missing_source_hash", "id"))
    link = edges.where("relation = 'belongs_to'").where(F.col("to_id") == node_id("project", F.lit(project))).groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("k"))
    talks = nodes.where("kind = 'conversation'").select("id").join(link, "id", "left")
    issues = issues.union(out(talks.where("k IS NULL"), "conversation_project_link_missing", "id")).union(out(talks.where("k > 1"), "conversation_project_link_duplicate", "id"))
    cited = nodes.select("id", F.explode("uris").alias("u")).withColumn("e", parsed_uri("u"))
    issues = issues.union(out(cited.where("e IS NULL"), "invalid_evidence_uri", "u"))
    talk = cited.where("e.kind = 'conversation'").withColumn("to", node_id("conversation", "e.id")).join(ids.withColumnRenamed("id", "to"), "to", "left_anti")
    thing = cited.where("e.kind = 'content'").withColumn("to", node_id("content", F.lit(project), "e.id")).join(ids.withColumnRenamed("id", "to"), "to", "left_anti")
    return issues.union(out(talk, "missing_evidence_conversation", "u")).union(out(thing, "missing_evidence_content", "u"))


def connections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, direction, relation, other, title): every node's edges, both ways."""
    title = nodes.select(F.col("id").alias("other"), "title")
    rows = edges.select(F.col("from_id").alias("id"), F.lit("out").alias("direction"), "relation", F.col("to_id").alias("other")).union(edges.select("to_id", F.lit("in"), "relation", "from_id"))
    return rows.join(title, "other").select("id", "direction", "relation", "other", "title")


def paths(nodes: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(id, path) of notes: a node keeps the path it had; names that clash get a number by id order."""
    from pyspark.sql import Window

    from palimpsest.functions.text import safe_filename

    name = F.concat(F.col("kind"), F.lit("/"), safe_filename("title"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    rows = nodes.select("id", name.alias("name")).withColumn("rank", rank)
    rows = rows.select("id", F.concat("name", F.when(F.col("rank") > 1, F.concat(F.lit(" "), F.col("rank").cast("string"))).otherwise(""), F.lit(".md")).alias("fresh"))
    if previous is None:
        return rows.select("id", F.col("fresh").alias("path"))
    return rows.join(previous.select("id", F.col("path").alias("old")), "id", "left").select("id", F.coalesce("old", "fresh").alias("path"))


def vault_issues(notes: DataFrame) -> DataFrame:
    """(code, item) of notes (path, body): paths that stand twice, links to no note."""
    from palimpsest.functions.text import wiki_links

    twice = notes.groupBy("path").count().where("count > 1").select(F.lit("duplicate_path").alias("code"), F.col("path").alias("item"))
    target = notes.select(F.explode(wiki_links("body")).alias("target"))
    have = notes.select(F.regexp_replace("path", r"\.md$", "").alias("target")).distinct()
    return twice.union(target.join(have, "target", "left_anti").distinct().select(F.lit("broken_link"), "target"))


def markdown(messages: DataFrame, key: str, order: str) -> DataFrame:
    """One Markdown text of each conversation (role, text), sections in order; sections are joined where they are sorted, one conversation a row."""
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text"))
    return messages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part.alias("part")))), lambda x: x["part"]), "\n\n").alias("markdown"))
