"""Providers as a dimension: dispatch of raw conversations, address shapes, capabilities, response bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import trimmed

from .canonical import branch


def shape(raw: Column, provider: Column, graph_providers: tuple[str, ...]) -> Column:
    """How a raw conversation is read: as a graph (it has a mapping, or its provider writes graphs), as a list of messages, or not at all."""
    mapping, messages = F.get_json_object(raw, "$.mapping"), F.get_json_object(raw, "$.messages")
    return F.when(provider.isin(*graph_providers) | mapping.isNotNull(), "graph").when(F.ltrim(messages).startswith("["), "messages").otherwise("unknown")


def dispatched(rows: DataFrame, readers: dict, column: str = "raw", provider: str = "provider", graph_providers: tuple[str, ...] = ()) -> DataFrame:
    """The union of what ``readers`` (by shape) make of the raw conversations of their shape."""
    kind = rows.withColumn("shape", shape(F.col(column), F.col(provider), graph_providers))
    out = None
    for name, read in readers.items():
        part = read(kind.where(F.col("shape") == name).drop("shape"))
        out = part if out is None else out.unionByName(part)
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/:]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(rest, "^[^/]*(/.*)$", 1)
    return host, F.when(path == "", "/").otherwise(path)


def is_conversation(url: Column, provider: Column, shapes: list[tuple[str, str | None, str | None]]) -> Column:
    """Whether an address is likely one of a conversation: (provider, host, path pattern) says where they are; either fits.

    A provider without an entry takes every address, a null one none.
    """
    host, path = host_and_path(url)
    fits = F.lit(False)
    for name, at, pattern in shapes:
        test = F.lit(False)
        if at is not None:
            test = test | (host == at)
        if pattern is not None:
            test = test | path.rlike(pattern)
        fits = fits | ((provider == name) & test)
    return F.coalesce(provider.isNotNull() & (fits | ~provider.isin(*{n for n, _, _ in shapes})), F.lit(False))


def conversation_id(url: Column) -> Column:
    """The id in an address .../c/<id>; null without one."""
    return F.nullif(F.regexp_extract(url, r"/c/([^/?#]+)", 1), F.lit(""))


def supports(rows: DataFrame, capabilities: DataFrame, accepted: tuple[str, ...] = ("verified", "experimental", "visible-only")) -> DataFrame:
    """``rows`` (provider, capability) with ``level`` and ``supported`` from a dimension (provider, capability, level); what it lacks is unsupported."""
    out = rows.join(capabilities, ["provider", "capability"], "left").withColumn("level", F.coalesce("level", F.lit("unsupported")))
    return out.withColumn("supported", F.col("level").isin(*accepted))


def first_text(raw: Column, *paths: str) -> Column:
    """The first value that JSON has at one of the paths, trimmed; null if there is none or it is empty."""
    return F.nullif(trimmed(F.coalesce(*(F.get_json_object(raw, p) for p in paths), F.lit(""))), F.lit(""))


def project_metadata(rows: DataFrame, raw: str = "raw", fallback: str = "untitled project") -> DataFrame:
    """(project_id, title, description, workspace_id, n_files, cursor) of project entries that stand bare or in one or two wrappers; entries without an id go."""
    j = F.col(raw)
    at = lambda *names: [f"$.{w}{n}" for n in names for w in ("gizmo.gizmo.", "gizmo.", "")]
    files = F.coalesce(*(F.get_json_object(j, p) for p in at("files")), F.lit("[]"))
    out = rows.select(
        first_text(j, *at("id")).alias("project_id"), F.coalesce(first_text(j, *at("display.name", "name", "display_name")), F.lit(fallback)).alias("title"), F.coalesce(first_text(j, *at("display.description", "description")), F.lit("")).alias("description"),
        first_text(j, *at("workspace_id")).alias("workspace_id"), F.coalesce(F.json_array_length(files), F.lit(0)).cast("long").alias("n_files"), first_text(j, *at("conversations.cursor")).alias("cursor"),
    )
    return out.where("project_id IS NOT NULL")


def conversation_metadata(rows: DataFrame, raw: str = "raw", source: str | None = None, fallback: str = "untitled conversation") -> DataFrame:
    """(id, title, created, updated, archived, location) of list entries; ``source`` names the list they came from, else an archived flag tells.

    location is a struct(type, project_id, project_title, workspace_id, present); entries without an id go.
    """
    j = F.col(raw)
    flag = F.coalesce(F.get_json_object(j, "$.is_archived").try_cast("boolean"), F.lit(False))
    kind = F.lit(source) if source else F.when(flag, "archived").otherwise("regular")
    location = F.struct(kind.alias("type"), first_text(j, "$.gizmo_id", "$.project_id").alias("project_id"), first_text(j, "$.project_title").alias("project_title"), first_text(j, "$.workspace_id").alias("workspace_id"), F.lit(True).alias("present"))
    out = rows.select(
        first_text(j, "$.id", "$.conversation_id", "$.conversationId").alias("id"), F.coalesce(first_text(j, "$.title"), F.lit(fallback)).alias("title"), first_text(j, "$.create_time", "$.created_at", "$.createTime").alias("created"),
        first_text(j, "$.update_time", "$.updated_at", "$.updateTime").alias("updated"), ((kind == "archived") | flag).alias("archived"), location.alias("location"),
    )
    return out.where("id IS NOT NULL")


def body_text(body: Column, encoded: Column) -> Column:
    """The text of a network body that may be base64; null where it does not decode."""
    return F.when(encoded, F.try_to_binary(body, F.lit("base64")).cast("string")).otherwise(body)


def project_files(rows: DataFrame, project: str = "project_id", files: str = "files") -> DataFrame:
    """One row for each file of a JSON array with an id: (project_id, position, file_id, name, mime)."""
    each = rows.select(project, F.posexplode(F.from_json(files, "array<string>")).alias("position", "f"))
    j = F.col("f")
    both = lambda *names: [f"$.{w}{n}" for w in ("file.", "") for n in names]
    out = each.select(project, "position", first_text(j, *both("file_id", "fileId", "id")).alias("file_id"), first_text(j, *both("name", "file_name", "filename")).alias("name"), first_text(j, *both("mime_type", "type")).alias("mime"))
    return out.where("file_id IS NOT NULL")


def signed_asset(rows: DataFrame, raw: str = "raw", name: str | None = None, mime: str | None = None) -> DataFrame:
    """``rows`` with url, file_name, mime_type and size_bytes of a signed download's response; a row without an address has ``error``."""
    j = F.col(raw)
    other = lambda c: F.nullif(trimmed(F.col(c)), F.lit("")) if c else F.lit(None).cast("string")
    url = first_text(j, "$.download_url", "$.downloadUrl", "$.url")
    out = rows.withColumn("url", url).withColumn("file_name", F.coalesce(first_text(j, "$.file_name", "$.filename", "$.name"), other(name))).withColumn("mime_type", F.coalesce(first_text(j, "$.content_type", "$.mime_type", "$.mimeType"), other(mime)))
    return out.withColumn("size_bytes", first_text(j, "$.file_size_bytes", "$.size_bytes", "$.size").try_cast("long")).withColumn("error", F.when(url.isNull(), "no download address"))


def turn_ordinal(x: Column) -> Column:
    """The number of a turn in an element's id such as conversation-turn-12; null without one."""
    return F.regexp_extract(trimmed(x), r"(?i)(?:conversation[-_ ]?turn|turn)[-_: ]?(\d+)(?:$|[^0-9])", 1).try_cast("long")


def raw_trace(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """Trace of raw branches: (conversation_id, message_nodes, root_reached, parent_breaks, cycle); only nodes with a message count as steps."""
    path, trace = branch(nodes, heads)
    with_message = path.join(nodes.where("is_message").select("conversation_id", "node_id"), ["conversation_id", "node_id"]).groupBy("conversation_id").agg(F.count("*").alias("message_nodes"))
    return trace.join(with_message, "conversation_id", "left").withColumn("message_nodes", F.coalesce("message_nodes", F.lit(0)).cast("long")).select("conversation_id", "message_nodes", "root_reached", "parent_breaks", "cycle")
