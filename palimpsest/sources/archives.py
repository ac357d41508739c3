"""Archives, JSON lines, bundles and network bodies as sources and sinks."""

from __future__ import annotations

import io
import json
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.canonical import cut

# Names of the conversation files of an official export, and the bounds of an archive.
EXPORT = r"(^|/)(shared_)?conversations(-\d+)?\.json$"
MAX_ENTRY, MAX_ARCHIVE = 64 << 20, 512 << 20
TABLES = ("conversations", "messages", "evidence", "projects", "states", "content_objects", "content_versions", "content_relations", "content_operations", "content_promotions")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, fingerprint (SHA-256) and content of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("fingerprint"), "content")


def entries(archives: DataFrame, max_entry: int = MAX_ENTRY, max_archive: int = MAX_ARCHIVE) -> DataFrame:
    """path, fingerprint, name, size, crc, payload, error of every entry of ZIP files; other files are one entry.

    Entries stream one at a time; unsafe names, oversized or damaged entries give an error row and no payload.
    """
    schema = "path string, fingerprint string, name string, size long, crc long, payload binary, error string"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def row(path, print_, name, size, crc, payload, error):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, print_, name, size, crc, payload, error), types, strict=True)], names)

    def run(batches):
        for batch in batches:
            for path, print_, content in zip(*(batch.column(c) for c in ("path", "fingerprint", "content")), strict=True):
                path, print_, content = path.as_py(), print_.as_py(), content.as_py()  # one archive at a time
                if not content.startswith(b"PK"):
                    yield row(path, print_, path.rsplit("/", 1)[-1], len(content), zlib.crc32(content), content, None)
                    continue
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile as e:
                    yield row(path, print_, None, None, None, None, str(e))
                    continue
                total = 0
                for info in archive.infolist():
                    total += info.file_size
                    if info.is_dir():
                        continue
                    parts = info.filename.replace("\\", "/").split("/")
                    if ".." in parts or parts[0] == "" or ":" in parts[0]:
                        error = "unsafe name"
                    elif info.file_size > max_entry or total > max_archive:
                        error = "too large"
                    else:
                        try:
                            payload = archive.read(info)  # compares the CRC
                            yield row(path, print_, info.filename, info.file_size, info.CRC, payload, None)
                            continue
                        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as e:
                            error = str(e)
                    yield row(path, print_, info.filename, info.file_size, info.CRC, None, error)

    return archives.mapInArrow(run, schema)


def packed(rows: DataFrame, archive: str, name: str, payload: str) -> DataFrame:
    """(path, fingerprint, content): a stored ZIP of each archive's entries, in order of name; an archive has at most MAX_ARCHIVE bytes, as for reading.

    Entries stream, sorted, through the task that writes their archive.
    """
    schema = "path string, content binary"

    def run(batches):
        now, buffer, out = None, None, []

        def close():
            writer.close()
            out.append((now, buffer.getvalue()))

        for batch in batches:
            for key, entry, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if buffer is not None:
                        close()
                    now, buffer = key, io.BytesIO()
                    writer = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                if buffer.tell() > MAX_ARCHIVE:
                    raise ValueError(f"archive {key} is larger than {MAX_ARCHIVE} bytes")
                writer.writestr(zipfile.ZipInfo(entry), body or b"")
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["path", "content"])
            out.clear()
        if buffer is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["path", "content"])

    keyed = rows.select(F.col(archive).cast("string").alias("path"), F.col(name).alias("name"), F.col(payload).cast("binary").alias("payload"))
    return keyed.repartition("path").sortWithinPartitions("path", "name").mapInArrow(run, schema).select("path", F.sha2("content", 256).alias("fingerprint"), "content")


def conversations(found: DataFrame) -> DataFrame:
    """fingerprint, name, raw (JSON) of every raw conversation in entries: own archives' raw.json and official exports; bad ones are skipped."""
    text = F.decode("payload", "UTF-8")
    good = found.where("error IS NULL AND payload IS NOT NULL").where(F.col("name").rlike(EXPORT) | F.col("name").rlike(r"(^|/)raw\.json$")).select("fingerprint", "name", text.alias("text"))
    listed = F.coalesce(F.from_json("text", "array<string>"), F.from_json(F.get_json_object("text", "$.conversations"), "array<string>"))
    export = good.where(F.col("name").rlike(EXPORT)).select("fingerprint", "name", F.explode(listed).alias("raw"))
    own = good.where(~F.col("name").rlike(EXPORT)).select("fingerprint", "name", F.col("text").alias("raw"))
    return export.union(own).where(F.get_json_object("raw", "$.mapping").isNotNull() & F.coalesce(F.get_json_object("raw", "$.id"), F.get_json_object("raw", "$.conversation_id")).isNotNull())


def own_candidates(found: DataFrame) -> DataFrame:
    """Directories of own archives that hold canonical.json, with their raw.json and source metadata."""
    folder = F.regexp_replace("name", r"[^/]+$", "")
    text = F.decode("payload", "UTF-8")
    part = lambda file: found.where(F.col("name").endswith(file) & F.col("error").isNull()).select("fingerprint", folder.alias("folder"), text.alias(file.split(".")[0].replace("-", "_")))
    return part("canonical.json").where(F.get_json_object("canonical", "$.conversationId").isNotNull()).join(part("raw.json"), ["fingerprint", "folder"]).join(part("source-metadata.json"), ["fingerprint", "folder"], "left")


def json_lines(spark: SparkSession, path: str, schema: str, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON lines: rows (file, line, and the columns), and (file, line, reason, text) of the lines that are refused.  Lines count from 1; blank ones are skipped.

    Spark reads a file in blocks; a line's number is its place in its block after
    the lines of the blocks in front, which are counted in a first pass.  With
    ``parts`` a folder below the path is one file, its parts in the order of their names.
    """
    part = F.col("_metadata.file_path")
    read = spark.read.option("recursiveFileLookup", "true" if parts else "false").text(path)
    lines = read.select("value", (F.regexp_replace(part, "/[^/]*$", "") if parts else part).alias("file"), part.alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "part", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a block
    placed = lines.join(F.broadcast(cut(blocks.select("part", "block", "first", before.alias("before")))), ["part", "block"])  # a row a block: the lines stay where they are read
    placed = placed.select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value").where(F.trim("value") != "")
    parsed = placed.withColumn("v", F.try_parse_json("value")).withColumn("row", F.from_json("value", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    kind = F.schema_of_variant("v")
    reason = F.when(F.col("v").isNull(), "not JSON").when(~kind.startswith("OBJECT"), "not an object").when(F.col("row._corrupt_record").isNotNull(), "does not fit the schema")
    parsed = parsed.withColumn("reason", reason)
    return parsed.where("reason IS NULL").select("file", "line", "row.*").drop("_corrupt_record"), parsed.where("reason IS NOT NULL").select("file", "line", "reason", F.col("value").alias("text"))


def rejected(found: DataFrame) -> DataFrame:
    """(path, name, position, reason) of what an import of entries leaves out: unreadable entries, files that are no JSON, items that are no conversations.

    With ``conversations`` it splits the items of all conversation files; position is the item's place in its file, null for a whole entry.
    """
    text = F.decode("payload", "UTF-8")
    whole = found.where("error IS NOT NULL").select("path", "name", F.lit(None).cast("int").alias("position"), F.col("error").alias("reason"))
    good = found.where("error IS NULL AND payload IS NOT NULL").where(F.col("name").rlike(EXPORT) | F.col("name").rlike(r"(^|/)raw\.json$")).select("path", "name", text.alias("text"), F.try_parse_json(text).alias("v"))
    export = good.where(F.col("name").rlike(EXPORT))
    listed = F.coalesce(F.from_json("text", "array<string>"), F.from_json(F.get_json_object("text", "$.conversations"), "array<string>"))
    broken = good.where("v IS NULL").select("path", "name", F.lit(None).cast("int"), F.lit("not JSON"))
    no_list = export.where(F.col("v").isNotNull() & listed.isNull()).select("path", "name", F.lit(None).cast("int"), F.lit("no list of conversations"))
    item = export.where("v IS NOT NULL").select("path", "name", F.posexplode(listed).alias("position", "raw"))
    item = item.union(good.where(F.col("v").isNotNull() & ~F.col("name").rlike(EXPORT)).select("path", "name", F.lit(0), "text"))
    reason = F.when(F.get_json_object("raw", "$.mapping").isNull(), "no mapping").when(F.coalesce(F.get_json_object("raw", "$.id"), F.get_json_object("raw", "$.conversation_id")).isNull(), "no id")
    return whole.union(broken).union(no_list).union(item.select("path", "name", "position", reason.alias("reason")).where("reason IS NOT NULL"))


#: Tables that belong to rows of another: (column, table, its key); a row stays if all of them do.
OWNERS = {
    "messages": [("conversation_id", "conversations", "conversation_id")], "evidence": [("conversation_id", "conversations", "conversation_id")], "content_versions": [("object_id", "content_objects", "id")],
    "content_relations": [("from_id", "content_objects", "id"), ("to_id", "content_objects", "id")], "content_operations": [("object_id", "content_objects", "id")], "content_promotions": [("source_id", "content_objects", "id")],
}


def scoped(tables: dict[str, DataFrame], project: str | None) -> dict[str, DataFrame]:
    """The tables of one project: its own rows, and by semi-joins what belongs to them; tables that know neither stay whole."""
    if project is None:
        return dict(tables)
    out = {name: df.where(F.col("project_id") == project) if "project_id" in df.columns and name not in OWNERS else df for name, df in tables.items()}
    for name, owners in OWNERS.items():
        for column, owner, key in owners:
            if name in out and owner in out and column in out[name].columns and key in out[owner].columns:
                out[name] = out[name].join(out[owner].select(F.col(key).alias(column)), column, "left_semi").select(tables[name].columns)
    return out


def write_bundle(tables: dict[str, DataFrame], path: str, project: str | None = None) -> None:
    """A bundle: one JSON-lines folder a table, rows of the project in order, and a manifest with rows and a fingerprint of each table."""
    from palimpsest.operators.objects import fingerprint

    found = scoped(tables, project)
    marks = None
    for name, rows in found.items():
        rows.orderBy(*rows.columns).write.mode("overwrite").json(f"{path}/{name}")
        mark = fingerprint(rows, *rows.columns).crossJoin(rows.agg(F.count("*").alias("rows"))).withColumn("table", F.lit(name))  # one row each
        marks = mark if marks is None else marks.union(mark)
    manifest = marks.select(F.lit("agent-bundle").alias("format"), F.lit(3).alias("version"), F.lit(project).cast("string").alias("project_id"), "table", "rows", "fingerprint")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")  # a row a table


def read_bundle(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a bundle of version 1 to 3; absent ones are empty."""
    manifest = spark.read.schema("format string, version int").json(f"{path}/manifest").first()
    if manifest is None or manifest["format"] != "agent-bundle" or manifest["version"] not in (1, 2, 3):
        raise ValueError("not a bundle of a known version")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for name, schema in schemas.items():
        there = system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        out[name] = spark.read.schema(schema).json(f"{path}/{name}") if there else spark.createDataFrame([], schema)
    return out


def first_list(body: Column) -> Column:
    """The items of a list response, at the first of the known places."""
    return F.coalesce(*(F.try_variant_get(body, p, "array<variant>") for p in ("$", "$.items", "$.conversations", "$.data", "$.results", "$.list", "$.data.items")))


def first_total(body: Column) -> Column:
    return F.coalesce(*(F.try_variant_get(body, p, "bigint") for p in ("$.total", "$.count", "$.total_count", "$.data.total")))


def stream_events(bodies: DataFrame, column: str = "body") -> DataFrame:
    """(ordinal, event): JSON values of network bodies: a whole body, or its ``data:`` and prefixed lines."""
    lines = bodies.select("*", F.posexplode(F.split(column, "\r?\n")).alias("line_no", "line"))
    text = F.regexp_replace(F.trim("line"), r"^(data:|\d+:)\s*", "")
    whole = bodies.withColumn("event", F.try_parse_json(column)).where("event IS NOT NULL").withColumn("ordinal", F.lit(0))
    parts = lines.where(F.try_parse_json(column).isNull()).withColumn("event", F.try_parse_json(text)).where("event IS NOT NULL").withColumn("ordinal", F.col("line_no")).drop("line_no", "line")
    return whole.unionByName(parts)


def graph_objects(bodies: DataFrame, column: str = "body", depth: int = 6) -> DataFrame:
    """(id, raw): objects with a mapping anywhere in JSON bodies, strings parsed again; the largest of each id."""

    def run(batches):
        def walk(value, left):
            if left < 0:
                return
            if isinstance(value, str) and value[:1] in "{[":
                try:
                    value = json.loads(value)
                except ValueError:
                    return
            if isinstance(value, dict):
                if isinstance(value.get("mapping"), dict):
                    yield value
                for v in value.values():
                    yield from walk(v, left - 1)
            elif isinstance(value, list):
                for v in value:
                    yield from walk(v, left - 1)

        for batch in batches:
            found = [(str(o.get("id") or o.get("conversation_id") or ""), json.dumps(o, ensure_ascii=False)) for b in batch.column(0).to_pylist() for o in walk(b, depth)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["id", "raw"])

    rows = bodies.select(column).mapInArrow(run, "id string, raw string")
    return rows.groupBy("id").agg(F.max_by("raw", F.length("raw")).alias("raw"))


def reassembled(chunks: DataFrame, key: str, order: str, data: str, size: str) -> DataFrame:
    """(key, payload, ok) of base64 chunks in order; ok if the length is the one told."""
    joined = F.unbase64(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, data))), lambda x: x[data]), ""))
    return chunks.groupBy(key).agg(joined.alias("payload"), F.max(size).alias("size")).select(key, "payload", (F.octet_length("payload") == F.col("size")).alias("ok"))
