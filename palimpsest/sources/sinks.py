"""Files as a sink: archives of volumes, trees of notes, packages of record files; written by tasks, seen at once.

Rows (file, name, payload) go to files: entries of a stored ZIP, the text of a
note, or lines of a record file.  Each save writes below a folder of its own.  A
task writes a file under a passing name and moves it to its own when it is whole,
so a task that runs again, or twice at a time, leaves one file.  It lists its
files, with their rows, bytes and SHA-256, in a list of its own.  The commit
writes ``manifest.json``, which names the folder and the tasks' lists; before
that no reader sees anything, and an abort removes the folder.  Nothing that
grows with the files passes the driver.

Tasks reach the path through Arrow's file systems (local and mounted paths, HDFS,
object stores), as Python workers have no other.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zipfile
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .committed import delete

KINDS = ("zip", "text", "lines")
LISTED = "file string, bytes long, rows long, sha256 string"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Counted:
    """A stream that knows the size and hash of what was written to it; it cannot go back, so a ZIP's sizes follow its entries."""

    def __init__(self, stream):
        self.stream, self.size, self.hash = stream, 0, hashlib.sha256()

    def write(self, data) -> int:
        self.stream.write(data)
        self.hash.update(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


@dataclass
class Written(WriterCommitMessage):
    part: str | None
    files: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind, self.folder = options["path"].rstrip("/"), options.get("kind", "text"), f"written-{uuid.uuid4().hex}"
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")

    def write(self, iterator) -> Written:
        system, root = place(self.path)
        task, own, listed = TaskContext.get().partitionId(), uuid.uuid4().hex, []

        def put(file: str, rows) -> None:
            """Write ``rows`` (name, payload) to a passing name, then move them to the file."""
            if file.startswith("/") or ".." in file.split("/"):
                raise ValueError(f"unsafe file name {file!r}")
            name = f"{file}/part-{task:05}.jsonl" if self.kind == "lines" else file
            target, count = f"{root}/{self.folder}/files/{name}", 0
            system.create_dir(target.rpartition("/")[0], recursive=True)
            passing = f"{root}/{self.folder}/_passing-{own}"
            with system.open_output_stream(passing) as stream:
                out = Counted(stream)
                archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) if self.kind == "zip" else None
                for entry, payload in rows:
                    if archive:
                        archive.writestr(zipfile.ZipInfo(entry), payload or b"")
                    else:
                        out.write(payload or b"")
                        if self.kind == "lines":
                            out.write(b"\n")
                    count += 1
                if archive:
                    archive.close()
            system.move(passing, target)
            listed.append({"file": name, "bytes": out.size, "rows": count, "sha256": out.hash.hexdigest()})

        def rows():
            for batch in iterator:
                yield from zip(*(batch.column(c).to_pylist() for c in ("file", "name", "payload")), strict=True)

        every = rows()
        ahead = next(every, None)
        while ahead is not None:
            file = ahead[0]

            def same(file=file):
                nonlocal ahead
                while ahead is not None and ahead[0] == file:
                    yield ahead[1:]
                    ahead = next(every, None)

            put(file, same())
        if not listed:
            return Written(None, 0)
        part = f"{self.folder}/lists/{task:05}.jsonl"
        system.create_dir(f"{root}/{self.folder}/lists", recursive=True)
        with system.open_output_stream(f"{root}/{self.folder}/_passing-{own}") as stream:
            stream.write("".join(json.dumps(x) + "\n" for x in listed).encode())
        system.move(f"{root}/{self.folder}/_passing-{own}", f"{root}/{part}")
        return Written(part, len(listed))

    def commit(self, messages) -> None:
        system, root = place(self.path)
        system.create_dir(root, recursive=True)
        text = json.dumps({"kind": self.kind, "folder": self.folder, "lists": sorted(m.part for m in messages if m and m.part), "files": sum(m.files for m in messages if m)})
        with system.open_output_stream(f"{root}/_{self.folder}.json") as stream:
            stream.write(text.encode())
        system.move(f"{root}/_{self.folder}.json", f"{root}/manifest.json")

    def abort(self, messages) -> None:
        system, root = place(self.path)
        if system.get_file_info(f"{root}/{self.folder}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.folder}")


class FilesSink(DataSource):
    """``spark.dataSource.register(FilesSink)``, then ``rows.write.format("files").option("kind", ...).mode("append").save(path)``: a file's rows in one task, in a row."""

    @classmethod
    def name(cls):
        return "files"

    def schema(self):
        return "file string, name string, payload binary"

    def writer(self, schema, overwrite):
        return FilesWriter(self.options)


def write_files(rows: DataFrame, path: str, kind: str = "text", in_order: bool = False) -> None:
    """Write rows (file, name, payload): a file's rows meet in one task, in the order of their names; lines of a record file stay in their tasks.

    With ``in_order`` the lines of a record file are dealt to tasks by ranges of
    their names, which should differ: its parts, one after the other, have them in
    that order, and no task has more of a large file than its share of all lines.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FilesSink)
    rows = rows.select(F.col("file").cast("string").alias("file"), F.col("name").cast("string").alias("name"), F.col("payload").cast("binary").alias("payload"))
    if kind != "lines":
        rows = rows.repartition("file")
    elif in_order:
        rows = rows.repartitionByRange("file", "name")
    rows = rows.sortWithinPartitions("file", "name")
    rows.write.format("files").option("kind", kind).mode("append").save(path)


def manifest(spark: SparkSession, path: str) -> dict:
    """What the last commit to a path wrote."""
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, rows, sha256, content, ok of what the last commit wrote; ok if the content is there with its size and hash."""
    told = manifest(spark, path)
    if not told["lists"]:
        return spark.createDataFrame([], f"{LISTED}, content binary, ok boolean")
    listed = spark.read.schema(LISTED).json([f"{path}/{p}" for p in told["lists"]])
    root = f"/{told['folder']}/files/"
    name = F.substring_index("path", root, -1)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}{root}").select(name.alias("file"), "content")
    ok = F.coalesce((F.octet_length("content") == F.col("bytes")) & (F.sha2("content", 256) == F.col("sha256")), F.lit(False))
    return listed.join(there, "file", "left").withColumn("ok", ok)


def read_lines(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a package of record files; refused if a file is missing, or is not what was written."""
    bad = [r["file"] for r in read_files(spark, path).where("NOT ok").select("file").limit(5).collect()]
    if bad:
        raise ValueError(f"files that are not as written: {', '.join(bad)}")
    told, out = manifest(spark, path), {}
    listed = {r["table"] for r in spark.read.schema(LISTED).json([f"{path}/{p}" for p in told["lists"]]).select(F.substring_index("file", "/", 1).alias("table")).distinct().collect()} if told["lists"] else set()  # a row a table
    for name, schema in schemas.items():
        out[name] = spark.read.schema(schema).json(f"{path}/{told['folder']}/files/{name}") if name in listed else spark.createDataFrame([], schema)
    return out


def write_package(tables: dict[str, DataFrame], path: str) -> None:
    """A package: record files of JSON lines for each table."""
    rows = None
    for name, df in tables.items():
        line = df.select(F.lit(name).alias("file"), F.lit("").alias("name"), F.to_json(F.struct(*df.columns)).alias("payload"))
        rows = line if rows is None else rows.union(line)
    write_files(rows, path, "lines")


def swept(spark: SparkSession, path: str) -> list[str]:
    """Remove the folders of earlier and of failed saves."""
    told, gone = manifest(spark, path), []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    for f in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where):
        name = f.getPath().getName()
        if name.startswith("written-") and name != told["folder"]:
            delete(spark, f"{path}/{name}")
            gone.append(name)
    return gone
