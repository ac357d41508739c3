"""WARC archives: writing with segments and revisits, and reassembly of what is read.

Writing: a page is an HTTP response in chunked transfer framing.  Of pages with equal
payloads of at least ``dedup_bytes`` the one with the largest id is written in
full and the others as revisits of it.  A block longer than ``segment_bytes`` is cut:
its first part keeps the record's type, the rest are continuation records that
name the origin and their segment number; the last gives the total length.

Reading: archives of bounded size are parsed file by file; only records in
segments are shuffled, by origin, sorted by segment number and put together one record
at a time; total length and payload digest are verified and the chunked framing decoded.

Defined cases: a null payload is empty; a null id is written as ``null`` and read
back as null, and never is the record others refer to; rows equal in id and
payload share one type; a record with missing or repeated segments, a wrong length, bad
framing or a wrong digest is returned with that ``status`` instead of ``complete``.
Archives may be plain, or compressed as a whole or record by record; of a damaged
one every record that is whole is read, and a row of the kind ``archive`` tells each
gap, or that a file is too large to be read.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 16 << 10, 8 << 10, 1500
#: Bytes of an archive that a task reads whole (a row holds 2 GB at most), and of what is inflated at a time.
MAX_ARCHIVE, PIECE = 1 << 30, 1 << 16
#: Tasks over which the pages of one payload spread.
SLOTS = 64
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def cuts(data: bytes, size: int):
    """Parts of about ``size`` bytes that end between characters."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80 and end > start + 1:
            end -= 1
        yield data[start:end]
        start = end


def framed(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in cuts(payload, size)) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out) if body[end + 2 :].endswith(b"\r\n") else None
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return None


def record(kind: str, name: str, block: bytes, **more) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in more.items() if v is not None)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: {DATE}\r\n{head}Content-Length: {len(block)}\r\n\r\n{block.decode()}\r\n\r"


def records(page_id, url, payload: bytes, digest: str, refers_to, tag: int, segment_bytes: int):
    """Texts of a page's records, each without the last line end, which the text sink adds."""
    name = f"urn:page:{'null' if page_id is None else page_id}:{tag}"
    shared = {"WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A") or None, "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is not None:
        yield record("revisit", name, HTTP, **shared, **{"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Type": "application/http;msgtype=response"})
        return
    block = HTTP + framed(payload)
    parts = [*cuts(block, segment_bytes)]
    for n, part in enumerate(parts, 1):
        segment = {"WARC-Segment-Number": n if len(parts) > 1 else None, "WARC-Segment-Total-Length": len(block) if n == len(parts) > 1 else None}
        if n == 1:
            yield record("response", name, part, **shared, **segment, **{"Content-Type": "application/http;msgtype=response"})
        else:
            yield record("continuation", f"{name}:{n}", part, **segment, **{"WARC-Segment-Origin-ID": f"<{name}>"})


def write(pages: DataFrame, path: str, dedup_bytes: int = 1000, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives (gzip) of all pages below ``path``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("n"))
    top = rows.where(f"n >= {dedup_bytes}").groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("k")).where("k > 1 AND top IS NOT NULL").select("digest", "top")
    # pages of one payload spread over slots, each of which asks once for the response
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("page_id", "url"), F.lit(SLOTS)))
    asked = rows.where(f"n >= {dedup_bytes}").select("digest", "slot").distinct().join(top, "digest")
    rows = rows.join(asked, ["digest", "slot"], "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")))
    rows = rows.select("page_id", "url", "html", "digest", "refers_to", F.monotonically_increasing_id().alias("tag"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += records(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"], r["tag"], segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    tk.tune(pages.sparkSession, 200)
    rows.mapInArrow(tk.tidy(run), "value string").write.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def members(data: bytes):
    """(bytes, whole) of each gzip member of a file; a file that is not compressed is one.

    Of a member that is cut or damaged come the bytes in front of the fault; reading
    goes on at the next member.  Bytes between members are a member that is not whole.
    """
    if not data.startswith(b"\x1f\x8b"):
        yield data, True
        return
    view, at = memoryview(data), 0
    while at < len(data):
        out, inflate, end, lost = [], zlib.decompressobj(31), at, data[at : at + 2] != b"\x1f\x8b"
        try:
            while not lost and not inflate.eof and end < len(data):
                out.append(inflate.decompress(view[end : end + PIECE]))
                end = min(end + PIECE, len(data)) - len(inflate.unused_data)
        except zlib.error:
            lost = True
        if inflate.eof and not lost:
            yield b"".join(out), True
            at = end
            continue
        # the next member starts where one can be read from
        at = data.find(b"\x1f\x8b\x08", at + 1)
        while at >= 0 and not readable(view[at : at + PIECE]):
            at = data.find(b"\x1f\x8b\x08", at + 1)
        yield b"".join(out), False
        if at < 0:
            return


def readable(start: memoryview) -> bool:
    """Whether the bytes begin a gzip member with a record."""
    try:
        return zlib.decompressobj(31).decompress(start, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def parse(data: bytes):
    """(headers, block) of every record of an archive; the block of one that is cut short is None, and so are headers and block of bytes between records."""
    at = told = 0  # the bytes in front of ``told`` belong to a record that was given
    while at < len(data):
        end = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
        if end < 0:
            after = data.find(b"\r\n\r\nWARC/", at)
            if at >= told and data[at : after if after >= 0 else len(data)].strip():
                yield None, None
            if after < 0:
                return
            at = after + 4
            continue
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = head.get("content-length", "")
        size = int(length) if length.isdecimal() else len(data)
        block = data[end + 4 : end + 4 + size]
        whole = len(block) == size
        yield head, block if whole else None
        at, told = (end + 4 + size + 4, 0) if whole else (end + 4, end + 5)


def settled(head_digest: str | None, block: bytes, total: int | None, whole: bool) -> tuple[int | None, str | None, str]:
    """Payload bytes, its digest and the status of a record put together."""
    if not whole:
        return None, None, "missing or repeated segment"
    if total is not None and total != len(block):
        return None, None, "wrong total length"
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unframed(body) if b"transfer-encoding: chunked" in head.lower() else body
    if payload is None:
        return None, None, "bad framing"
    digest = hashlib.sha1(payload).hexdigest()
    return len(payload), digest, "complete" if head_digest in (None, digest) else "wrong digest"


FIELDS = "origin string, kind string, segment long, total long, page_id long, refers_to long, digest string, payload_bytes long, status string, block binary"
NAMES = [c.split()[0] for c in FIELDS.split(", ")]
TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in FIELDS.split(", ")]


def page_of(name: str | None) -> int | None:
    part = (name or "").strip("<>").split(":")
    return int(part[2]) if len(part) > 2 and part[2] != "null" else None


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(NAMES, TYPES, strict=True)], NAMES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, whole: origin, kind, page_id, refers_to, digest, payload_bytes, status."""

    def rows(content: bytes):
        for data, intact in members(content):
            for head, block in parse(data):
                if head is None:
                    yield {"kind": "archive", "status": "damaged"}
                    continue
                kind, name = head.get("warc-type", "unknown"), head.get("warc-record-id", "").strip("<>")
                digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                segment, total = (int(head[k]) if head.get(k, "").isdecimal() else None for k in ("warc-segment-number", "warc-segment-total-length"))
                row = {"origin": head.get("warc-segment-origin-id", name).strip("<>"), "kind": kind, "segment": segment, "total": total, "digest": digest}
                row |= {"page_id": page_of(row["origin"]), "refers_to": page_of(head.get("warc-refers-to"))}
                if block is None:
                    row["status"] = "cut short"
                    if segment is not None:  # its origin misses a segment
                        row |= {"segment": 0, "block": b""}
                elif segment is not None:
                    row["block"] = block
                elif kind == "revisit":
                    row["status"] = "complete"
                else:
                    row["payload_bytes"], row["digest"], row["status"] = settled(digest, block, None, True)
                yield row
            if not intact:
                yield {"kind": "archive", "status": "damaged"}

    def files(batches):
        for batch in batches:
            for content in batch.column("content"):
                every = rows(content.as_py())
                while found := [*islice(every, 200)]:
                    yield batch_of(found)

    def joined(batches):
        open_rows: list[dict] = []

        def close():
            first = open_rows[0]
            whole = [r["segment"] for r in open_rows] == [*range(1, len(open_rows) + 1)] and open_rows[-1]["total"] is not None and first["kind"] != "continuation"
            size, digest, status = settled(first["digest"], b"".join(r["block"] for r in open_rows), open_rows[-1]["total"], whole)
            return {**first, "block": None, "payload_bytes": size, "digest": digest, "status": status, "segment": len(open_rows)}

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if open_rows and open_rows[0]["origin"] != row["origin"]:
                    done.append(close())
                    open_rows = []
                open_rows.append(row)
            yield batch_of(done)
        if open_rows:
            yield batch_of([close()])

    tk.tune(spark, 1)  # a file of at most FILE_RECORDS segments at a time
    archives = spark.read.format("binaryFile").load(path)
    large = archives.where(F.col("length") > MAX_ARCHIVE).select(*(F.lit({"kind": "archive", "status": "too large"}.get(c)).cast(t).alias(c) for c, t in zip(NAMES, (f.split()[1] for f in FIELDS.split(", ")), strict=True)))
    parsed = tk.stored(archives.where(F.col("length") <= MAX_ARCHIVE).select("content").mapInArrow(tk.tidy(files), FIELDS).union(large))
    tk.tune(spark, 200)
    single = parsed.where("segment IS NULL")
    parts = parsed.where("segment IS NOT NULL").repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(tk.tidy(joined), FIELDS)
    return single.union(parts).drop("block", "total")


def summary(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, status; a revisit takes its size from the response it names."""
    full = found.where("kind = 'response'")
    sizes = full.groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("payload_bytes").alias("size"))
    seen = found.where("kind = 'revisit'").join(sizes, ["refers_to", "digest"], "left").withColumn("status", F.when(F.col("size").isNull(), "response not found").otherwise(F.col("status")))
    cols = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "status"]
    return full.select(*cols).union(seen.withColumn("payload_bytes", F.col("size")).select(*cols))


def roundtrip(pages: DataFrame) -> DataFrame:
    path = tk.workdir(pages.sparkSession)
    write(pages, path)
    return summary(read(pages.sparkSession, path))
