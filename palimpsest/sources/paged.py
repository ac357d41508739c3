"""A paged source: offset pages read in parallel by a fetch function that the user names as ``module:function``.

``fetch(offset, limit)`` returns ``(items, total)``, items as JSON-ready values;
with the option ``at``, its value goes in front of the arguments.  Read as a
stream, the source keeps its place in the query's checkpoint.
Transient failures are tried again with growing waits; a task retry reads its pages again.
A read has at most ``tasks`` tasks (256), however many pages there are: each asks for several, one after the other.
"""

from __future__ import annotations

import importlib
import json
import time
from functools import partial

from pyarrow import fs

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

RETRIES = (408, 409, 429)


def fetched(fetch, offset: int, limit: int, attempts: int = 4, pause: float = 0.5):
    for attempt in range(attempts):
        try:
            return fetch(offset, limit)
        except Exception as error:
            status = getattr(error, "status", None)
            if attempt + 1 == attempts or not (status is None or status in RETRIES or status >= 500):
                raise
            time.sleep(min(15.0, getattr(error, "retry_after", None) or pause * 2**attempt))


def stored(at: str, number: int) -> tuple[fs.FileSystem, str] | None:
    """Where a page of a stored response is, ``page-00000.jsonl`` and on below ``at``; None behind the last."""
    system, root = fs.FileSystem.from_uri(at) if "://" in at or at.startswith("file:") else (fs.LocalFileSystem(), at)
    path = f"{root}/page-{number:05}.jsonl"
    return None if system.get_file_info(path).type == fs.FileType.NotFound else (system, path)


def stored_page(at: str, number: int) -> list | None:
    """Items of a page of a stored response; None behind the last."""
    if (found := stored(at, number)) is None:
        return None
    with found[0].open_input_stream(found[1]) as stream:
        return [json.loads(line) for line in stream.read().decode().split("\n") if line]


#: The last page that this process has seen of a stored response: the next request looks on from there.
SEEN: dict[str, int] = {}


def last_page(at: str) -> int:
    """The number of the last page, found without reading one."""
    low, step = SEEN.get(at, 0), 1
    if low and stored(at, low) is None:  # pages were taken away
        low = 0
    while stored(at, low + step) is not None:
        low, step = low + step, 2 * step
    high = low + step
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if stored(at, middle) is not None else (low, middle)
    SEEN[at] = low
    return low


def stored_offsets(at: str, offset: int, limit: int):
    """Offset pages of stored responses, all but the last of one size."""
    low, size = last_page(at), len(stored_page(at, 0) or [])
    total, items = low * size + (len(stored_page(at, low) or []) if low else size), []
    while len(items) < limit and offset + len(items) < total:
        number, skip = divmod(offset + len(items), size)
        items += stored_page(at, number)[skip : skip + limit - len(items)]
    return items, total


def stored_cursors(at: str, cursor: str | None, limit: int):
    """Stored responses as cursor pages: the cursor is the number of the next one."""
    number = int(cursor or 0)
    return stored_page(at, number) or [], str(number + 1) if stored(at, number + 1) else None


class Page(InputPartition):
    """Positions from ``offset`` on, ``limit`` of them, that one task asks for in one request or, one after the other, in several."""

    def __init__(self, offset: int, limit: int = 0):
        super().__init__(offset)
        self.offset, self.limit = offset, limit


class PagedReader(DataSourceReader):
    def __init__(self, options):
        module, _, name = options["fetch"].partition(":")
        self.module, self.name, self.limit, self.at = module, name, int(options.get("limit", "100")), options.get("at")
        self.tasks = int(options.get("tasks", "256"))

    def _fetch(self):
        fetch = getattr(importlib.import_module(self.module), self.name)
        return fetch if self.at is None else partial(fetch, self.at)

    def dealt(self, start: int, end: int) -> list[Page]:
        """Positions dealt to at most ``tasks`` tasks, whole requests to each: a task costs more than a request."""
        each = self.limit * max(1, -(-(end - start) // (self.limit * self.tasks)))
        return [Page(at, min(each, end - at)) for at in range(start, end, each)]

    def partitions(self):
        _, total = fetched(self._fetch(), 0, 1)
        return self.dealt(0, max(1, total))

    def read(self, partition):
        for at in range(partition.offset, partition.offset + partition.limit, self.limit):
            items, _ = fetched(self._fetch(), at, self.limit)
            for k, item in enumerate(items):
                yield at + k, json.dumps(item)


class CursorReader(PagedReader):
    """Pages that each name the next one's cursor: ``fetch(cursor, limit)`` returns ``(items, next cursor)``; one task follows them, since no page is known before the one in front of it.

    A cursor that comes again ends the scan with an error: such a source would never end.
    """

    def partitions(self):
        return [Page(0)]

    def read(self, partition):
        cursor, seen, position = None, set(), 0
        while True:
            items, cursor = fetched(self._fetch(), cursor, self.limit)
            for item in items:
                yield position, json.dumps(item)
                position += 1
            if cursor in (None, ""):
                return
            if cursor in seen:
                raise ValueError(f"cursor {cursor!r} came again")
            seen.add(cursor)


class OffsetStream(DataSourceStreamReader):
    """Pages as a stream: offsets are positions, so a restart goes on behind the last committed one; the pages of a micro-batch are read in parallel."""

    def __init__(self, options):
        self.pages, self.told = PagedReader(options), 0

    def initialOffset(self):
        return {"position": 0}

    def latestOffset(self):
        _, total = fetched(self.pages._fetch(), 0, 1)
        self.told = max(self.told, total)  # a source that shrinks takes nothing back
        return {"position": self.told}

    def partitions(self, start, end):
        return self.pages.dealt(start["position"], end["position"])

    def read(self, partition):
        fetch, end = self.pages._fetch(), partition.offset + partition.limit
        for at in range(partition.offset, end, self.pages.limit):
            wanted = min(self.pages.limit, end - at)
            items, _ = fetched(fetch, at, wanted)
            if len(items) < wanted:
                raise ValueError(f"{len(items)} of {wanted} items at {at}")
            for k, item in enumerate(items[:wanted]):
                yield at + k, json.dumps(item)


class CursorStream(SimpleDataSourceStreamReader):
    """Cursor pages as a stream: an offset is a page's cursor and how many of its items are behind it.

    The last page, which names no further one, is asked again: what is new on it goes on behind the items already read.
    A micro-batch follows at most ``pages`` pages (100), as their items pass the driver; the next one goes on behind them.
    """

    def __init__(self, options):
        self.pages, self.most = PagedReader(options), int(options.get("pages", "100"))

    def initialOffset(self):
        return {"cursor": None, "behind": 0, "position": 0}

    def _page(self, start):
        items, following = fetched(self.pages._fetch(), start["cursor"], self.pages.limit)
        fresh, at = items[start["behind"] :], start["position"]
        rows = [(at + k, json.dumps(item)) for k, item in enumerate(fresh)]
        if following in (None, ""):
            return rows, {"cursor": start["cursor"], "behind": len(items), "position": at + len(fresh)}
        if following == start["cursor"]:
            raise ValueError(f"cursor {following!r} came again")
        return rows, {"cursor": following, "behind": 0, "position": at + len(fresh)}

    def read(self, start):
        rows, now = [], start
        for _ in range(self.most):
            found, following = self._page(now)
            rows += found
            ended, now = following["cursor"] == now["cursor"], following
            if ended:
                break
        return iter(rows), now

    def readBetweenOffsets(self, start, end):
        """The same rows again after a failure; the last page may have grown meanwhile, so rows end where the batch ended."""
        now = start
        while now["position"] < end["position"]:
            rows, following = self._page(now)
            yield from rows[: end["position"] - now["position"]]
            if following == now:
                raise ValueError("items that were read are gone")
            now = following


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``, then ``spark.read.format("paged").option("fetch", "module:function").load()``; ``.option("by", "cursor")`` follows cursors."""

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "position long, item string"

    def reader(self, schema):
        return CursorReader(self.options) if self.options.get("by") == "cursor" else PagedReader(self.options)

    def streamReader(self, schema):
        return super().streamReader(schema) if self.options.get("by") == "cursor" else OffsetStream(self.options)  # not implemented: Spark asks for the simple reader

    def simpleStreamReader(self, schema):
        return CursorStream(self.options)
