"""A paged change feed as a streaming source whose offset is the cursor.

The offset of a subject is the token of the page to read next, so the stream's checkpoint is the cursor: a stopped query
goes on with the page after the last committed one, and a batch that was cut off is read again, page by page. The driver follows tokens
only, a bounded number of pages a batch; executors fetch the pages' changes, a partition for each page, and hold a bounded number of them at once.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tallyline.sources.listings import CHANGE_SCHEMA, MAX_CHANGE_PAGES

#: (subject, token) -> page: ``changes`` (change records, a list or read as they are asked for), ``nextPageToken`` or, on the last page, ``newStartPageToken``.
Fetch = Callable[[str, str], Mapping[str, Any]]
#: Changes of a page that a task holds at once.
BATCH_ROWS = 4096


class FeedError(RuntimeError):
    """A feed that can't be followed to its end: it proves nothing, so its cursor doesn't move."""


class _Page(InputPartition):
    def __init__(self, subject: str, token: str):
        super().__init__((subject, token))
        self.subject, self.token = subject, token


class FeedReader(DataSourceStreamReader):
    """Reads from ``start`` (subject -> token), at most ``pages`` pages of a subject in a batch."""

    def __init__(self, fetch: Fetch, start: Mapping[str, str], schema: StructType, pages: int, tokens: Fetch | None = None):
        self.fetch, self.start, self.schema, self.pages = fetch, dict(start), schema, pages
        self.tokens = tokens or fetch
        self.at: dict[str, str] | None = None
        self.following: dict[tuple[str, str], tuple[str, bool, bool]] = {}

    def initialOffset(self) -> dict:
        return dict(self.start)

    def _next(self, subject: str, token: str) -> tuple[str, bool, bool]:
        """The token after a page, whether more pages follow now, and whether the page has changes."""
        if (subject, token) not in self.following:
            page = self.tokens(subject, token)
            more = page.get("nextPageToken")
            after = more or page.get("newStartPageToken")
            if not after:
                raise FeedError(f"{subject}: page {token} has neither a next nor a new start token")
            if more == token:
                raise FeedError(f"{subject}: page {token} names itself as the next")
            found = (after, bool(more), bool(page.get("changes")))
            if not more:
                return found  # the last page of a live feed may grow
            self.following[subject, token] = found
        return self.following[subject, token]

    def _walk(self, subject: str, token: str, end: str | None = None) -> list[tuple[str, str]]:
        """(token, token after it) of the pages from a token: up to ``end``, or as many as a batch takes."""
        out: list[tuple[str, str]] = []
        met = {token}
        while token != end and (end is not None or len(out) < self.pages):
            after, more, full = self._next(subject, token)
            if not more and not full and end is None:
                break  # nothing new
            if after in met and after != end:
                raise FeedError(f"{subject}: token {after} repeats")
            met.add(after)
            out.append((token, after))
            token = after
            if not more:
                break
        return out

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = dict(self.start)
        for subject, token in list(self.at.items()):
            if walked := self._walk(subject, token):
                self.at[subject] = walked[-1][1]
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = dict(end)  # after a restart the offsets of the checkpoint come first
        return [_Page(s, token) for s in sorted(end) for token, _ in self._walk(s, start.get(s, self.start.get(s, "")), end[s])]

    def read(self, partition: _Page) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        changes = iter(self.fetch(partition.subject, partition.token).get("changes") or ())
        while rows := [{"subject": partition.subject, **c} for c in itertools.islice(changes, BATCH_ROWS)]:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def commit(self, end: dict) -> None:
        """The checkpoint has the offset; what was walked up to it isn't needed again."""
        self.following.clear()


def change_feed(fetch: Fetch, start: Mapping[str, str], pages: int = MAX_CHANGE_PAGES, name: str = "change_feed", tokens: Fetch | None = None) -> type[DataSource]:
    """A data source to register (``spark.dataSource.register``) and stream from: (subject, change fields).

    ``fetch`` reads a page on executors; the driver asks ``tokens`` for the page without its changes (``changes``: how many, or any true value if
    there are some), or ``fetch`` where none is given. ``start`` has the cursors of new checkpoints. A checkpoint's own offset goes before ``start``.
    """

    class ChangeFeed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"subject string, {CHANGE_SCHEMA}"

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return FeedReader(fetch, start, schema, pages, tokens)

    return ChangeFeed


def _lines(uri: str, folder: str) -> Iterator[dict]:
    """The records of a folder's JSON lines, on any file system that Arrow opens; read as they are asked for."""
    import io

    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(uri)
    found = files.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True))
    for path in sorted(f.path for f in found if f.is_file and f.base_name.startswith("part-")):
        with files.open_input_stream(path) as f:
            yield from map(json.loads, io.TextIOWrapper(f, encoding="utf-8", newline="\n"))


def stored_pages(uri: str) -> Fetch:
    """Changes of pages stored as JSON lines under ``uri/subject=<subject>/token=<token>/``."""
    return lambda subject, token: {"changes": _lines(uri, f"subject={subject}/token={token}")}


def stored_tokens(uri: str) -> Fetch:
    """Pages without their changes, stored as JSON lines (token, nextPageToken or newStartPageToken, changes: how many) under ``uri/subject=<subject>/``."""
    known: dict[tuple[str, str], dict] = {}

    def tokens(subject: str, token: str) -> Mapping[str, Any]:
        if not known.get((subject, token), {}).get("nextPageToken"):  # not read yet, or the last page, which may grow
            known.update({(subject, r["token"]): r for r in _lines(uri, f"subject={subject}")})
        return known.get((subject, token)) or {"changes": 0, "newStartPageToken": token}  # not written yet: the end of the feed for now

    return tokens
