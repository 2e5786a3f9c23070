"""Venues as Spark data sources: pages that are asked for by cursor, polled as a stream, and batches of books.

``venue_pages`` reads pages as they come.  Its offsets are cursors: of each venue the next cursor to ask for and how many
pages came before it; its partitions are venues, and a task asks for the pages between two offsets.  A query that restarts
goes on at its cursors, so each item comes once.  A cursor that a walk has met before ends it, and more than ``max_pages``
pages are an error, so nothing is lost in silence.

``venue_books`` asks for books in batches of 20 tickers, a partition each.  A batch that does not answer with just the
tickers it was asked for is thrown away, and its tickers are asked for one by one.

Both ask a :class:`Recorded` venue, a folder on any file system that Arrow knows (local, HDFS, S3 and others); one that
asks a server needs the same one method.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Tickers of a request for books.
BATCH = 20
#: The name of the page that is asked for without a cursor.
FIRST = "__first"


class Recorded:
    """Recorded answers below a folder: ``ask("a/b")`` is the JSON that the files of folder or file ``a/b`` hold, or None."""

    def __init__(self, root: str):
        self.files, self.at = fs.FileSystem.from_uri(root if ":" in root.split("/", 1)[0] else f"file://{root}")

    def _text(self, path: str) -> str | None:
        info = self.files.get_file_info(f"{self.at}/{path}")
        if info.type == fs.FileType.NotFound:
            return None
        found = [info] if info.type == fs.FileType.File else [f for f in self.files.get_file_info(fs.FileSelector(info.path)) if f.is_file and not f.base_name.startswith((".", "_"))]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            with self.files.open_input_stream(f.path) as stream:
                out.append(stream.read().decode("utf-8"))
        return "".join(out)

    def ask(self, path: str) -> Any:
        text = self._text(path)
        if not text or not text.strip():
            return None
        try:
            return json.loads(text)
        except ValueError:
            return None

    def folders(self, prefix: str) -> list[str]:
        return sorted(f.base_name for f in self.files.get_file_info(fs.FileSelector(self.at)) if f.base_name.startswith(prefix))


def _page(venue: Recorded, name: str, cursor: str) -> dict | None:
    page = venue.ask(f"{name}/cursor={quote(cursor or FIRST, safe='')}")
    return page if isinstance(page, dict) else None


def walk(venue: Recorded, name: str, start: dict, most: int) -> Iterator[tuple[int, dict, dict]]:
    """Pages from an offset on: (number, page, the offset behind it).  An offset has cursor, pages, seen and done.

    A page that is not there yet ends the walk, and its cursor is asked for again next time.
    """
    cursor, n, seen, done = start["cursor"], start["pages"], list(start["seen"]), start["done"]
    known = set(seen)
    while not done:
        page = _page(venue, name, cursor)
        if page is None:
            return
        if n == most:
            raise ValueError(f"{name} has more than {most} pages")
        known.add(cursor)
        seen.append(cursor)
        cursor = page.get("next") or ""
        done = not cursor or cursor in known
        n += 1
        yield n - 1, page, {"cursor": cursor, "pages": n, "seen": list(seen), "done": done}


START = {"cursor": "", "pages": 0, "seen": [], "done": False}
ITEM = "venue string, page long, i long, raw string"


def _items(root: str, name: str, start: dict, pages: int, most: int) -> Iterator[tuple]:
    """Items of the pages with numbers from that of an offset up to ``pages``."""
    if start["pages"] >= pages:
        return
    for number, page, _ in walk(Recorded(root), name, start, most):
        for i, item in enumerate(page.get("items") or []):
            yield name.removeprefix("venue="), number, i, json.dumps(item, sort_keys=True)
        if number + 1 >= pages:
            return


class _Settings:
    def __init__(self, options):
        self.root = options["path"]
        self.most = int(options.get("max_pages", 1000))
        #: Pages of a venue that a batch takes at most.
        self.batch = int(options.get("pages_per_batch", 100))

    def venues(self) -> list[str]:
        return Recorded(self.root).folders("venue=")


class _Pages(DataSourceReader):
    def __init__(self, options):
        self.of = _Settings(options)

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(v) for v in self.of.venues()] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield from _items(self.of.root, partition.value, START, self.of.most + 1, self.of.most)


class _PageStream(DataSourceStreamReader):
    def __init__(self, options):
        self.of = _Settings(options)
        self.at: dict[str, dict] = {}
        #: Whether this reader knows where its query stands; one that is made for a restart does not.
        self.placed = False

    def initialOffset(self) -> dict:
        self.placed = True
        return {}

    def latestOffset(self) -> dict:
        """Follow the cursors of each venue, a batch of pages at most.

        Spark does not tell a reader where a restarted query stands, so the first answer after a restart goes as far
        as there are pages: an offset must never lie before one that was given out earlier.
        """
        venue = Recorded(self.of.root)
        for name in self.of.venues():
            start = self.at.get(name, START)
            for number, _, behind in walk(venue, name, start, self.of.most):
                self.at[name] = behind
                if self.placed and number + 1 - start["pages"] >= self.of.batch:
                    break
        self.placed = True
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [InputPartition((name, start.get(name, START), offset["pages"])) for name, offset in end.items() if offset["pages"] > start.get(name, START)["pages"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, start, pages = partition.value
        yield from _items(self.of.root, name, start, pages, self.of.most)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class VenuePages(DataSource):
    """Items of the pages below ``path/venue=V/cursor=C``: venue, page, i (the place in its page) and raw (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "venue_pages"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PageStream(self.options)


def answered(books: Any, asked: Sequence[str]) -> dict[str, dict] | None:
    """The books of a batch by ticker, or None unless there is one for each ticker that was asked for."""
    entries = books.get("orderbooks") if isinstance(books, dict) else None
    if not isinstance(entries, list):
        return None
    found = {}
    for entry in entries:
        if isinstance(entry, dict):
            ticker = entry.get("ticker") or entry.get("market_ticker")
            if ticker in asked:
                found[ticker] = entry
    return found if len(found) == len(set(asked)) else None


class _Books(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.tickers = sorted(set(json.loads(options["tickers"])))

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(self.tickers[i : i + BATCH]) for i in range(0, len(self.tickers), BATCH)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        venue, asked = Recorded(self.root), partition.value
        found = answered(venue.ask("orderbooks/" + quote(",".join(asked), safe="")), asked) if len(asked) > 1 else None
        if found is not None:
            for ticker, entry in found.items():
                yield ticker, "batch", json.dumps(entry, sort_keys=True)
            return
        for ticker in asked:
            entry = venue.ask("orderbook/" + quote(ticker, safe=""))
            if isinstance(entry, dict):
                yield ticker, "single", json.dumps({**entry, "ticker": ticker}, sort_keys=True)


class VenueBooks(DataSource):
    """Books of ``tickers`` (a JSON list) below ``path``: ticker, asked ("batch" or "single") and raw (JSON).

    Answers lie in ``orderbooks/A,B`` for a batch, with its tickers in order, and in ``orderbook/A`` for one.
    """

    @classmethod
    def name(cls) -> str:
        return "venue_books"

    def schema(self) -> str:
        return "ticker string, asked string, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _Books(self.options)


def register(spark) -> None:
    """Make both sources known to a session."""
    for source in (VenuePages, VenueBooks):
        spark.dataSource.register(source)
