"""Keyed state over streams: the latest book of each market with its expiry, and the versions of rules.

Both are stateful processors for ``transformWithState``, which keeps state in RocksDB; set
``spark.sql.streaming.stateStore.providerClass`` to its provider (:data:`ROCKSDB`).  Each also works on a batch
DataFrame, whose result is the definition: a stream that has seen the same rows, none of them later than the
watermark, ends with the same state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampType

from ..operators.latest import latest

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class LatestRow(StatefulProcessor):
    """State of a key: its greatest row by time and tie; a timer clears it when that is ``expiry`` seconds old.

    A row that comes late, or again, is no news unless it is greater than what is held.  A change of the row is given out
    with ``expired`` false, and the end of its time with ``expired`` true.  Times are microseconds, so they come out of
    the state as they went in.
    """

    def __init__(self, schema: StructType, at: str, tie: str, expiry: float):
        self.schema, self.at, self.tie, self.expiry = schema, at, tie, expiry
        self.row, self.change = Row(*schema.names), Row(*schema.names, "expired")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("latest", self.schema)

    def _due(self, row: Row) -> int:
        return row[self.at] // 1000 + round(self.expiry * 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.row(*self.held.get()) if self.held.exists() else None
        best = before
        for row in rows:
            if best is None or (row[self.at], row[self.tie]) > (best[self.at], best[self.tie]):
                best = row
        if best is None or best is before:
            return
        if before is not None:
            self.handle.deleteTimer(self._due(before))
        values = [best[c] for c in self.schema.names]
        self.held.update(tuple(values))
        self.handle.registerTimer(self._due(best))
        yield self.change(*values, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.held.exists():
            return
        held = self.row(*self.held.get())
        if self._due(held) <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield self.change(*held, True)

    def close(self) -> None:
        pass


def latest_books(books: DataFrame, key: str = "market_id", at: str = "observed_at", tie: str = "seq", lateness: str = "1 hour", expiry: float = 86400.0) -> DataFrame:
    """Changes of the latest row of each key, with ``expired``; a batch gives the latest rows, none expired.

    Rows without a time are left out.  ``tie`` orders rows of one time and must not be null.  On a stream a row
    counts if it is no later than ``lateness`` behind the newest one; a key whose row grew ``expiry`` seconds older than the
    watermark is given out once more, as expired, and forgotten.
    """
    books = books.where(F.col(at).isNotNull())
    if not books.isStreaming:
        return latest(books, [key], [at, tie]).select(*books.columns).withColumn("expired", F.lit(False))
    times = [f.name for f in books.schema if isinstance(f.dataType, TimestampType)]
    fields = [StructField(f.name, LongType()) if f.name in times else f for f in books.schema]
    schema = StructType(fields)
    counted = books.select(F.col(at).alias("__at"), *(F.unix_micros(c).alias(c) if c in times else F.col(c) for c in books.columns))
    processor = LatestRow(schema, at, tie, expiry)
    changes = counted.withWatermark("__at", lateness).groupBy(key).transformWithState(processor, StructType([*fields, StructField("expired", BooleanType())]), "Update", "EventTime")
    return changes.select(*(F.timestamp_micros(c).alias(c) if c in times else F.col(c) for c in books.columns), "expired")


class RuleVersions(StatefulProcessor):
    """State of a market: the hash and number of its last rules; a text of another hash is a new version.

    Rows of one batch are taken in the order of their times; one that is not newer than the last version is an old
    answer of the venue and changes nothing.
    """

    STATE = "digest string, version int, at long"

    def __init__(self, key: str, at: str, text: str):
        self.key, self.at, self.text = key, at, text
        self.change = Row(key, "version", at, "digest")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("rules", self.STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        digest, version, last = self.held.get() if self.held.exists() else (None, 0, None)
        for row in sorted((r for r in rows if r[self.at] is not None), key=lambda r: (r[self.at], r[self.text] or "")):
            if last is not None and row[self.at] <= last:
                continue
            new = hashlib.sha256((row[self.text] or "").encode()).hexdigest()
            last = row[self.at]
            if new != digest:
                digest, version = new, version + 1
                yield self.change(key[0], version, row[self.at], digest)
        if last is not None:
            self.held.update((digest, version, last))

    def close(self) -> None:
        pass


def rule_changes_of(rules: DataFrame, key: str, at: str, text: str) -> DataFrame:
    """A row for each version of a market's rules on a stream: key, version (from 1), at and sha256 of the text."""
    counted = rules.where(F.col(at).isNotNull()).select(key, F.unix_micros(at).alias("__us"), F.col(text).alias("__text"))
    out = f"{key} {dict(rules.dtypes)[key]}, version int, __us long, digest string"
    found = counted.groupBy(key).transformWithState(RuleVersions(key, "__us", "__text"), out, "Append", "None")
    return found.select(key, "version", F.timestamp_micros("__us").alias(at), "digest")
