"""Exact deduplication over an extendible-hash index kept in shared files.

The index maps a 64-bit key of a text to the entries stored under it.  A directory, read from the leading
bits of a key, points at buckets; a bucket that holds more bytes than its capacity splits on the next bits,
and where the directory is not deep enough for that it doubles (:func:`directory`).  The directory is a
table, made level by level by grouping, so neither its cells nor the keys pass through the driver.  Of the
doubled cells only the first bits that all buckets have (the root) are written out; a key finds its bucket
by its root and then by the bucket's own bits.

Each bucket is owned by one task.  The owner chains the entries that share a key and compares their
bytes, so two texts are equal only if every byte is: a row gets its group from the chain that its text
was put in, not from a digest.

Copies collapse in the map tasks before anything is shuffled.  A bucket with a key of more than
``HOT_ROWS`` rows has several owners; its rows are dealt to them by map task, and what they find is
compared again by one (:func:`_merge`), which sees each distinct text once for each owner and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, scratch, stored, tidied

COMBINED = "key long, text binary, ids array<long>"
OWNED = "bucket long, salt int, salts int, key long, chain int, text binary, text_sha256 string, keep_id long, group_size long, ids array<long>"
MERGED = "bucket long, salt int, key long, chain int, whole_chain int, keep_id long, group_size long"

#: Bits by which the directory deepens at once, and the most it has; keys of more equal bits stay together.
STEP_BITS, MOST_BITS = 8, 56
#: A directory of at most this many buckets is broadcast; a larger one is joined by shuffle.
BROADCAST_BUCKETS = 1 << 17
#: Rows of one key to an owner, and owners of a bucket, at most; these set how work is spread, not what is read.
HOT_ROWS, MOST_OWNERS = 4096, 1 << 16
#: Bytes that a key and a row's id take in a bucket besides its text.
KEY_BYTES, ID_BYTES = 200, 40


def _prefix(key, depth):
    """The leading ``depth`` bits of a key; cell 0 for depth 0."""
    if isinstance(depth, int):
        return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, (F.lit(64) - depth).cast("int")))


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """Buckets (prefix long, depth int, rows_of_key long) for ``keys`` (key long, n_bytes long, n long; each key once).

    A bucket is a prefix of bits whose keys hold at most ``capacity`` bytes, ids included, or are only one, while the
    keys of the prefix one bit shorter hold more.  ``rows_of_key`` is the number of rows of its most
    frequent key.  Each round groups the keys that are still in overfull cells by ``STEP_BITS`` bits more.
    """
    done = None
    depth, over = 0, keys
    while True:
        deeper = min(depth + STEP_BITS, MOST_BITS)
        cells = over.groupBy(_prefix(F.col("key"), deeper).alias("cell")).agg(F.sum("n_bytes").alias("size"), F.count("*").alias("k"), F.max("n").alias("n"))
        cells = stored(cells, "dedup-cells")
        # All prefixes of the cells, of each depth of this round.
        levels = F.explode(F.sequence(F.lit(depth), F.lit(deeper)))
        nodes = cells.select("*", levels.alias("depth")).withColumn("prefix", F.call_function("shiftright", "cell", (F.lit(deeper) - F.col("depth")).cast("int")))
        nodes = nodes.groupBy("depth", "prefix").agg(F.sum("size").alias("size"), F.sum("k").alias("k"), F.max("n").alias("rows_of_key"))
        nodes = stored(nodes.withColumn("full", (F.col("size") > capacity) & (F.col("k") > 1) & (F.col("depth") < MOST_BITS)), "dedup-nodes")
        above = nodes.where("full").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        fits = nodes.where("not full")
        parts = fits.withColumn("above", F.shiftright("prefix", 1)).join(above, ["depth", "above"])
        if depth == 0:
            parts = fits.where("depth = 0").select("prefix", "depth", "rows_of_key").unionByName(parts.select("prefix", "depth", "rows_of_key"))
        parts = stored(parts.select("prefix", F.col("depth").cast("int").alias("depth"), "rows_of_key"), "dedup-buckets")
        done = parts if done is None else done.unionByName(parts)
        full = stored(nodes.where(f"full and depth = {deeper}").select("prefix"), "dedup-full")
        if full.isEmpty():
            return done
        over = stored(over.join(full, _prefix(F.col("key"), deeper) == F.col("prefix"), "left_semi"), "dedup-over")
        depth = deeper


def _collapse(most_bytes: int):
    """Map-side combining: equal texts of a task become one row; the table is emptied when it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, list]] = {}
        used = 0

        def flush():
            texts = list(held)
            out = pa.record_batch([pa.array([held[t][0] for t in texts], pa.int64()), pa.array(texts, pa.binary()), pa.array([held[t][1] for t in texts], pa.list_(pa.int64()))], ["key", "text", "ids"])
            held.clear()
            return out

        for batch in tidied(batches):
            for key, text, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (seen := held.get(text)) is None:
                    held[text] = key, [doc_id]
                    used += len(text) + 300
                else:
                    seen[1].append(doc_id)
                    used += 40
                if used > most_bytes:
                    yield flush()
                    used = 0
        if held:
            yield flush()

    return run


def _greatest(ids) -> int | None:
    return max((i for i in ids if i is not None), default=None)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner of a bucket: chain the entries of each key, comparing their bytes."""
    chains: dict[int, list[tuple[bytes, list]]] = {}
    bucket = salt = salts = None
    for batch in batches:
        bucket, salt, salts = (batch.column(c)[0].as_py() for c in ("bucket", "salt", "salts"))
        for key, text, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "ids")), strict=True):
            chain = chains.setdefault(key, [])
            for entry in chain:
                if entry[0] == text:
                    entry[1].extend(ids)
                    break
            else:
                chain.append((text, ids))
    # The texts of a bucket with one owner are not needed again.
    out = [(bucket, salt, salts, key, i, text if salts > 1 else None, hashlib.sha256(text).hexdigest(), _greatest(ids), len(ids), ids) for key, chain in chains.items() for i, (text, ids) in enumerate(chain)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["bucket", "salt", "salts", "key", "chain", "text", "text_sha256", "keep_id", "group_size", "ids"]
    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain what the owners of one bucket found, comparing bytes; a row for each of their entries."""
    chains: dict[int, list[list]] = {}
    found, bucket = [], None
    for batch in batches:
        bucket = batch.column("bucket")[0].as_py()
        for salt, key, at, text, keep, size in zip(*(batch.column(c).to_pylist() for c in ("salt", "key", "chain", "text", "keep_id", "group_size")), strict=True):
            chain = chains.setdefault(key, [])
            for i, entry in enumerate(chain):
                if entry[0] == text:
                    entry[1], entry[2] = _greatest((entry[1], keep)), entry[2] + size
                    break
            else:
                i = len(chain)
                chain.append([text, keep, size])
            found.append((salt, key, at, i))
    out = [(bucket, salt, key, at, i, *chains[key][i][1:]) for salt, key, at, i in found]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "salt", "key", "chain", "whole_chain", "keep_id", "group_size"])


class ExtendibleIndex:
    """An index in shared files: its directory, what the owners of its buckets hold, and how that is merged."""

    def __init__(self, path: str):
        self.path = path

    def rows(self, spark) -> DataFrame:
        """bucket, key, chain, text_sha256, keep_id, group_size and ids of every entry of every owner."""
        owned = spark.read.schema(OWNED).parquet(f"{self.path}/entries")
        merged = spark.read.schema(MERGED).parquet(f"{self.path}/merged")
        columns = ["bucket", "key", "chain", "text_sha256", "keep_id", "group_size", "ids"]
        alone = owned.where("salts = 1").select(columns)
        shared = owned.where("salts > 1").select("bucket", "salt", "key", "chain", "text_sha256", "ids").join(merged, ["bucket", "salt", "key", "chain"])
        return alone.unionByName(shared.withColumn("chain", F.col("whole_chain")).select(columns))

    def entries(self, spark) -> DataFrame:
        """bucket, key, chain, text_sha256, keep_id and group_size of each distinct text."""
        return self.rows(spark).drop("ids").distinct()

    @staticmethod
    def build(texts: DataFrame, keys: DataFrame, capacity: int = 4 << 20, held: int = 24 << 20) -> ExtendibleIndex:
        """Index ``texts`` (key long, text binary, doc_id long); ``keys`` has (key, n_bytes) for each of its rows."""
        spark = texts.sparkSession
        path = scratch(spark, "dedup-index")
        distinct = stored(keys.groupBy("key").agg((F.max("n_bytes") + KEY_BYTES + ID_BYTES * F.count("*")).alias("n_bytes"), F.count("*").alias("n")), "dedup-keys")
        # A bucket is named by its bits after a leading one.
        owners = F.least(F.ceil(F.col("rows_of_key") / HOT_ROWS), F.lit(MOST_OWNERS)).cast("int")
        directory(distinct, capacity).select("prefix", "depth", F.expr("shiftleft(1L, depth) | prefix").alias("bucket"), owners.alias("salts")).write.parquet(f"{path}/directory")
        buckets = spark.read.schema("prefix long, depth int, bucket long, salts int").parquet(f"{path}/directory")
        size, least = buckets.agg(F.count("*"), F.min("depth")).first()
        least = least or 0
        buckets = buckets.withColumn("root", F.call_function("shiftrightunsigned", "prefix", F.col("depth") - least))
        combined = texts.select("key", "text", "doc_id").mapInArrow(_collapse(held), COMBINED)
        combined = combined.withColumn("root", _prefix(F.col("key"), least)).withColumn("task", F.spark_partition_id())
        held_by = buckets.select("root", "prefix", "depth", "bucket", "salts")
        # Joined by shuffle, rows are placed by their root, which the grouping below builds on.
        placed = combined.join(F.broadcast(held_by) if size <= BROADCAST_BUCKETS else held_by, "root").where(_prefix(F.col("key"), F.col("depth")) == F.col("prefix"))
        dealt = placed.withColumn("salt", F.pmod(F.hash("task"), F.col("salts")).cast("int"))
        dealt.select("root", "bucket", "salt", "salts", "key", "text", "ids").groupBy("root", "bucket", "salt").applyInArrow(_own, OWNED).write.parquet(f"{path}/entries")
        shared = spark.read.schema(OWNED).parquet(f"{path}/entries").where("salts > 1")
        shared.select("bucket", "salt", "key", "chain", "text", "keep_id", "group_size").groupBy("bucket").applyInArrow(_merge, MERGED).write.parquet(f"{path}/merged")
        return ExtendibleIndex(path)


def exact_groups(docs: DataFrame, capacity: int = 4 << 20) -> DataFrame:
    """Group the rows of ``docs`` (doc_id long, text string) whose texts are identical, byte for byte.

    Returns one row per row of ``docs``: doc_id, keep_id (the largest doc_id of the group),
    group_size (rows of the group), kept (doc_id = keep_id) and text_sha256.

    Null texts count as empty, and all empty texts are one group.  Rows that repeat both doc_id and
    text are all kept, as nothing tells them apart.  A null doc_id never beats another; a group of
    null ids only has a null keep_id and keeps its rows.  Texts of any length are compared whole.  An
    empty table gives an empty result.  Columns besides doc_id and text are ignored.
    """
    key = F.xxhash64(body())
    keys = docs.select(key.alias("key"), F.octet_length(body()).cast("long").alias("n_bytes"))
    index = ExtendibleIndex.build(docs.select(key.alias("key"), body().cast("binary").alias("text"), "doc_id"), keys, capacity)
    rows = index.rows(docs.sparkSession).select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "text_sha256")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops; of repeated rows that it keeps, all stay."""
    groups = exact_groups(docs.select("doc_id", "text"))
    out = groups.where("not kept").select("doc_id", "text_sha256").distinct()
    text = docs.withColumn("__sha", F.sha2(body().cast("binary"), 256))
    return text.join(out, text.doc_id.eqNullSafe(out.doc_id) & (text["__sha"] == out.text_sha256), "left_anti").drop("__sha")
