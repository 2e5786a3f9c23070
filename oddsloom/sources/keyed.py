"""A table with one row of each key: upserts rewrite the buckets that they touch, and a manifest names the files that count.

Rows lie in buckets by a hash of their key.  A merge reads the buckets that hold a key of the batch, writes them anew
into a folder of its own, and then publishes a manifest, a small file that names the folder of each bucket.  It is
published by a rename that fails where another writer was first, so readers see the table before a merge or after it; a
merge that fails on the way leaves files that no manifest names.  Files go through Spark and Hadoop's file systems, so
any path that these know will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

#: The greatest number of buckets: their names are in the manifest, which the driver reads.
MOST_BUCKETS = 4096


class ConcurrentMerge(RuntimeError):
    """Another writer published a version first; the merge has to be done again."""


class Folder:
    """The few things that are done with a folder besides reading and writing tables, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.path = path.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at().getFileSystem(self._conf)

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file whole or not at all; ``ConcurrentMerge`` if there is one of that name."""
        draft = self._at(f".{name.replace('/', '-')}-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        target = self._at(name)
        self._fs.mkdirs(target.getParent())
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise ConcurrentMerge(f"{name} is there already") from e
            raise

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class KeyedTable:
    """The table at ``path``, with a row for each value of ``keys``.

    Of rows with one key, that which is greatest by ``order`` counts; end it with a unique column, so that ties are
    settled.  Columns in ``first`` keep the value with which a key came into the table (when a row was created);
    for those in ``known``, null, zero and empty values never replace others (a thin payload erases nothing).
    ``buckets`` holds for a new table; choose it so that a bucket is a few files' worth, as a bucket is what a merge
    rewrites for a key.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64, first: Sequence[str] = (), known: Sequence[str] = ()):
        if not 1 <= buckets <= MOST_BUCKETS:
            raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), list(keys), list(order)
        self.first, self.known, self._buckets = list(first), list(known), buckets
        self._folder = Folder(spark, path)

    # ------------------------------------------------------------------ reading

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, or of the latest; None where there is no table yet."""
        if version is None:
            found = [n for n in self._folder.names("manifests") if n.endswith(".json")]
            if not found:
                return None
            version = int(found[-1].removesuffix(".json"))
        return json.loads(self._folder.read(f"manifests/{version:012d}.json"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the latest."""
        manifest = self.manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._rows(manifest, manifest["buckets"])

    def _rows(self, manifest: dict, buckets) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = sorted(f"{self.path}/{manifest['buckets'][b]}" for b in buckets if b in manifest["buckets"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ------------------------------------------------------------------ writing

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _one_of_each_key(self, rows: DataFrame) -> DataFrame:
        """One row of each key, by an aggregate that combines before its shuffle."""
        order = F.struct(*self.order)
        picked = []
        for c, kind in rows.dtypes:
            if c in self.keys or c == "__there":
                continue
            value = F.max_by(c, order)
            if c in self.first:
                value = F.min_by(c, F.struct((~F.col("__there")).alias("new"), *self.order))
            elif c in self.known:
                blank = F.col(c).isNull() | (F.col(c) == 0 if isinstance(rows.schema[c].dataType, NumericType) else F.col(c).cast("string") == "")
                value = F.coalesce(F.max_by(F.when(~blank, F.col(c)), F.when(~blank, order)), value)
            picked.append(value.alias(c))
        return rows.groupBy(*self.keys).agg(*picked)

    def merge(self, batch: DataFrame, stream: str | None = None, batch_id: int | None = None) -> int:
        """Merge a batch and return the version that holds it.

        With ``stream`` and ``batch_id``, a batch whose id is not over the last one of that stream is there already, and
        nothing is done.  Rows with a null in their key are refused.
        """
        old = self.manifest()
        old = old or {"version": 0, "schema": json.loads(batch.schema.json()), "buckets": {}, "count": self._buckets, "streams": {}}
        if stream is not None and old["streams"].get(stream, -1) >= batch_id:
            return old["version"]
        if set(batch.columns) != set(StructType.fromJson(old["schema"]).names):
            raise ValueError(f"columns {batch.columns} are not those of the table")
        n = old["count"]
        batch = batch.select(*StructType.fromJson(old["schema"]).names)
        marked = batch.withColumn("__bucket", self._bucket(n))
        null_key = F.lit(False)
        for k in self.keys:
            null_key = null_key | F.col(k).isNull()
        # A row for each touched bucket, of which there are MOST_BUCKETS at most.
        touched = marked.groupBy("__bucket").agg(F.max(null_key.cast("int")).alias("nulls")).collect()
        if any(r.nulls for r in touched):
            raise ValueError(f"a key of {self.keys} is null")
        manifest = old | {"version": old["version"] + 1, "buckets": dict(old["buckets"]), "streams": dict(old["streams"])}
        if stream is not None:
            manifest["streams"][stream] = batch_id
        if touched:
            names = [str(r["__bucket"]) for r in touched]
            there = self._rows(old, names).withColumn("__there", F.lit(True)).unionByName(batch.withColumn("__there", F.lit(False)))
            rows = self._one_of_each_key(there).select(*batch.columns)
            folder = f"data/v{manifest['version']}-{uuid.uuid4().hex}"
            rows = rows.withColumn("__bucket", self._bucket(n)).repartition(min(n, len(names)), "__bucket")
            rows.write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
            manifest["buckets"] |= {b: f"{folder}/__bucket={b}" for b in names}
        self._folder.publish(f"manifests/{manifest['version']:012d}.json", json.dumps(manifest))
        return manifest["version"]

    def sink(self, stream: str, tries: int = 5) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each batch of a stream is merged once, however often it is run."""

        def merge(batch: DataFrame, batch_id: int) -> None:
            for left in reversed(range(tries)):
                try:
                    self.merge(batch, stream, batch_id)
                    return
                except ConcurrentMerge:
                    if not left:
                        raise

        return merge

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions, and folders that none of those names.

        Run it where no merge is under way: the files of one that has not been published are named by none.
        """
        found = [n for n in self._folder.names("manifests") if n.endswith(".json")]
        kept, gone = found[-keep:], found[:-keep]
        used = {f.split("/")[1] for name in kept for f in json.loads(self._folder.read(f"manifests/{name}"))["buckets"].values()}
        for name in gone:
            self._folder.remove(f"manifests/{name}")
        for name in self._folder.names("data"):
            if name not in used:
                self._folder.remove(f"data/{name}")
