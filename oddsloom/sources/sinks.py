"""Sinks: keyed upserts, inserts that skip what is there, retention and append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.latest import latest


def upserted(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table after a batch: of each key, the row that is greatest by ``order``."""
    return latest(table.unionByName(batch), keys, order)


def insertable(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a batch whose keys the table lacks, one of each key: the least by ``order``."""
    new = batch.join(table.select(*keys).distinct(), list(keys), "left_anti")
    rest = [c for c in batch.columns if c not in keys]
    return new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def retained(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days; the rest is what a prune drops."""
    return df.where(F.col(at) >= F.timestamp_add("DAY", F.lit(-days), now))


def append_new(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Append the rows of a batch that the table at ``path`` lacks; running it twice is running it once."""
    spark = batch.sparkSession
    try:
        table = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  there is no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = spark.createDataFrame([], batch.schema)
    insertable(table, batch, keys, order).select(*batch.columns).write.mode("append").parquet(path)
