"""Pages of JSON that lie in files, one venue's in each, a JSON object with ``cursor``, ``next`` and ``items`` on each line.

:func:`read_pages` reads them from any path that Spark reads.  Only cursors are followed in one task for each file;
items stay where they are and are joined to them.  A cursor that comes again ends the reading.  Venues that are asked page
by page are read by :mod:`polled`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """file, page (its place in the order of cursors) and raw (JSON) of each item of the pages below ``path``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    page = F.from_json("value", "cursor string, next string, items array<string>")
    pages = lines.select("file", page.alias("p")).select("file", F.coalesce("p.cursor", F.lit("")).alias("cursor"), F.coalesce("p.next", F.lit("")).alias("next"), "p.items")

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        links = dict(zip(rows["cursor"], rows["next"], strict=True))
        cursor, seen, known = "", [], set()
        while cursor in links and cursor not in known:
            seen.append(cursor)
            known.add(cursor)
            cursor = links[cursor]
            if not cursor:
                break
        return pd.DataFrame({"file": rows["file"].iloc[:1].tolist() * len(seen), "cursor": seen, "page": range(len(seen))})

    followed = pages.select("file", "cursor", "next").groupBy("file").applyInPandas(order, "file string, cursor string, page long")
    items = pages.dropDuplicates(["file", "cursor"]).join(followed, ["file", "cursor"])
    return items.select("file", "page", F.posexplode("items").alias("i", "raw")).select("file", "page", "i", "raw")
