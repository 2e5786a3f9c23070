"""Exact order statistics without sorting a group in one task.

Equal values are counted first.  A group's distinct values are cut into buckets of about as many of them, at quantiles
that a mergeable sketch gives, so outliers do not matter; the counts of buckets tell in which of them a place lies, and only
these are sorted, each on its own.  The sketch decides how even buckets are, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, ACCURACY = 256, 2048
#: Places of the median (two, whose values are averaged) and of the quartiles, counted from 0.
MIDDLE = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2)}
QUARTILES = {"p25": lambda n: F.floor(n / 4), "p75": lambda n: F.floor(3 * n / 4)}


def values_at(df: DataFrame, keys: Sequence[str], value: str, places: Mapping[str, Callable[[Column], Column]], buckets: int = BUCKETS) -> DataFrame:
    """keys, n and the value at each of ``places`` (functions of n) among a group's values in order; nulls take no part."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    edges = F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], ACCURACY)
    span = counted.groupBy(*keys).agg(edges.alias("__e"), F.sum("__c").alias("n"))
    dealt = counted.join(span, list(keys)).withColumn("__b", F.size(F.filter("__e", lambda e: e <= F.col("__v")))).drop("__e")
    held = dealt.groupBy(*keys, "__b").agg(F.sum("__c").alias("__in"), F.max("n").alias("n"))
    up = Window.partitionBy(*keys).orderBy("__b")
    held = held.withColumn("__before", F.sum("__in").over(up) - F.col("__in"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), of(F.col("n")).alias("place")) for name, of in places.items())))
    wanted = held.withColumn("__p", asked).where((F.col("__p.place") >= F.col("__before")) & (F.col("__p.place") < F.col("__before") + F.col("__in")))
    wanted = wanted.select(*keys, "__b", F.col("__p.name").alias("__name"), (F.col("__p.place") - F.col("__before")).alias("__place"))
    inner = dealt.join(wanted.select(*keys, "__b").distinct(), [*keys, "__b"], "left_semi")
    within = Window.partitionBy(*keys, "__b").orderBy("__v")
    inner = inner.withColumn("__end", F.sum("__c").over(within)).select(*keys, "__b", "__v", "__end", "__c")
    found = inner.join(wanted, [*keys, "__b"]).where((F.col("__place") < F.col("__end")) & (F.col("__place") >= F.col("__end") - F.col("__c")))
    out = found.groupBy(*keys).agg(*(F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in places))
    return span.select(*keys, "n").join(out, list(keys))
