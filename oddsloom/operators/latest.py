"""Latest rows, as-of joins and deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which provenances a mode shows.
MODES = {"live": ("live", "fixture"), "demo": ("demo",), "all": None}


def with_provenance(df: DataFrame, mode: str) -> DataFrame:
    """The rows that a mode shows; filter before picking the latest, or a demo row may hide a live one."""
    shown = MODES[mode]
    return df if shown is None else df.where(F.col("provenance").isin(*shown))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The row of each key that is greatest by ``order``; ends with a unique column, so ties are settled.

    An aggregate of structs: rows combine before the shuffle, and no key is sorted as a whole.
    """
    rest = [c for c in (columns or df.columns) if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Sequence[str], tie: str, strict: bool = False, tolerance_seconds: float | None = None) -> DataFrame:
    """For each row of ``left``, the values of ``right`` at the latest time not after its own.

    The sides are stacked and sorted once by key and time, and the last row of ``right`` is carried
    forward; no range join is needed.  ``strict`` takes times before only.  Values older than the
    tolerance are null.  ``tie`` orders rows of ``right`` at one time.
    """
    a = left.withColumn("__at", F.col(left_time)).withColumn("__side", F.lit(0 if strict else 1)).withColumn("__tie", F.lit(None).cast("long")).withColumn("__v", F.lit(None))
    packed = F.struct(F.col(right_time).alias("__seen"), *values)
    b = right.select(key, F.col(right_time).alias("__at"), F.lit(1 if strict else 0).alias("__side"), F.col(tie).cast("long").alias("__tie"), packed.alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where(F.col("__side") == (0 if strict else 1))
    if tolerance_seconds is not None:
        age = F.unix_micros("__at") - F.unix_micros("__last.__seen")
        out = out.withColumn("__last", F.when(age <= int(tolerance_seconds * 1_000_000), F.col("__last")))
    return out.select(*left.columns, *(F.col(f"__last.{v}").alias(v) for v in values))


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", total: str = "total") -> DataFrame:
    """Adds the place (from 1) of each row in its group, and the rows of the group.

    Rows are sorted only among those of one value of ``order[0]``; what comes before those is counted by value.
    """
    at, *rest = order
    counts = df.groupBy(*keys, at).agg(F.count("*").alias("__here"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__here").over(w.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(total, F.sum("__here").over(w)).drop("__here")
    names = [*keys, at]
    renamed = counts.select(*(F.col(c).alias(f"__k_{c}") for c in names), "__before", total)
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    within = F.row_number().over(Window.partitionBy(*names).orderBy(*(rest or [at])))
    return df.withColumn("__within", within).join(renamed, same).withColumn(name, F.col("__before") + F.col("__within")).select(*df.columns, name, total)


def nearest(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Sequence[str], seconds: float, until: str | None = None) -> DataFrame:
    """For each row of ``left``, the values of ``right`` whose time is nearest to its own, before or after; null beyond ``seconds``.

    Times are in seconds.  Of two equally near ones the earlier counts, of rows of one time those with the least
    values.  With ``until``, a column of ``left``, rows of ``right`` after that time do not count.

    The sides are stacked and sorted by key and time, in slots of time so that no key is one task: rows of ``right`` also
    go to the slots that are within reach.
    """
    width = max(4 * seconds, 1.0)
    slot = lambda t: F.floor(t / F.lit(width)).cast("long")
    a = left.select(*left.columns, F.monotonically_increasing_id().alias("__row"), F.col(left_time).cast("double").alias("__at"))
    a = a.withColumn("__slot", slot(F.col("__at"))).withColumn("__value", F.lit(None))
    packed = F.struct(F.col(right_time).cast("double").alias("__seen"), *values)
    b = right.where(F.col(right_time).isNotNull()).select(key, F.col(right_time).cast("double").alias("__at"), packed.alias("__value"))
    reach = F.array_distinct(F.array(slot(F.col("__at") - seconds), slot(F.col("__at")), slot(F.col("__at") + seconds)))
    b = b.groupBy(key, "__at").agg(F.min("__value").alias("__value")).withColumn("__slot", F.explode(reach))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key, "__slot")
    # Of one time, rows of the right are seen by those of the left from before; a row of the left is last then, first from behind.
    side = F.col("__row").isNotNull()
    before = F.last("__value", ignorenulls=True).over(w.orderBy("__at", side).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("__value", ignorenulls=True).over(w.orderBy(F.desc("__at"), side).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__b", before).withColumn("__a", after).where(side)
    gap = lambda x: F.abs(x["__seen"] - F.col("__at"))
    fits = lambda x: (gap(x) <= seconds) & (F.lit(True) if until is None else x["__seen"] <= F.col(until).cast("double"))
    x, y = (F.when(fits(F.col(c)), F.col(c)) for c in ("__b", "__a"))
    best = F.when(y.isNull() | (gap(x) <= gap(y)), x).otherwise(y)
    return out.withColumn("__best", best).select(*left.columns, F.col("__best.__seen").alias(right_time), *(F.col(f"__best.{v}").alias(v) for v in values))


def siblings(df: DataFrame, group: str, value: str) -> DataFrame:
    """Adds the sum and number of the other rows of a group."""
    w = Window.partitionBy(group)
    return df.withColumn("sibling_sum", F.sum(value).over(w) - F.col(value)).withColumn("n_siblings", F.count(value).over(w) - 1)


def either_endpoint(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs in both directions, so that matches of a row are an equi-join and never an OR."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    return pairs.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest).unionByName(pairs.select(F.col(b).alias("node"), F.col(a).alias("other"), *rest))


def search(df: DataFrame, columns: Sequence[str], terms: str) -> DataFrame:
    """Rows where each word of ``terms`` is within some column, whatever its case; % and _ are plain characters."""
    for term in terms.lower().split():
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(c), F.lit(term))
        df = df.where(hit)
    return df
