"""Order books in long form: a row per price level (book keys, side, is_ask, price, size).

An entry price is what can be lifted at the size that is wanted: asks are walked from the best on.
Walks are running sums over the levels of a book, so they need one shuffle on the book's keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import PRICE, SIZE, usd

STANDARD_SIZES = (10, 50, 100)
#: Levels that are kept on each side of a book.
KEPT_LEVELS = 25


def asks(levels: DataFrame, side: str | None = None) -> DataFrame:
    """The ask levels with a size, of one side or of both."""
    rows = levels.where(F.col("is_ask") & (F.col("size") > 0))
    return rows if side is None else rows.where(F.col("side") == side)


def with_depth(ladder: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds to each level what stands before it (``before``) and up to it (``through``), best price first."""
    before = Window.partitionBy(*keys).orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    out = ladder.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("decimal(18,4)"))
    return out.withColumn("through", (F.col("before") + F.col("size")).cast("decimal(18,4)"))


def walk(ladder: DataFrame, keys: Sequence[str], requested: Column, extra: Sequence[str] = ()) -> DataFrame:
    """Fill ``requested`` (a size, or an array of sizes) from the levels of each ladder.

    Returns keys, requested, filled, notional, average (four places, half up), worst, n_levels and
    fully_filled; a ladder that fills nothing has no row.  ``extra`` columns are the same on all levels
    of a ladder and are kept.
    """
    deep = with_depth(ladder, keys)
    sizes = requested if _is_array(ladder, requested) else F.array(requested)
    # A level is repeated only for the sizes that reach it.
    reaching = F.filter(sizes.cast("array<decimal(18,4)>"), lambda x: x > F.col("before"))
    rows = deep.withColumn("requested", F.explode(reaching))
    rows = rows.withColumn("take", F.least(F.col("size"), F.col("requested") - F.col("before")).cast(SIZE))
    spent = F.col("take") * F.col("price").cast(PRICE)
    out = rows.groupBy(*keys, *extra, "requested").agg(F.sum("take").cast("decimal(18,4)").alias("filled"), F.sum(spent).cast("decimal(24,8)").alias("notional"), F.max("price").alias("worst"), F.count("*").alias("n_levels"))
    out = out.where("filled > 0").withColumn("average", usd(F.col("notional") / F.col("filled")).cast(PRICE))
    return out.withColumn("fully_filled", F.col("filled") >= F.col("requested"))


def _is_array(df: DataFrame, column: Column) -> bool:
    return df.select(column.alias("c")).schema["c"].dataType.typeName() == "array"


def top_of_book(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best prices, sizes and notionals of each book, from one aggregate over its levels."""
    of = lambda side, ask: (F.col("side") == side) & (F.col("is_ask") == ask) & (F.col("size") > 0)
    money = F.col("price") * F.col("size")
    out = []
    for side in ("yes", "no"):
        out += [F.min(F.when(of(side, True), F.col("price"))).alias(f"{side}_ask"), F.max(F.when(of(side, False), F.col("price"))).alias(f"{side}_bid")]
        out += [F.sum(F.when(of(side, True), F.col("size"))).alias(f"{side}_ask_size"), F.sum(F.when(of(side, True), money)).alias(f"{side}_ask_usd"), F.sum(F.when(of(side, False), money)).alias(f"{side}_bid_usd")]
    return levels.groupBy(*keys).agg(*out)


def spread(ask: Column, bid: Column) -> Column:
    return ask - bid


def implied_probability(ask: Column, bid: Column) -> Column:
    """The middle of the spread, else the ask, else the bid."""
    return F.coalesce(usd((ask + bid) / 2), ask, bid)


def imbalance(bid_usd: Column, ask_usd: Column) -> Column:
    """(bid - ask) / (bid + ask) in money; null where there is none.

    Both are taken in units of the last place of money, as whole numbers: a double holds those, so a tie stays one.
    """
    b, a = F.coalesce(bid_usd, F.lit(0)), F.coalesce(ask_usd, F.lit(0))
    whole = lambda x: (x * F.lit(10**8)).cast("decimal(38,0)").cast("double")
    return F.when(b + a > 0, whole(b - a) / whole(b + a))


def depth_profile(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size and money of the asks at the best price, and within one and three cents of it."""
    rows = asks(levels).withColumn("best", F.min("price").over(Window.partitionBy(*keys, "side")))
    out = [F.min("best").alias("best_price")]
    for name, band in (("at_best", "0"), ("within_1c", "0.01"), ("within_3c", "0.03")):
        near = F.col("price") <= F.col("best") + F.lit(band).cast(PRICE)
        out += [F.sum(F.when(near, F.col("size"))).alias(f"size_{name}"), F.sum(F.when(near, F.col("price") * F.col("size"))).alias(f"usd_{name}")]
    return rows.groupBy(*keys, "side").agg(*out)


def matched_walk(left: DataFrame, right: DataFrame, keys: Sequence[str], most: Column | None = None, max_cost: float = 1.0) -> DataFrame:
    """Buy equal amounts from two ladders while a pair costs less than ``max_cost``.

    The ladders lie on one axis of cumulative size.  Its break points are those of both; between two of
    them each ladder has one price, that of its first level which reaches the upper one.  So both are
    merged and sorted once, in time and rows that grow with the levels, not with their product.  As both
    ascend, leaving out dear stretches is the same as stopping at the first.  Returns keys, sets and cost.
    """
    limit = F.lit(str(max_cost)).cast(PRICE)
    leg = lambda rows, name: rows.select(*keys, F.lit(name).alias("__leg"), "price", "size")
    # One exchange by the keys serves both windows and the sum.
    rows = leg(left, "a").unionByName(leg(right, "b")).repartition(*keys)
    up = Window.partitionBy(*keys, "__leg").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    through = F.sum("size").over(up).cast("decimal(18,4)")
    rows = rows.withColumn("__at", through if most is None else F.least(through, most.cast("decimal(18,4)")))
    down = Window.partitionBy(*keys).orderBy(F.desc("__at"), F.desc("price"))
    price = lambda name: F.last(F.when(F.col("__leg") == name, F.col("price")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__a", price("a")).withColumn("__b", price("b")).withColumn("__low", F.coalesce(F.lead("__at").over(down), F.lit(0)))
    both = (F.col("__a") + F.col("__b")).cast(PRICE)
    rows = rows.where((F.col("__low") < F.col("__at")) & (both < limit))
    take = (F.col("__at") - F.col("__low")).cast(SIZE)
    return rows.groupBy(*keys).agg(F.sum(take).cast("decimal(18,4)").alias("sets"), F.sum(take * both).cast("decimal(24,8)").alias("cost"))


def rebuilt(levels: DataFrame, keys: Sequence[str], kept: int = KEPT_LEVELS) -> DataFrame:
    """Books in nested form: four arrays of (price, size), best first, of at most ``kept`` levels."""
    rank = F.row_number().over(Window.partitionBy(*keys, "side", "is_ask").orderBy(F.when(F.col("is_ask"), F.col("price")).otherwise(-F.col("price"))))
    rows = levels.where("size > 0").withColumn("level_index", rank - 1).where(F.col("level_index") < kept)
    ladder = lambda side, ask: F.transform(F.array_sort(F.collect_list(F.when((F.col("side") == side) & (F.col("is_ask") == ask), F.struct("level_index", "price", "size")))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
    return rows.groupBy(*keys).agg(ladder("yes", True).alias("yes_asks"), ladder("yes", False).alias("yes_bids"), ladder("no", True).alias("no_asks"), ladder("no", False).alias("no_bids"))


def filled_at(ladder: Column, size: Column) -> Column:
    """Filled size and notional of a nested ladder (array of price and size, best first) as a struct."""
    start = F.struct(F.lit(0).cast("decimal(18,6)").alias("filled"), F.lit(0).cast("decimal(24,10)").alias("notional"))

    def step(held: Column, level: Column) -> Column:
        take = F.greatest(F.least(level["size"].cast("decimal(18,6)"), size.cast("decimal(18,6)") - held["filled"]), F.lit(0)).cast("decimal(18,6)")
        return F.struct((held["filled"] + take).cast("decimal(18,6)").alias("filled"), (held["notional"] + take * level["price"]).cast("decimal(24,10)").alias("notional"))

    return F.aggregate(ladder, start, step)
