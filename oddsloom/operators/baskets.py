"""Baskets: several legs that are only worth what the scarcest of them can fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import PRICE, SIZE, safe_div, usd
from .books import walk


def capacity(legs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units that every leg can fill and the leg that binds: keys, units, binding_leg.

    ``legs`` has keys, leg_no, label, ratio and available (the size of its ladder).  Legs with a ratio of
    0 or less do not count; a leg without size makes the basket empty.  Of equally scarce legs, the
    first binds.
    """
    rows = legs.where("ratio > 0").withColumn("units", safe_div(F.coalesce("available", F.lit(0)).cast(SIZE), F.col("ratio").cast(SIZE)).cast("decimal(18,6)"))
    rows = rows.withColumn("units", F.greatest("units", F.lit(0)))
    return rows.groupBy(*keys).agg(F.min("units").alias("units"), F.min_by("label", F.struct("units", "leg_no")).alias("binding_leg"))


def simulate(ladders: DataFrame, legs: DataFrame, keys: Sequence[str], requested: Column) -> DataFrame:
    """Scale each basket to its capacity and fill its legs.

    ``ladders`` has keys, leg_no, price and size.  Returns keys, requested_units, executable_units,
    binding_leg, n_legs, total_cost, fully_executable and fully_hedged.
    """
    caps = capacity(legs, keys).withColumn("requested_units", requested.cast("decimal(18,6)"))
    caps = caps.withColumn("executable_units", F.least("units", "requested_units"))
    wanted = legs.join(caps, list(keys)).withColumn("target", (F.col("executable_units") * F.col("ratio")).cast("decimal(18,4)"))
    sized = ladders.join(wanted.select(*keys, "leg_no", "target"), [*keys, "leg_no"])
    fills = walk(sized, [*keys, "leg_no"], F.col("target"), ["target"])
    legged = wanted.join(fills.select(*keys, "leg_no", "filled", "notional"), [*keys, "leg_no"], "left")
    whole = F.coalesce("filled", F.lit(0)) >= F.col("target")
    out = legged.groupBy(*keys).agg(
        F.first("requested_units").alias("requested_units"),
        F.first("executable_units").alias("executable_units"),
        F.first("binding_leg").alias("binding_leg"),
        F.count("*").alias("n_legs"),
        F.sum(usd(F.coalesce("notional", F.lit(0)))).alias("total_cost"),
        F.min(whole.cast("int")).alias("whole"),
    )
    hedged = (F.col("executable_units") > 0) & (F.col("whole") == 1)
    return out.withColumn("fully_executable", (F.col("executable_units") >= F.col("requested_units")) & (F.col("requested_units") > 0)).withColumn("fully_hedged", hedged).drop("whole")


def edge(units: Column, cost: Column, payout: Column, fees_per_unit: Column) -> tuple[Column, Column]:
    """Net profit of a filled basket and its ratio to cost; nothing without units."""
    profit = usd(usd(payout * units) - cost - usd(fees_per_unit * units))
    none = units <= 0
    return F.when(none, F.lit(0)).otherwise(profit), F.when(none, F.lit(0)).otherwise(usd(safe_div(profit.cast("decimal(18,6)"), cost.cast("decimal(18,6)"))))


def leg_price(price: Column) -> Column:
    return price.cast(PRICE)
