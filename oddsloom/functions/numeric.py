"""Decimal columns with the rounding that money needs.

Widths are narrow on purpose: Spark cuts the scale of a product whose precision passes 38 digits, and
a fee is the product of four decimals.  With these widths it types as decimal(36,18), so it is exact
before it is rounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE, SIZE, RATE, PROB, MONEY = "decimal(6,4)", "decimal(12,4)", "decimal(8,6)", "decimal(10,6)", "decimal(20,8)"
#: Probabilities are kept this far from 0 and 1 where logarithms are taken.
EPSILON = 1e-6


def dec(value: str | int, kind: str = MONEY) -> Column:
    """An exact decimal literal."""
    return F.lit(str(value)).cast(kind)


def exact(column: Column, kind: str = MONEY) -> Column:
    """A decimal from a number or text; floats go through their shortest text, bad input becomes null."""
    return column.cast("string").try_cast(kind)


def ceil_cent(x: Column) -> Column:
    return F.ceil(x, F.lit(2))


def floor_cent(x: Column) -> Column:
    return F.floor(x, F.lit(2))


def round_cent(x: Column) -> Column:
    return F.round(x, 2)


def usd(x: Column) -> Column:
    """Money and prices: four places, half up."""
    return F.round(x, 4)


def prob(x: Column) -> Column:
    """Probabilities: six places, half up."""
    return F.round(x, 6)


def clamp(x: Column, low=0, high=1) -> Column:
    return F.least(F.greatest(x, F.lit(low).cast("double") if isinstance(low, float) else F.lit(low)), F.lit(high))


def clamp_prob(x: Column) -> Column:
    x = x.cast("double")
    # greatest and least skip nulls; an unknown probability stays unknown.
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(EPSILON)), F.lit(1 - EPSILON)))


def safe_div(n: Column, d: Column, default=0) -> Column:
    """n / d, or a default where d is 0."""
    return F.when(d == 0, F.lit(default)).otherwise(F.try_divide(n, d))


def snap_to_tick(price: Column, tick: Column, how: str = "nearest") -> Column:
    """The multiple of a tick at or above ("up"), at or below ("down") or nearest to a price."""
    steps = price / tick
    whole = {"up": F.ceil(steps), "down": F.floor(steps), "nearest": F.round(steps, 0)}[how]
    return (whole * tick).cast(PRICE)


def shown(x: Column, places: int = 6) -> Column:
    """A number as results show it: a double of so many places."""
    return F.round(x.cast("double"), places)
