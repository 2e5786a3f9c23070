"""Venue fees, as exact decimal columns.

Both venues charge rate * contracts * price * (1 - price); one rounds the order up to a cent, the
other to five places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import PRICE, RATE, SIZE, ceil_cent, dec, safe_div

TAKER_RATE, MAKER_RATE = "0.07", "0.0175"
#: The smallest fee of the venue that rounds to five places.
LEAST_FEE = "0.00001"


def quadratic(contracts: Column, price: Column, rate: Column) -> Column:
    """rate * contracts * price * (1 - price), exact: decimal(36,18)."""
    p = price.cast(PRICE)
    return rate.cast(RATE) * contracts.cast(SIZE) * p * (F.lit(1) - p).cast("decimal(7,4)")


def _none(contracts: Column, price: Column, rate: Column) -> Column:
    return (contracts <= 0) | (price <= 0) | (price >= 1) | (rate <= 0)


def cent_fee(contracts: Column, price: Column, rate: Column) -> Column:
    """The quadratic fee, rounded up to a cent on the whole order."""
    return F.when(_none(contracts, price, rate), dec(0)).otherwise(ceil_cent(quadratic(contracts, price, rate)).cast("decimal(20,8)"))


def fine_fee(contracts: Column, price: Column, rate: Column) -> Column:
    """The quadratic fee at five places, half up; less than the last place is nothing."""
    rounded = F.round(quadratic(contracts, price, rate), 5).cast("decimal(20,8)")
    return F.when(_none(contracts, price, rate) | (rounded < dec(LEAST_FEE)), dec(0)).otherwise(rounded)


def flat_fee(contracts: Column, rate: Column) -> Column:
    """rate * contracts, rounded up to a cent; there is no guard on the price."""
    return ceil_cent(rate.cast(RATE) * contracts.cast(SIZE)).cast("decimal(20,8)")


def taker_fee(platform: Column, contracts: Column, price: Column, rate: Column, fee_type: Column) -> Column:
    """The fee of an order that takes liquidity; platforms without a schedule charge none."""
    return (
        F.when((platform == "kalshi") & (fee_type == "flat"), flat_fee(contracts, rate))
        .when(platform == "kalshi", cent_fee(contracts, price, rate))
        .when(platform == "polymarket", fine_fee(contracts, price, rate))
        .otherwise(dec(0))
    )


def maker_fee(contracts: Column, price: Column, rate: Column | None = None) -> Column:
    return cent_fee(contracts, price, dec(MAKER_RATE, RATE) if rate is None else rate)


def fee_per_contract(platform: Column, contracts: Column, price: Column, rate: Column, fee_type: Column) -> Column:
    fee = taker_fee(platform, contracts, price, rate, fee_type)
    return F.when(contracts <= 0, dec(0)).otherwise(safe_div(fee, contracts.cast(SIZE)).cast("decimal(28,14)"))


def rounding_cost(platform: Column, contracts: Column, price: Column, rate: Column, fee_type: Column) -> Column:
    """What rounding adds to the fee of a contract; flat fees and other platforms have none."""
    extra = taker_fee(platform, contracts, price, rate, fee_type).cast("decimal(36,18)") - quadratic(contracts, price, rate)
    charged = platform.isin("kalshi", "polymarket") & ~((platform == "kalshi") & (fee_type == "flat")) & (contracts > 0)
    return F.when(charged, safe_div(extra.cast("decimal(24,16)"), contracts.cast(SIZE)).cast("decimal(28,14)")).otherwise(dec(0))


def unit_fee(platform: Column, contracts: Column, price: Column, rate: Column, fee_type: Column) -> Column:
    """The fee of a contract without what rounding adds: rate * price * (1 - price), or a flat fee's share."""
    flat = (platform == "kalshi") & (fee_type == "flat")
    whole = quadratic(F.lit(1), price, rate).cast("decimal(28,14)")
    return F.when(flat, fee_per_contract(platform, contracts, price, rate, fee_type)).when(platform.isin("kalshi", "polymarket"), whole).otherwise(dec(0))


def settlement_fee() -> Column:
    """Neither venue charges for settlement."""
    return dec(0)
