"""All-in cost of a contract at a size, and expected value against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import MONEY, PRICE, SIZE, dec, safe_div, usd
from ..functions.timeops import years_until
from . import fees

#: Configuration: cost of capital a year, one transfer, ticks lost to latency, and the share of Kelly's stake.
CAPITAL_RATE, TRANSFER_USD, SLIPPAGE_TICKS, KELLY_FRACTION = "0.05", "0.50", 1, "0.25"
#: Sizes at which a cost ladder is measured.
LADDER_SIZES = (1, 5, 10, 25, 50, 100, 250, 500, 1000)
#: Quotes older than this many seconds are stale.
STALE_SECONDS = 1800


def capital_cost(price: Column, resolves: Column, now: Column, rate: str = CAPITAL_RATE) -> Column:
    """Interest on a price until resolution, to four places."""
    years = F.round(years_until(resolves, now), 10).cast("decimal(16,10)")
    return usd(price.cast("decimal(7,4)") * dec(rate, "decimal(6,4)") * years).cast(MONEY)


def transfer_cost(platform: Column, contracts: Column, usd_each: str = TRANSFER_USD) -> Column:
    """A share of one transfer for each contract, where the platform needs one."""
    return F.when((platform == "polymarket") & (contracts > 0), usd(safe_div(dec(usd_each, "decimal(8,4)"), contracts.cast(SIZE))).cast(MONEY)).otherwise(dec(0))


def breakdown(quotes: DataFrame, now: Column, execution_risk: Column | None = None) -> DataFrame:
    """Adds the cost of a contract to walked quotes, each part to four places, and their sum.

    ``quotes`` has platform, filled, average, fee_rate, fee_type, tick_size and resolves.  Impact on the
    book is in the average already; slippage is what latency may lose.
    """
    args = (F.col("platform"), F.col("filled").cast(SIZE), F.col("average"), F.col("fee_rate"), F.col("fee_type"))
    rounding = fees.rounding_cost(*args)
    parts = {
        "entry_price": F.col("average").cast(MONEY),
        "platform_fee": usd(fees.unit_fee(*args)).cast(MONEY),
        "fee_rounding": usd(rounding).cast(MONEY),
        "slippage": usd(F.col("tick_size") * SLIPPAGE_TICKS).cast(MONEY),
        "transfer_cost": transfer_cost(F.col("platform"), F.col("filled")),
        "capital_cost": capital_cost(F.col("average"), F.col("resolves"), now),
        "execution_risk": usd(execution_risk).cast(MONEY) if execution_risk is not None else dec(0),
    }
    out = quotes.withColumns(parts)
    total = sum((F.col(name) for name in list(parts)[1:]), F.col("entry_price"))
    return out.withColumn("total_cost", total.cast(MONEY))


def gross_profit(win: Column, entry: Column) -> Column:
    return usd(win - entry)


def net_ev(win: Column, cost: Column) -> Column:
    return usd(win - cost)


def net_roi(win: Column, cost: Column) -> Column:
    return F.when(cost <= 0, F.lit(0)).otherwise(usd(safe_div((win - cost).cast("decimal(12,8)"), cost.cast("decimal(12,8)"))))


def kelly(win: Column, cost: Column, fraction: str = KELLY_FRACTION) -> Column:
    """A fraction of Kelly's stake; nothing without an edge or for a cost outside (0, 1)."""
    edge = (win - cost).cast("decimal(12,8)")
    full = safe_div(edge, (F.lit(1) - cost).cast("decimal(12,8)"))
    return F.when((cost <= 0) | (cost >= 1) | (edge <= 0), F.lit(0)).otherwise(usd(F.greatest(full * dec(fraction, "decimal(6,4)"), F.lit(0))))


def profit_per_100(ev: Column, cost: Column) -> Column:
    return F.when(cost <= 0, F.lit(0)).otherwise(usd(ev.cast("decimal(12,8)") * safe_div(F.lit(100).cast("decimal(12,8)"), cost.cast("decimal(12,8)"))))


def measured(quotes: DataFrame, now: Column) -> DataFrame:
    """The cost ladder's figures: all parts but slippage, against the price that is shown.

    Adds measured (a contract), premium (over ``nominal``), ratio (measured / nominal), outlay and
    breakeven (the probability to break even, where the cost is within (0, 1)).
    """
    out = breakdown(quotes, now)
    cost = F.col("entry_price") + F.col("platform_fee") + F.col("fee_rounding") + F.col("transfer_cost") + F.col("capital_cost")
    out = out.withColumn("measured", usd(cost).cast(MONEY)).withColumn("premium", (F.col("measured") - F.col("nominal")).cast(MONEY))
    out = out.withColumn("ratio", usd(safe_div(F.col("premium").cast("decimal(12,8)"), F.col("nominal").cast(PRICE))))
    out = out.withColumn("outlay", usd(F.col("measured").cast("decimal(14,8)") * F.col("filled").cast(SIZE)))
    return out.withColumn("breakeven", F.when((F.col("measured") > 0) & (F.col("measured") < 1), F.col("measured")))


def stale(age_seconds: Column, limit: float = STALE_SECONDS) -> Column:
    return age_seconds > limit


def caveats() -> Column:
    """What a reader of a cost must know, as codes, from source, age, platform, min_size and resolves."""
    c = F.col
    tests = [
        (c("source") != "orderbook", "depth_unknown"),
        (stale(c("age")), "stale_quote"),
        (c("platform") == "kalshi", "fee_rounds_up_on_the_order"),
        (c("platform") == "polymarket", "transfer_is_shared"),
        (c("min_size") > 1, "minimum_order"),
        (c("resolves").isNotNull(), "capital_is_locked_up"),
        (F.lit(True), "slippage_is_assumed"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), code) for test, code in tests)))


def max_profitable_size(ladders: DataFrame, now: Column, most: int = 5000, steps: int = 24) -> DataFrame:
    """The largest size worth buying: all of the ladder if that has an edge, else by bisection.

    ``ladders`` has ``asks`` (array of price and size, best first), win, min_size and the columns of
    :func:`breakdown`.  Adds cap_size (two places, half even) and cap_profit.  The bisection is a fold
    over a sequence of steps, so it stays within one expression for each row.
    """
    from .books import filled_at

    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  evaluates a value once

    def ev(size: Column) -> Column:
        def costed(f: Column) -> Column:
            args = (F.col("platform"), f["filled"], f["average"], F.col("fee_rate"), F.col("fee_type"))
            total = f["average"] + usd(fees.unit_fee(*args)) + usd(fees.rounding_cost(*args)) + usd(F.col("tick_size") * SLIPPAGE_TICKS) + transfer_cost(F.col("platform"), f["filled"]) + capital_cost(f["average"], F.col("resolves"), now)
            each = net_ev(F.col("win"), total.cast(MONEY)).cast("decimal(12,4)")
            return once(F.struct(each.alias("ev"), f["filled"].alias("filled")), lambda e: F.struct(e["ev"].alias("ev"), usd(e["ev"] * e["filled"]).cast("decimal(18,4)").alias("profit")))

        def averaged(f: Column) -> Column:
            return F.struct(f["filled"].cast(SIZE).alias("filled"), usd(safe_div(f["notional"], f["filled"])).cast(PRICE).alias("average"))

        return once(once(filled_at(F.col("asks"), size), averaged), costed)

    available = F.aggregate("asks", F.lit(0).cast("decimal(18,6)"), lambda s, x: (s + x["size"]).cast("decimal(18,6)"))
    high = F.least(available, F.lit(most)).cast("decimal(18,6)")
    low = F.when(F.col("min_size") > 0, F.col("min_size")).otherwise(F.lit(1)).cast("decimal(18,6)")

    def bisect(first: Column) -> Column:
        start = F.struct(low.alias("lo"), high.alias("hi"), low.alias("size"), first["profit"].alias("profit"))

        def step(s: Column, _: Column) -> Column:
            mid = ((s["lo"] + s["hi"]) / 2).cast("decimal(18,6)")

            def judged(e: Column) -> Column:
                better = (e["ev"] > 0) & (e["profit"] > s["profit"])
                return F.struct(F.when(e["ev"] > 0, mid).otherwise(s["lo"]).alias("lo"), F.when(e["ev"] > 0, s["hi"]).otherwise(mid).alias("hi"), F.when(better, mid).otherwise(s["size"]).alias("size"), F.when(better, e["profit"]).otherwise(s["profit"]).alias("profit"))

            return once(ev(mid), judged)

        end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
        return F.when(first["ev"] > 0, F.struct(F.bround(end["size"], 2).cast("decimal(18,2)").alias("size"), end["profit"].alias("profit"))).otherwise(nothing)

    nothing = F.struct(F.lit(0).cast("decimal(18,2)").alias("size"), F.lit(0).cast("decimal(18,4)").alias("profit"))
    whole = once(ev(high), lambda e: F.when(e["ev"] > 0, F.struct(high.cast("decimal(18,2)").alias("size"), e["profit"].alias("profit"))).otherwise(once(ev(low), bisect)))
    best = F.when(available > 0, whole).otherwise(nothing)
    return ladders.withColumn("__best", best).withColumn("cap_size", F.col("__best.size")).withColumn("cap_profit", F.col("__best.profit")).drop("__best")
