"""Venue payloads as tables: markets, books, trades, candles and resolutions, from JSON text.

Each function takes a DataFrame with the payload in a string column and returns typed columns; text
that is not valid gives nulls, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import PRICE, exact, usd
from ..functions.timeops import parse_moment

#: Fragments of category names, first match wins.
CATEGORIES = (
    ("science and technology", "tech"), ("climate and weather", "weather"), ("transportation", "other"), ("entertainment", "culture"), ("technology", "tech"), ("financials", "finance"),
    ("economics", "economics"), ("elections", "politics"), ("companies", "finance"), ("politics", "politics"), ("climate", "weather"), ("weather", "weather"), ("culture", "culture"),
    ("finance", "finance"), ("health", "other"), ("crypto", "crypto"), ("sports", "sports"), ("world", "geopolitics"),
)
#: Fee rates of a category where a market has no schedule.
FALLBACK_RATES = {"crypto": "0.07", "finance": "0.04", "politics": "0.04", "mentions": "0.04", "tech": "0.04", "geopolitics": "0"}
STATUSES = {"active": "open", "open": "open", "initialized": "paused", "inactive": "paused", "paused": "paused", "closed": "closed", "determined": "closed", "settled": "settled", "finalized": "settled"}
RANGES = "array<struct<start:string,end:string,step:string>>"
KALSHI = f"""ticker string, event_ticker string, title string, subtitle string, yes_sub_title string, rules_primary string, rules_secondary string, status string, result string, market_type string,
    strike_type string, floor_strike string, cap_strike string, open_time string, close_time string, expiration_time string, expected_expiration_time string, occurrence_datetime string, updated_time string,
    yes_bid_dollars string, yes_ask_dollars string, no_bid_dollars string, no_ask_dollars string, yes_ask_size_fp string, last_price_dollars string, liquidity_dollars string, volume_fp string,
    volume_24h_fp string, open_interest_fp string, price_level_structure string, price_ranges {RANGES}, settlement_value_dollars string, settled_time string"""
POLYMARKET = """id string, question string, title string, conditionId string, description string, resolutionSource string, outcomes string, outcomePrices string, clobTokenIds string, umaResolutionStatuses string,
    startDate string, endDate string, updatedAt string, closed boolean, active boolean, acceptingOrders boolean, negRisk boolean, feesEnabled boolean, feeType string, feeSchedule struct<rate:string>,
    bestBid string, bestAsk string, spread string, lastTradePrice string, orderPriceMinTickSize string, orderMinSize string, volume string, volumeNum string, volume24hr string, liquidity string,
    liquidityNum string, groupItemTitle string, events array<struct<id:string,title:string>>"""


def category(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.when(F.contains(low, F.lit(CATEGORIES[0][0])), CATEGORIES[0][1])
    for fragment, value in CATEGORIES[1:]:
        out = out.when(F.contains(low, F.lit(fragment)), value)
    return out.otherwise("other")


def tick_size(ranges: Column, structure: Column) -> Column:
    """The least positive step, else a tenth of a cent where the structure says so, else a cent."""
    steps = F.filter(F.transform(ranges, lambda r: exact(r["step"], PRICE)), lambda s: s > 0)
    fallback = F.when(F.contains(F.coalesce(structure, F.lit("")), F.lit("deci_cent")), F.lit("0.001")).otherwise(F.lit("0.01")).cast(PRICE)
    return F.coalesce(F.array_min(steps), fallback)


def json_list(text: Column) -> Column:
    """An array that is written as JSON within a string."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def kalshi_markets(payloads: DataFrame, series: DataFrame | None = None, raw: str = "raw") -> DataFrame:
    """Markets from one JSON object a row; ``series`` has series_ticker, series_category, series_fee_type, series_multiplier."""
    m = payloads.select(F.from_json(raw, KALSHI).alias("m")).select("m.*").where(F.coalesce(F.col("ticker"), F.lit("")) != "")
    m = m.withColumn("series_ticker", F.split_part(F.coalesce("event_ticker", F.lit("")), F.lit("-"), F.lit(1)))
    if series is not None:
        m = m.join(series, "series_ticker", "left")
    else:
        m = m.withColumns({c: F.lit(None).cast("string") for c in ("series_category", "series_fee_type", "series_multiplier")})
    times = F.coalesce(exact(F.col("series_multiplier"), "decimal(8,6)"), F.lit(1).cast("decimal(8,6)"))
    fee_type = F.coalesce("series_fee_type", F.lit("quadratic"))
    ask = exact(F.col("yes_ask_dollars"), PRICE)
    # An ask of a dollar with nothing behind it is no ask.
    ask = F.when((ask >= 1) & (F.coalesce(exact(F.col("yes_ask_size_fp"), "decimal(18,4)"), F.lit(0)) == 0), F.lit(None)).otherwise(ask)
    bid = exact(F.col("yes_bid_dollars"), PRICE)
    status = F.lit("unknown")
    for name, value in STATUSES.items():
        status = F.when(F.lower("status") == name, value).otherwise(status)
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return m.select(
        F.lit("kalshi").alias("platform"),
        F.col("ticker").alias("market_id"),
        F.col("event_ticker").alias("event_id"),
        "series_ticker",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(blank("yes_sub_title"), blank("subtitle"), F.lit("")).alias("subtitle"),
        F.concat_ws("\n\n", blank("rules_primary"), blank("rules_secondary")).alias("rules"),
        category(F.col("series_category")).alias("category"),
        status.alias("status"),
        (status == "open").alias("accepting_orders"),
        blank("result").alias("result"),
        blank("strike_type").alias("strike_type"),
        exact(F.col("floor_strike"), "decimal(20,4)").alias("floor_strike"),
        exact(F.col("cap_strike"), "decimal(20,4)").alias("cap_strike"),
        tick_size(F.col("price_ranges"), F.col("price_level_structure")).alias("tick_size"),
        F.when(fee_type == "flat", times).otherwise((F.lit("0.07").cast("decimal(4,2)") * times).cast("decimal(8,6)")).alias("fee_rate"),
        F.when(fee_type == "quadratic_with_maker_fees", (F.lit("0.0175").cast("decimal(6,4)") * times).cast("decimal(8,6)")).otherwise(F.lit(0)).cast("decimal(8,6)").alias("maker_fee_rate"),
        fee_type.alias("fee_type"),
        bid.alias("yes_bid"),
        ask.alias("yes_ask"),
        exact(F.col("no_bid_dollars"), PRICE).alias("no_bid"),
        exact(F.col("no_ask_dollars"), PRICE).alias("no_ask"),
        (ask - bid).alias("spread"),
        exact(F.col("volume_24h_fp"), "decimal(20,4)").alias("volume_24h"),
        exact(F.col("last_price_dollars"), PRICE).alias("last_price"),
        parse_moment(F.col("close_time")).alias("close_time"),
        F.coalesce(parse_moment(F.col("expected_expiration_time")), parse_moment(F.col("expiration_time"))).alias("resolves"),
        parse_moment(F.col("occurrence_datetime")).alias("occurs"),
        parse_moment(F.col("updated_time")).alias("observed_at"),
    )


def kalshi_book(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """Levels of books that publish bids only: an ask is 1 less the other side's bid; what is not above 0 is dropped."""
    schema = "ticker string, orderbook_fp struct<yes_dollars:array<array<string>>,no_dollars:array<array<string>>>"
    b = payloads.select(F.from_json(raw, schema).alias("b")).select(F.col("b.ticker").alias("market_id"), "b.orderbook_fp.*")
    side = lambda name: b.select("market_id", F.lit(name).alias("side"), F.explode(f"{name}_dollars").alias("l")).select("market_id", "side", exact(F.col("l")[0], PRICE).alias("price"), exact(F.col("l")[1], "decimal(18,4)").alias("size"))
    bids = side("yes").unionByName(side("no"))
    other = F.when(F.col("side") == "yes", "no").otherwise("yes")
    asks = bids.select("market_id", other.alias("side"), F.lit(True).alias("is_ask"), (F.lit(1) - F.col("price")).cast(PRICE).alias("price"), "size")
    return bids.withColumn("is_ask", F.lit(False)).select(*asks.columns).unionByName(asks).where("price > 0 AND size > 0")


def polymarket_book(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """Levels of the books of two tokens; ``payloads`` has market_id and side; a missing side stays empty."""
    level = "array<struct<price:string,size:string>>"
    b = payloads.select("market_id", "side", F.from_json(raw, f"bids {level}, asks {level}").alias("b"))
    rows = lambda name, ask: b.select("market_id", "side", F.lit(ask).alias("is_ask"), F.explode(f"b.{name}").alias("l"))
    both = rows("bids", False).unionByName(rows("asks", True))
    return both.select("market_id", "side", "is_ask", exact(F.col("l.price"), PRICE).alias("price"), exact(F.col("l.size"), "decimal(18,4)").alias("size")).where("price > 0 AND size > 0")


def polymarket_markets(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """Markets from one JSON object a row; lists are JSON within strings, NO quotes are 1 less the YES quotes, and resolution follows the end by two hours, or two days where it was disputed."""
    m = payloads.select(F.from_json(raw, POLYMARKET).alias("m"), F.get_json_object(raw, "$.events[0].tags").alias("tags")).select("m.*", "tags").where(F.coalesce(F.col("id"), F.lit("")) != "")
    bid, ask = exact(F.col("bestBid"), PRICE), exact(F.col("bestAsk"), PRICE)
    disputes = json_list(F.col("umaResolutionStatuses"))
    kind = category(F.concat_ws(" ", F.col("tags"), F.col("question")))
    fallback = F.lit("0.05")
    for name, rate in FALLBACK_RATES.items():
        fallback = F.when(kind == name, rate).otherwise(fallback)
    rate = F.when(~F.col("feesEnabled"), F.lit("0")).otherwise(F.coalesce(F.col("feeSchedule.rate"), fallback))
    closed, end = F.coalesce("closed", F.lit(False)), parse_moment(F.col("endDate"))
    status = F.when(closed, F.when(F.size(disputes) > 0, "settled").otherwise("closed")).when(~F.coalesce("active", F.lit(True)), "paused").otherwise("open")
    hours = F.when(F.exists(disputes, lambda x: F.contains(F.lower(x), F.lit("dispute"))), 48).otherwise(2)
    tokens, outcomes = json_list(F.col("clobTokenIds")), json_list(F.col("outcomes"))
    last = F.coalesce(F.nullif(exact(F.col("lastTradePrice"), PRICE), F.lit(0)), exact(F.try_element_at(json_list(F.col("outcomePrices")), F.lit(1)), PRICE))
    return m.select(
        F.lit("polymarket").alias("platform"),
        F.col("id").alias("market_id"),
        F.try_element_at("events", F.lit(1))["id"].alias("event_id"),
        F.coalesce("question", "title", F.lit("")).alias("title"),
        F.coalesce("groupItemTitle", F.lit("")).alias("subtitle"),
        F.coalesce("description", F.lit("")).alias("rules"),
        kind.alias("category"),
        status.alias("status"),
        (F.coalesce("acceptingOrders", F.lit(True)) & ~closed).alias("accepting_orders"),
        F.when((F.size(outcomes) == 2) | (F.size(outcomes) == 0), "binary").otherwise("categorical").alias("market_type"),
        F.try_element_at(tokens, F.lit(1)).alias("yes_token"),
        F.try_element_at(tokens, F.lit(2)).alias("no_token"),
        F.coalesce(exact(F.col("orderPriceMinTickSize"), PRICE), F.lit("0.01").cast(PRICE)).alias("tick_size"),
        F.coalesce(exact(F.col("orderMinSize"), "decimal(18,4)"), F.lit(1)).alias("min_size"),
        exact(rate, "decimal(8,6)").alias("fee_rate"),
        F.coalesce("feeType", F.lit("general_fees")).alias("fee_type"),
        bid.alias("yes_bid"),
        ask.alias("yes_ask"),
        usd(F.lit(1) - ask).cast(PRICE).alias("no_bid"),
        usd(F.lit(1) - bid).cast(PRICE).alias("no_ask"),
        exact(F.col("spread"), PRICE).alias("spread"),
        exact(F.col("volume24hr"), "decimal(20,4)").alias("volume_24h"),
        last.alias("last_price"),
        end.alias("close_time"),
        F.timestamp_add("HOUR", hours, end).alias("resolves"),
        parse_moment(F.col("updatedAt")).alias("observed_at"),
        F.coalesce("negRisk", F.lit(False)).alias("negative_risk"),
    )


def kalshi_resolution(status: Column, result: Column, value: Column) -> Column:
    """The payout of YES: only final markets have one; the venue's value rules, else the result."""
    final = F.lower(status).isin("finalized", "settled")
    known = exact(value, PRICE)
    by_result = F.when(F.lower(result) == "yes", F.lit(1)).when(F.lower(result) == "no", F.lit(0)).cast(PRICE)
    return F.when(final, F.when(value.isNotNull(), known).otherwise(by_result))


def polymarket_resolution(p: Column) -> Column:
    """yes at 0.99 or more, no at 0.01 or less, split near one half, else null."""
    return F.when(p >= 0.99, "yes").when(p <= 0.01, "no").when(F.abs(p - 0.5) < 0.01, "fifty_fifty")


def candle_close(price_close: Column, price_mean: Column, bid_close: Column) -> Column:
    return F.coalesce(price_close, price_mean, bid_close)


def trades(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """Trade prints; a trade that is told twice is one."""
    schema = "trades array<struct<trade_id:string,ticker:string,count_fp:string,yes_price_dollars:string,created_time:string,taker_side:string>>"
    t = payloads.select(F.explode(F.from_json(raw, schema)["trades"]).alias("t")).select("t.*")
    out = t.select(F.col("trade_id"), F.col("ticker").alias("market_id"), exact(F.col("yes_price_dollars"), PRICE).alias("price"), exact(F.col("count_fp"), "decimal(18,4)").alias("size"), parse_moment(F.col("created_time")).alias("traded_at"), F.col("taker_side"))
    return out.dropDuplicates(["trade_id"])
