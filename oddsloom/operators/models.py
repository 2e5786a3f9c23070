"""Models of single categories, guards on what a model may say, and research evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import clamp_prob
from ..functions.special import gbm_above, with_gbm_touch
from .latest import as_of, nearest

#: Words that name an asset, and its product.
PRODUCTS = (
    (r"\bbitcoin\b|\bbtc\b", "BTC-USD"), (r"\bethereum\b|\beth\b", "ETH-USD"), (r"\bsolana\b|\bsol\b", "SOL-USD"), (r"\bripple\b|\bxrp\b", "XRP-USD"), (r"\bdogecoin\b|\bdoge\b", "DOGE-USD"),
    (r"\bcardano\b|\bada\b", "ADA-USD"), (r"\blitecoin\b|\bltc\b", "LTC-USD"), (r"\bchainlink\b|\blink\b", "LINK-USD"), (r"\bavalanche\b|\bavax\b", "AVAX-USD"),
)
#: Patterns that name an index, its cash symbol and that of its futures.
INDEXES = (
    (r"\bs&p\s*500\b|\bsp500\b|\bspx\b|\bs and p 500\b", "^GSPC", "ES=F"),
    (r"\bnasdaq[\s-]*100\b|\bndx\b", "^NDX", "NQ=F"),
    (r"\bdow\s*(jones)?\b|\bdjia\b", "^DJI", "YM=F"),
    (r"\brussell\s*2000\b|\brut\b", "^RUT", "RTY=F"),
    (r"\bvix\b|\bvolatility index\b", "^VIX", None),
)
#: Phrases of contracts without a threshold, of contracts that pay on a touch, and of those that pay below.
DIRECTIONAL = r"\bup or down\b|\bhigher or lower\b|\bup / down\b|\bclose higher\b|\bclose lower\b|\bgreen or red\b"
BARRIER = r"\bdip(s|ped)?\s+to\b|\breach(es|ed)?\b|\bhit(s)?\b|\btouch(es|ed)?\b|\bat any (time|point)\b|\bever\b|\bintraday\b"
BELOW = r"\bbelow\b|\bunder\b|\bless than\b|\bat or below\b"
#: Strikes read from a text count between these multiples of the price; the most confidence; hours without decay.
LEAST_RATIO, MOST_RATIO, CONFIDENCE, SURE_HOURS = 0.02, 50.0, 0.68, 48.0
#: The farthest that a futures bar may be from the close it stands for, the greatest move that is believed, and the bars that there must be in so many days.
ANCHOR_SECONDS, MOST_MOVE, LEAST_BARS, ANCHOR_DAYS = 7200, 0.08, 4, 5
#: Models that can tell what they would have said in the past.
WITH_PAST = ("crypto_gbm_threshold", "sports_base_rate", "cpi_nowcast_bucket")
#: The tails in which a price is drawn to its end, and the model's confidence.
TAIL_LOW, TAIL_HIGH, TAIL_PULL, TAIL_CONFIDENCE = 0.02, 0.98, 0.9, 0.4
#: Categories for which no source is wired up.
UNSOURCED = {"politics": "politics_unsourced", "geopolitics": "politics_unsourced", "culture": "generic_unsourced", "tech": "generic_unsourced", "mentions": "generic_unsourced", "other": "generic_unsourced"}


def product(text: Column) -> Column:
    """The product whose asset a text names; null if none."""
    low = F.lower(text)
    return reduce(lambda o, row: o.when(low.rlike(row[0]), row[1]), PRODUCTS[1:], F.when(low.rlike(PRODUCTS[0][0]), PRODUCTS[0][1]))


def crypto(markets: DataFrame) -> DataFrame:
    """Opinions on thresholds, bands and touches of crypto prices: market_id, reason (why there is none), probability, confidence, stdev.

    ``markets`` has market_id, title, strike_type, floor, cap (null where the venue gives none), spot,
    vol, n_returns and years.  The deviation comes from the volatility's own error: the model is asked
    at a standard error below and above it.
    """
    title = F.col("title")
    low = F.lower(title)
    numbers = T.thresholds(title)
    kind = F.when((F.col("strike_type") == "between") | (T.comparator(title) == "between"), "between").otherwise(F.coalesce("strike_type", F.lit("")))
    rows = markets.withColumn("kind", kind).withColumn("venue", F.col("floor").isNotNull() | F.col("cap").isNotNull())
    rows = rows.withColumn("lower", F.when(F.col("kind") == "between", F.coalesce("floor", F.get(numbers, F.lit(0)))).otherwise(F.coalesce("floor", "cap", F.get(numbers, F.lit(0)))))
    rows = rows.withColumn("upper", F.when(F.col("kind") == "between", F.coalesce("cap", F.get(numbers, F.lit(1)))))
    odd = lambda x: ~F.coalesce((x / F.col("spot")).between(LEAST_RATIO, MOST_RATIO), F.lit(True))
    reason = (
        F.when(product(title).isNull(), "no_asset")
        .when(low.rlike(DIRECTIONAL), "directional")
        .when((F.col("kind") == "between") & (F.col("lower").isNull() | F.col("upper").isNull()), "missing_bound")
        .when((F.col("kind") == "between") & (F.col("upper") <= F.col("lower")), "unordered_bounds")
        .when(F.col("lower").isNull() | (F.col("lower") <= 0), "no_strike")
        .when(F.col("years") <= 0, "no_time")
        .when(F.col("spot").isNull() | F.col("vol").isNull(), "no_data")
        .when(~F.col("venue") & (odd(F.col("lower")) | odd(F.col("upper"))), "implausible_strike")
    )
    rows = rows.withColumn("reason", reason).withColumn("below", F.startswith(F.col("kind"), F.lit("less")) | (~F.col("kind").isin("greater", "between") & low.rlike(BELOW))).withColumn("barrier", low.rlike(BARRIER) & (F.col("kind") != "between"))
    se = F.col("vol") / F.sqrt(2.0 * F.col("n_returns"))
    asked = rows.withColumn("v", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("vol").alias("vol")), F.struct(F.lit(1).alias("i"), F.greatest(F.col("vol") - se, F.lit(1e-6)).alias("vol")), F.struct(F.lit(2).alias("i"), (F.col("vol") + se).alias("vol")))))
    asked = asked.withColumn("i", F.col("v.i")).withColumn("sigma", F.col("v.vol"))
    spot, vol, years = F.col("spot"), F.col("sigma"), F.col("years")
    asked = with_gbm_touch(asked, "touch", spot, F.col("lower"), vol, years)
    asked = asked.withColumn("over", gbm_above(spot, F.col("lower"), vol, years)).withColumn("over_upper", gbm_above(spot, F.col("upper"), vol, years))
    p = F.when(F.col("barrier"), F.col("touch")).when(F.col("kind") == "between", F.greatest(F.col("over") - F.col("over_upper"), F.lit(0.0))).when(F.col("below"), 1 - F.col("over")).otherwise(F.col("over"))
    asked = asked.withColumn("p", F.when(F.col("reason").isNull(), p))
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("p")))
    out = asked.groupBy("market_id").agg(F.max("reason").alias("reason"), at(0).alias("p"), F.abs(at(2) - at(1)).alias("spread"), F.max("years").alias("years"))
    hours = F.col("years") * 24 * 365.25
    decay = F.when(hours <= SURE_HOURS, 1.0).otherwise(F.greatest(SURE_HOURS / hours, F.lit(0.35)))
    sure = F.when((F.col("p") < 0.02) | (F.col("p") > 0.98), 0.5).otherwise(1.0)
    return out.select("market_id", "reason", clamp_prob(F.col("p")).alias("probability"), F.when(F.col("p").isNotNull(), CONFIDENCE * decay * sure).alias("confidence"), F.when(F.col("p").isNotNull(), F.greatest(F.col("spread") / 2, F.lit(0.01))).alias("stdev"))


def index_of(text: Column) -> Column:
    """The index that a text names, as its cash and futures symbols; null if none."""
    low = F.lower(text)
    row = lambda x: F.struct(F.lit(x[1]).alias("cash"), F.lit(x[2]).cast("string").alias("futures"))
    return reduce(lambda o, x: o.when(low.rlike(x[0]), row(x)), INDEXES[1:], F.when(low.rlike(INDEXES[0][0]), row(INDEXES[0])))


def futures_anchor(asked: DataFrame, bars: DataFrame) -> DataFrame:
    """The cash level that futures imply after the close: the columns of ``asked`` with move, implied and reason (why there is none).

    ``asked`` has symbol (of the futures), spot (the cash close), closed and now (seconds); ``bars`` has symbol, ts (seconds) and
    close.  The move is that of the futures between the bar nearest to the close and the last one up to now, so neither
    carry nor a roll matters.  Reasons: no_futures, few_bars, no_anchor (none near the close, or none after it), implausible.
    """
    bars = bars.where((F.col("close") > 0) & F.col("ts").isNotNull()).select("symbol", F.col("ts").cast("double").alias("ts"), F.col("close").cast("double").alias("close"))
    # How many bars there are up to a bar tells how many are in the days before now.
    bars = bars.groupBy("symbol", "ts").agg(F.max("close").alias("close"), F.count("*").alias("n"))
    seen = bars.withColumn("seen", F.sum("n").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))).withColumn("tie", F.lit(0))
    rows = asked.withColumn("__since", F.col("now") - ANCHOR_DAYS * 86400)
    rows = as_of(rows, seen.withColumnRenamed("ts", "last_ts").withColumnRenamed("close", "last_close").withColumnRenamed("seen", "seen_now"), "symbol", "now", "last_ts", ["last_ts", "last_close", "seen_now"], "tie")
    rows = as_of(rows, seen.withColumnRenamed("ts", "old_ts").withColumnRenamed("seen", "seen_before"), "symbol", "__since", "old_ts", ["seen_before"], "tie", strict=True)
    anchors = bars.withColumnRenamed("ts", "anchor_ts").withColumnRenamed("close", "anchor_close")
    rows = nearest(rows, anchors, "symbol", "closed", "anchor_ts", ["anchor_close"], ANCHOR_SECONDS, until="now")
    n = F.coalesce("seen_now", F.lit(0)) - F.coalesce("seen_before", F.lit(0))
    move = F.col("last_close") / F.col("anchor_close") - 1
    reason = (
        F.when(F.col("symbol").isNull(), "no_futures")
        .when(n < LEAST_BARS, "few_bars")
        .when(F.col("anchor_ts").isNull() | (F.col("anchor_ts") < F.col("__since")) | (F.col("last_ts") <= F.col("anchor_ts")), "no_anchor")
        .when(F.abs(move) > MOST_MOVE, "implausible")
    )
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return rows.select(*asked.columns, F.when(ok, move).alias("move"), F.when(ok, F.col("spot") * (1 + move)).alias("implied"), "reason")


def longest_named(text: Column, names: list[str]) -> Column:
    """The longest of ``names`` (stations, teams) that a text holds, so that a city is not taken for its district; null if none."""
    low = F.lower(text)
    first, *rest = sorted(names, key=lambda n: (-len(n), n))
    return reduce(lambda o, n: o.when(F.contains(low, F.lit(n)), n), rest, F.when(F.contains(low, F.lit(first)), first))


def tail_anchor(price: Column) -> Column:
    """A price in the extreme tails, drawn on towards its end; null within [0.02, 0.98]."""
    return F.when(price < TAIL_LOW, clamp_prob(price * TAIL_PULL)).when(price > TAIL_HIGH, clamp_prob(1 - (1 - price) * TAIL_PULL))


def allowed(component: Column, as_of: Column) -> Column:
    """Whether a model may answer: asked about the past, only those that can tell what they would have said."""
    return as_of.isNull() | component.isin(*WITH_PAST)


def evidence_quality(sources: DataFrame, key: str) -> DataFrame:
    """Quality of research evidence, by key: ``sources`` has quality and is_novel.

    The best novel source counts, the more so if up to three are novel; without a novel one, a quarter at most.
    """
    g = sources.groupBy(key).agg(F.count(F.when(F.col("is_novel"), 1)).alias("n_novel"), F.max(F.when(F.col("is_novel"), F.col("quality"))).alias("best"), F.max("quality").alias("any_best"))
    novel = F.least(F.lit(1.0), F.col("best") * (0.7 + 0.3 * F.least(F.col("n_novel") / 3, F.lit(1.0))))
    return g.select(key, "n_novel", F.when(F.col("n_novel") > 0, novel).otherwise(F.least(F.lit(0.25), F.col("any_best"))).alias("quality"))


def research_confidence(own: Column, quality: Column) -> Column:
    """Confidence in a research agent's estimate: what it says of itself times its evidence, 0.35 at most."""
    return F.least(F.lit(0.35), own * quality)


def explanation(components: DataFrame, key: str, n: int = 3) -> DataFrame:
    """A line for each key with its n most trusted components: ``components`` has component, probability and confidence."""
    rows = components.where("probability IS NOT NULL AND confidence > 0")
    said = F.concat(F.col("component"), F.lit(" "), F.format_number(F.col("probability"), 3))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), F.col("component"), said.alias("said")))), 1, n)
    return rows.groupBy(key).agg(F.array_join(F.transform(best, lambda x: x["said"]), "; ").alias("explanation"))
