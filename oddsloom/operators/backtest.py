"""Settlement, and walk-forward backtests over frozen recommendations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_div, usd
from .cost import kelly

#: Data qualities from the worst to the best; a run is as good as its worst trade.
QUALITIES = ("unknown", "candle", "quote", "orderbook")
ALL_HORIZONS = ("24h", "7d", "30d")


@dataclass(frozen=True)
class Strategy:
    """Take the first ``top`` of each day, with a fixed stake, or with Kelly's where that is None."""

    name: str
    top: int
    stake: int | None = 10
    horizons: tuple[str, ...] = ALL_HORIZONS
    platforms: tuple[str, ...] = ("kalshi", "polymarket")
    min_confidence: str = "0"


STRATEGIES = (
    Strategy("top1_10usd", 1),
    Strategy("top3_equal_10usd", 3),
    Strategy("top10_equal_10usd", 10),
    Strategy("top10_equal_25usd", 10, 25),
    Strategy("top10_fractional_kelly", 10, None),
    Strategy("high_confidence_only", 10, min_confidence="0.5"),
    Strategy("resolves_within_24h", 10, horizons=("24h",)),
    Strategy("kalshi_only", 10, platforms=("kalshi",)),
    Strategy("polymarket_only", 10, platforms=("polymarket",)),
    Strategy("cross_platform_combined", 10),
)


def payout(result: Column, side: Column, cost: Column) -> Column:
    """What a contract pays on its side: a void market refunds the cost, an unknown result is null."""
    won = F.when(result == side, F.lit("1")).otherwise(F.lit("0")).cast("decimal(6,4)")
    half = F.lit("0.5").cast("decimal(6,4)")
    return F.when(result.isin("yes", "no"), won).when(result == "fifty_fifty", half).when(result == "void", cost)


def outcome(result: Column, side: Column) -> Column:
    """The value that a forecast of the side is scored against; half where there was no winner."""
    return F.when(result.isin("yes", "no"), (result == side).cast("double")).otherwise(0.5)


def graded(snapshots: DataFrame) -> DataFrame:
    """Adds payout, profit and profit per 100 of cost to settled recommendations."""
    paid = payout(F.col("result"), F.col("side"), F.col("cost"))
    out = snapshots.withColumn("payout", paid).withColumn("profit", usd(F.col("payout") - F.col("cost")))
    return out.withColumn("per_100", F.when(F.col("cost") > 0, usd(F.col("profit") * 100 / F.col("cost"))))


def state(settled: Column, closed: Column, ev_now: Column, ev_then: Column) -> Column:
    """What has become of a recommendation: settled, closed, no longer valuable, reduced (under half) or actionable."""
    return F.when(settled, "settled").when(closed, "closed").when(ev_now <= 0, "no_longer_valuable").when(ev_now < ev_then / 2, "reduced").otherwise("actionable")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= F.lit("0.7").cast("decimal(4,2)"), "high").when(confidence >= F.lit("0.4").cast("decimal(4,2)"), "medium").otherwise("low")


def strategy_table(spark: SparkSession, strategies=STRATEGIES) -> DataFrame:
    rows = [(s.name, s.top, s.stake, list(s.horizons), list(s.platforms), s.min_confidence) for s in strategies]
    return spark.createDataFrame(rows, "strategy string, top int, stake_usd int, horizons array<string>, platforms array<string>, min_confidence string")


def trades(snapshots: DataFrame, strategies=STRATEGIES, bankroll: int = 1000) -> DataFrame:
    """The trades of every strategy over settled recommendations, one provenance never mixed with another.

    ``snapshots`` has snapshot_id, day, rank, horizon, platform, side, cost, p_side, p_low, market_p,
    confidence, executable_size, result, provenance.  The strategies are a fixed table of a few rows,
    joined by broadcast; all of them are one plan.
    """
    s = F.broadcast(strategy_table(snapshots.sparkSession, strategies))
    rows = snapshots.where(F.col("result").isNotNull())
    fits = F.array_contains("horizons", F.col("horizon")) & F.array_contains("platforms", F.col("platform")) & (F.col("confidence") >= F.col("min_confidence").cast("decimal(6,4)"))
    rows = rows.join(s, fits)
    day = Window.partitionBy("provenance", "strategy", "day").orderBy("rank", "snapshot_id")
    rows = rows.withColumn("__n", F.row_number().over(day)).where(F.col("__n") <= F.col("top"))
    share = kelly(F.col("p_low"), F.col("cost")).cast("decimal(10,4)")
    stake = F.coalesce(F.col("stake_usd").cast("decimal(12,4)"), (share * bankroll).cast("decimal(12,4)"))
    contracts = safe_div(stake, F.col("cost").cast("decimal(8,4)")).cast("decimal(18,8)")
    contracts = F.when(F.col("executable_size") > 0, F.least(contracts, F.col("executable_size").cast("decimal(18,8)"))).otherwise(contracts)
    rows = rows.where(F.col("cost") > 0).withColumn("contracts", contracts)
    rows = rows.withColumn("stake", usd(F.col("contracts") * F.col("cost")).cast("decimal(18,4)")).where("contracts > 0 AND stake > 0")
    rows = rows.withColumn("paid", payout(F.col("result"), F.col("side"), F.col("cost")))
    rows = rows.withColumn("pnl", usd((F.col("paid") - F.col("cost")) * F.col("contracts")).cast("decimal(18,4)")).where("pnl IS NOT NULL")
    return rows.withColumn("outcome", outcome(F.col("result"), F.col("side"))).withColumn("band", confidence_band(F.col("confidence")))


def worst_quality(quality: Column) -> Column:
    """Aggregate: the worst data quality; unknown where there is none."""
    names = F.array(*map(F.lit, QUALITIES))
    return F.coalesce(F.element_at(names, F.min(F.array_position(names, quality)).cast("int")), F.lit("unknown"))


def admissible(observed: Column, published: Column) -> Column:
    """Whether evidence was known at publication, that moment included; evidence without a time was not."""
    return F.coalesce(observed <= published, F.lit(False))
