"""Scores of forecasts and of bets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp_prob


def brier(p: Column, y: Column) -> Column:
    """Aggregate: mean squared error; null probabilities do not count."""
    d = p.cast("double") - y.cast("double")
    return F.avg(d * d)


def log_loss(p: Column, y: Column) -> Column:
    """Aggregate: mean log loss of clamped probabilities."""
    q, y = clamp_prob(p), y.cast("double")
    return F.avg(F.when(p.isNotNull(), -(y * F.log(q) + (1 - y) * F.log(1 - q))))


def calibration_curve(df: DataFrame, p: str, y: str, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Observed frequency and mean forecast of each bin; the last bin holds 1."""
    index = F.least(F.lit(bins - 1), F.floor(F.col(p).cast("double") * bins)).cast("int")
    rows = df.where(F.col(p).isNotNull()).withColumn("bin", index)
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(F.col(p).cast("double")).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("frequency"))


def drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], pnl: str) -> DataFrame:
    """The deepest fall of running profit below its peak, which starts at 0.

    A range of bets is summed up by its total, its highest and lowest running profit and its deepest fall, and two
    adjoining ranges by one such row.  A range is a value of the first column of ``order`` (a day), so bets are only
    sorted within it, and a key's ranges, one row for each, are put together in their order.
    """
    at, *rest = order
    span = [*keys, at]
    w = Window.partitionBy(*span)
    if rest:
        run = df.withColumn("__run", F.sum(pnl).over(w.orderBy(*rest).rowsBetween(Window.unboundedPreceding, 0)))
        peak = F.greatest(F.max("__run").over(w.orderBy(*rest).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        rows = run.withColumn("__fall", F.col("__run") - peak).groupBy(*span).agg(F.sum(pnl).alias("total"), F.max("__run").alias("high"), F.min("__run").alias("low"), F.min("__fall").alias("fall"))
    else:  # one bet a range
        rows = df.groupBy(*span).agg(F.sum(pnl).alias("total")).select(*span, "total", F.col("total").alias("high"), F.col("total").alias("low"), F.least("total", F.lit(0)).alias("fall"))
    earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    rows = rows.withColumn("peak", F.greatest(F.max(F.col("start") + F.col("high")).over(earlier), F.lit(0)))
    fall = F.least("fall", F.col("start") + F.col("low") - F.col("peak"))
    return rows.groupBy(*keys).agg(F.least(F.min(fall), F.lit(0)).alias("max_drawdown"))


def profit_factor(pnl: Column) -> Column:
    """Aggregate: gains over losses; null without losses."""
    gains, losses = F.sum(F.when(pnl > 0, pnl).otherwise(0)), -F.sum(F.when(pnl < 0, pnl).otherwise(0))
    return F.when(losses > 0, gains.cast("double") / losses.cast("double"))


def sharpe_like(pnl: Column, stake: Column) -> Column:
    """Aggregate: mean over deviation of profit per stake; null for fewer than two bets or no spread."""
    r = F.when(stake > 0, pnl.cast("double") / stake.cast("double"))
    sd = F.stddev_samp(r)
    return F.when((F.count(r) >= 2) & (sd > 0), F.avg(r) / sd)


def summary() -> dict[str, Column]:
    """Aggregates over bets with pnl, stake, payout, p_side, market_p and outcome."""
    pnl, stake, y = F.col("pnl"), F.col("stake"), F.col("outcome")
    model, market = brier(F.col("p_side"), y), brier(F.col("market_p"), y)
    return {
        "n_settled": F.count("*"),
        "wins": F.count(F.when(pnl > 0, 1)),
        "win_rate": F.round(F.avg((pnl > 0).cast("int")), 4),
        "avg_p": F.round(F.avg("p_side"), 4).cast("double"),
        "total_stake": F.round(F.sum(stake).cast("double"), 4),
        "total_pnl": F.round(F.sum(pnl).cast("double"), 4),
        "roi": F.when(F.sum(stake) > 0, F.round(F.sum(pnl).cast("double") / F.sum(stake).cast("double"), 4)),
        "profit_factor": F.round(profit_factor(pnl), 5),
        "sharpe": F.round(sharpe_like(pnl, stake), 5),
        "brier": F.round(model, 5),
        "market_brier": F.round(market, 5),
        "log_loss": F.round(log_loss(F.col("p_side"), y), 5),
        "improvement": F.round(market - model + 1e-9, 5),  # ties go up, whatever the order of the sums
    }


def paired(df: DataFrame, keys: Sequence[str], model: str, market: str, y: str) -> DataFrame:
    """Paired difference of squared errors (market - model) by segment: n, mean, standard error, t, and whether |t| > 2."""
    d = F.pow(F.col(market).cast("double") - F.col(y).cast("double"), F.lit(2)) - F.pow(F.col(model).cast("double") - F.col(y).cast("double"), F.lit(2))
    out = df.where(F.col(model).isNotNull() & F.col(market).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("difference"), F.stddev_samp(d).alias("__sd"))
    out = out.withColumn("se", F.when(F.col("n") > 1, F.col("__sd") / F.sqrt("n"))).withColumn("t", F.when(F.col("se") > 0, F.col("difference") / F.col("se")))
    return out.withColumn("significant", F.coalesce(F.abs("t") > 2, F.lit(False))).drop("__sd")
