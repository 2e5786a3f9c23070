"""Probability models as expressions, and the pool that combines their opinions.

A model gives rows (market_id, component, probability, confidence, stdev, freshness); an opinion is a
row with a probability and a confidence over 0.  What a component may count as evidence for is a fixed
table, and that table rules, whatever a model says of itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp_prob
from ..functions.special import log_odds, logistic, normal_cdf

#: Component, source type, correlation group, reliability.
REGISTRY = (
    ("target_market_reference", "target_market_price", "target_venue_price", 0.9),
    ("extreme_price_sanity", "target_market_price", "target_venue_price", 0.5),
    ("sibling_coherence", "same_venue_price", "target_venue_price", 0.6),
    ("related_markets", "same_venue_price", "target_venue_price", 0.5),
    ("cross_platform_consensus", "cross_venue_price", "venue_price_complex", 0.7),
    ("research_agent", "research_evidence", "research_provider", 0.6),
    ("equity_index_gbm_threshold", "external_reference_data", "equity_market_data", 0.9),
    ("crypto_gbm_threshold", "external_reference_data", "crypto_spot_feed", 0.85),
    ("cpi_nowcast_bucket", "external_reference_data", "inflation_nowcast", 0.8),
    ("sports_base_rate", "historical_base_rate", "sports_results_feed", 0.35),
    ("weather_forecast_threshold", "external_reference_data", "weather_forecast", 0.85),
    ("time_to_resolution", "statistical_model", "structural_prior", 0.3),
)
#: Deviation of a forecast maximum in degrees Fahrenheit, by days of lead; more days are like the last.
FORECAST_SIGMA = (2.0, 2.8, 3.6, 4.4, 5.2, 6.0, 6.8, 7.5)
MARKET_SOURCES = ("target_market_price", "same_venue_price", "cross_venue_price")
#: Half the width of a two-sided 80 percent interval, in deviations.
Z80 = 1.2816


def registry(spark: SparkSession) -> DataFrame:
    rows = [(c, s, g, r, s not in MARKET_SOURCES) for c, s, g, r in REGISTRY]
    return spark.createDataFrame(rows, "component string, source_type string, correlation_group string, reliability double, independent boolean")


def risk_multiplier(groups: Column) -> Column:
    """How much few independent sources widen the interval."""
    return F.when(groups == 0, 3.0).when(groups == 1, 1.4).when(groups == 2, 1.15).otherwise(1.0)


def pooled(opinions: DataFrame, declarations: DataFrame | None = None) -> DataFrame:
    """The pool of each market's opinions; ``declarations`` say what a component counts for (:func:`registry` where None).

    Log-odds are averaged by confidence; the deviation adds what components state (in log-odds, at most
    3) to how far they are apart, grows with age, and is no less than what confidence allows.  Only
    components that never saw a market's price count as independent, and undeclared ones do not; an
    independent bound, shrunk by reliability, decides.  Two aggregates: means first, then distances
    from them.
    """
    # A row for each model.
    reg = F.broadcast(registry(opinions.sparkSession) if declarations is None else declarations)
    rows = opinions.where((F.col("probability").isNotNull()) & (F.col("confidence") > 0)).join(reg, "component", "left")
    rows = rows.withColumn("independent", F.coalesce("independent", F.lit(False))).withColumn("lo", log_odds(F.col("probability")))
    slope = F.greatest(F.col("probability") * (1 - F.col("probability")), F.lit(1e-4))
    stated = F.least(F.coalesce("stdev", F.lit(0.08)), F.sqrt(slope))
    rows = rows.withColumn("sigma", F.least(stated / slope, F.lit(3.0)))
    w, ind = F.col("confidence"), F.col("independent")
    first = rows.groupBy("market_id").agg(
        F.sum(w).alias("w"),
        F.sum(w * F.col("lo")).alias("wlo"),
        F.sum(w * F.col("sigma")).alias("wsigma"),
        F.sum(F.when(ind, w)).alias("iw"),
        F.sum(F.when(ind, w * F.col("lo"))).alias("iwlo"),
        F.count_distinct(F.when(ind, F.col("correlation_group"))).alias("groups"),
        F.max(F.when(ind, F.col("reliability"))).alias("reliability"),
        F.max("freshness").alias("age"),
        F.max(w).alias("best"),
        F.count("*").alias("n_components"),
    )
    first = first.withColumn("mean_lo", F.col("wlo") / F.col("w")).withColumn("mean", clamp_prob(logistic(F.col("mean_lo"))))
    far = rows.join(first.select("market_id", "mean_lo", "mean"), "market_id").groupBy("market_id").agg(
        F.sum(w * F.pow(F.col("lo") - F.col("mean_lo"), F.lit(2))).alias("dlo"), F.sum(w * F.pow(F.col("probability") - F.col("mean"), F.lit(2))).alias("dp")
    )
    out = first.join(far, "market_id").withColumn("dispersion", F.sqrt(F.col("dp") / F.col("w")))
    combined = F.col("best") + (1 - F.col("best")) * (1 - F.exp(-(F.col("w") - F.col("best"))))
    out = out.withColumn("model_confidence", F.round(clamp_prob(combined / (1 + F.col("dispersion") / 0.15)), 6))
    aged = F.when(F.col("age") > 3600, 1.3).when(F.col("age") > 900, 1.15).otherwise(1.0)
    sigma = (F.col("wsigma") / F.col("w") + F.sqrt(F.col("dlo") / F.col("w"))) * aged
    sigma = F.greatest(sigma, 1 - F.col("model_confidence"))
    has = F.col("iw") > 0
    out = out.withColumn("has_independent_prior", F.coalesce(has, F.lit(False)))
    out = out.withColumn("sigma", F.when(F.col("has_independent_prior"), sigma).otherwise(F.greatest(sigma, F.lit(2.0))))
    bound = lambda lo, s, sign: F.round(clamp_prob(logistic(lo + sign * Z80 * s)), 6)
    ilo = F.col("iwlo") / F.col("iw")
    wide = F.col("sigma") * risk_multiplier(F.col("groups"))
    late = F.when(F.col("age") > 3600, 0.02).otherwise(0.0)
    decision = lambda low: F.when(F.col("has_independent_prior"), F.round(F.least(F.greatest(low * F.col("reliability") - late, F.lit(0.0)), F.lit(1.0)) + 1e-9, 6))  # ties go up
    return out.select(
        "market_id",
        F.round(F.col("mean"), 6).alias("mean"),
        bound(F.col("mean_lo"), F.col("sigma"), -1).alias("low"),
        bound(F.col("mean_lo"), F.col("sigma"), 1).alias("high"),
        "model_confidence",
        "has_independent_prior",
        F.col("groups").alias("independent_sources"),
        F.round(clamp_prob(logistic(ilo)), 6).alias("independent"),
        decision(bound(ilo, wide, -1)).alias("decision_yes"),
        decision(1 - bound(ilo, wide, 1)).alias("decision_no"),
        "age",
        "n_components",
    )


def consensus(quotes: DataFrame) -> DataFrame:
    """The mean of other venues' prices for each (market_id, platform): quotes has market_id, platform, other_platform, price."""
    g = quotes.where(F.col("price").isNotNull() & (F.col("platform") != F.col("other_platform"))).groupBy("market_id").agg(F.avg("price").alias("mean"), F.stddev_pop("price").alias("sd"), F.count("*").alias("n"))
    spread = F.when(F.col("n") > 1, F.col("sd")).otherwise(0.02)
    base = F.least(F.lit(0.72), 0.45 + 0.12 * (F.col("n") - 1))
    return g.select("market_id", F.round(clamp_prob(F.col("mean")), 6).alias("probability"), F.round(F.when(F.round(spread, 9) > 0.08, base * 0.6).otherwise(base), 6).alias("confidence"), F.greatest(spread, F.lit(0.015)).alias("stdev"), "n")


def sibling_coherence(prices: DataFrame) -> DataFrame:
    """An outcome's share of the prices of its event, where all outcomes are priced and do not sum to 1.

    ``prices`` has event_id, market_id, price and outcome_count (null if unknown).
    """
    w = Window.partitionBy("event_id")
    rows = prices.withColumn("total", F.sum("price").over(w)).withColumn("n", F.count("price").over(w)).where("price IS NOT NULL")
    off = F.abs(1 - F.col("total"))
    confidence = F.round(0.45 * (1 - F.least(F.lit(1.0), off * 2)), 6)
    rows = rows.where((F.col("n") >= 3) & (F.col("outcome_count") > 0) & (F.col("n") >= F.col("outcome_count")) & (F.col("total") > 0) & (F.round(off, 9) >= 0.02) & (confidence > 0))
    return rows.select("market_id", F.round(clamp_prob(F.col("price") / F.col("total")), 6).alias("probability"), confidence.alias("confidence"), F.greatest(off / 2, F.lit(0.02)).alias("stdev"))


def usable(price: Column) -> Column:
    """A price strictly between 0 and 1."""
    return F.when((price > 0) & (price < 1), price)


def reference_price(bid: Column, ask: Column, last: Column) -> Column:
    """The middle, else the ask, else the bid, else the last trade; each only if usable."""
    b, a = usable(bid), usable(ask)
    return F.coalesce(F.round((a + b) / 2, 6), F.round(a, 6), F.round(b, 6), usable(last))


def reference_confidence(two_sided: Column, spread: Column, volume: Column, age: Column) -> Column:
    """Confidence in a market's own price: bands of spread, less for low volume and old quotes."""
    base = F.when(spread <= 0.01, 0.85).when(spread <= 0.03, 0.7).when(spread > 0.10, 0.35).otherwise(F.when(two_sided, 0.55).otherwise(0.4))
    base = base * F.when(F.coalesce(volume, F.lit(0)) < 1000, 0.7).otherwise(1.0) * F.when(age > 900, 0.6).otherwise(1.0)
    return F.round(F.least(F.lit(0.9), base), 6)


def related(n: Column) -> Column:
    """Confidence in the mean of n related markets."""
    return F.least(F.lit(0.3), 0.12 * n)


def realised_vol(candles: DataFrame, key: str, order: str, close: str, periods_a_year: float, least: int = 48) -> DataFrame:
    """Yearly volatility of log returns and its standard error; null for fewer than ``least`` candles."""
    w = Window.partitionBy(key).orderBy(order)
    r = F.log(F.col(close) / F.lag(close).over(w))
    g = candles.withColumn("__r", r).groupBy(key).agg(F.count("*").alias("n"), F.stddev_samp("__r").alias("sd"))
    vol = F.when(F.col("n") >= least, F.col("sd") * periods_a_year**0.5)
    return g.select(key, "n", vol.alias("vol"), (vol / F.sqrt(2.0 * (F.col("n") - 1))).alias("se"))


def ewma_variance(returns: Column, decay: float = 0.94, seed: int = 21) -> Column:
    """Exponentially weighted variance of an ordered array of returns, begun with the mean square of the first ones."""
    first = F.slice(returns, 1, seed)
    start = F.aggregate(first, F.lit(0.0), lambda s, x: s + x * x) / F.size(first)
    return F.aggregate(F.slice(returns, seed + 1, F.greatest(F.size(returns) - seed, F.lit(0))), start, lambda v, x: decay * v + (1 - decay) * x * x)


def ewma(returns: DataFrame, key: str, order: str, value: str, decay: float = 0.94, seed: int = 21) -> DataFrame:
    """The exponentially weighted deviation of each key's returns, as :func:`ewma_variance` defines it.

    Each return's weight follows from its place, so the returns are summed and no key's are held as an array.
    """
    w = Window.partitionBy(key)
    rows = returns.withColumn("__i", F.row_number().over(w.orderBy(order))).withColumn("__m", F.count("*").over(w))
    square, first = F.col(value) * F.col(value), F.col("__i") <= seed
    later = F.sum(F.when(~first, (1 - decay) * F.pow(F.lit(decay), F.col("__m") - F.col("__i")) * square))
    variance = F.avg(F.when(first, square)) * F.pow(F.lit(decay), F.greatest(F.max("__m") - seed, F.lit(0))) + F.coalesce(later, F.lit(0.0))
    return rows.groupBy(key).agg(F.sqrt(variance).alias("ewma"))


def gaussian_band(value: Column, sigma: Column, low: Column | None, high: Column | None) -> Column:
    """P(low <= X < high) for a normal forecast; a missing end is open."""
    upper = normal_cdf((high - value) / sigma) if high is not None else F.lit(1.0)
    lower = normal_cdf((low - value) / sigma) if low is not None else F.lit(0.0)
    return upper - lower


def forecast_sigma(lead_days: Column) -> Column:
    """The deviation of a forecast by its lead."""
    day = F.least(F.greatest(lead_days, F.lit(0)), F.lit(len(FORECAST_SIGMA) - 1)).cast("int")
    return F.element_at(F.array(*map(F.lit, FORECAST_SIGMA)), day + 1)


def weather(kind: Column, low: Column, high: Column, forecast: Column, sigma: Column) -> Column:
    """P of a maximum in whole degrees: within [low, high], below ``high`` (kind less), or above ``low``; half a degree is rounded away."""
    z = lambda x: normal_cdf((x - forecast) / sigma)
    return F.when(kind == "between", F.greatest(z(high + 0.5) - z(low - 0.5), F.lit(0.0))).when(F.startswith(kind, F.lit("less")), z(high - 0.5)).otherwise(1 - z(low + 0.5))


def weather_confidence(lead_days: Column, age_hours: Column, most: float = 0.75) -> Column:
    """Confidence in a forecast: less for each day of lead, and for one older than six hours."""
    return most * F.greatest(F.lit(0.3), 1 - 0.11 * lead_days) * F.when(age_hours > 6, 0.8).otherwise(1.0)


def log5(a: Column, b: Column) -> Column:
    """P(a beats b) from two win rates."""
    return (a - a * b) / (a + b - 2 * a * b)


def shrunk_rate(wins: Column, losses: Column, k: float = 8.0) -> Column:
    """A win rate drawn towards one half by k games."""
    return (wins + k / 2) / (wins + losses + k)


def home_edge(p: Column, edge: float) -> Column:
    return logistic(log_odds(p) + edge)


def forecast_errors(forecasts: DataFrame, least: int = 12) -> DataFrame:
    """Root mean square error by measure and lead bucket (days), where there are enough: RMS, not a deviation."""
    e = F.col("forecast") - F.col("actual")
    bucket = F.when(F.col("lead_days") <= 3, "0-3").when(F.col("lead_days") <= 10, "4-10").when(F.col("lead_days") <= 20, "11-20").otherwise("21+")
    return forecasts.withColumn("bucket", bucket).groupBy("measure", "bucket").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rms")).where(F.col("n") >= least)

