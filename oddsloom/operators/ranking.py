"""Value candidates: flags, score, gates, ranks, funnels, and the budget for order books."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Configuration of the gates.
TOP_N, MIN_EV, MIN_DEPTH, MAX_SPREAD, MIN_CONFIDENCE = 10, 0.005, 25, 0.15, 0.15
MIN_VOLUME, MAX_QUOTE_AGE = 500, 300


def risk_flags() -> Column:
    """The flags of a candidate row, in order."""
    c = F.col
    tests = [
        (~c("independent"), "no_independent_prior"),
        (c("confidence") < 0.3, "low_model_confidence"),
        (c("evidence") <= 0, "no_research_evidence"),
        (c("age") > MAX_QUOTE_AGE, "stale_quote"),
        (c("spread") > 0.05, "wide_spread"),
        (c("depth") < MIN_DEPTH, "thin_liquidity"),
        (F.coalesce(c("volume"), F.lit(0)) < MIN_VOLUME, "low_volume"),
        ((c("top") < 0.03) | (c("top") > 0.97), "extreme_price"),
        (c("hours") < 1, "imminent_settlement"),
        (c("occurred"), "event_already_occurred"),
        (c("early"), "settles_before_close"),
        (c("platform") == "polymarket", "uma_oracle_settlement"),
        (~c("open"), "not_accepting_orders"),
    ]
    named = [F.when(F.coalesce(t, F.lit(False)), name) for t, name in tests]
    named.append(F.when(c("provenance") != "live", F.concat(F.lit("provenance_"), c("provenance"))))
    return F.array_compact(F.array(*named))


def composite_score() -> Column:
    """Capacity profit, damped by liquidity, spread, confidence, age, horizon and flags; 0 without a conservative edge."""
    c = F.col
    capacity = F.log1p(F.greatest(c("conservative_ev") * F.least(c("size"), F.coalesce(F.nullif(c("cap"), F.lit(0)), c("size"))), F.lit(0.0)))
    liquidity = F.when(c("depth") > 0, c("depth") / (c("depth") + 500)).otherwise(0.0)
    spread = F.when(c("spread").isNull(), 0.5).otherwise(1 - F.least(F.lit(1.0), c("spread") / 0.10))
    fresh = F.when(F.coalesce(c("data_age"), F.lit(0)) > 0, 1 / (1 + c("data_age") / 3600 / 12)).otherwise(1.0)
    near = 1 / (1 + F.greatest(F.coalesce(F.nullif(c("hours"), F.lit(0)), F.lit(720.0)), F.lit(0.0)) / 168)
    penalty = F.lit(1.0)
    for flag, factor in (("no_independent_prior", 0.05), ("stale_quote", 0.3), ("thin_liquidity", 0.4), ("extreme_price", 0.5)):
        penalty = penalty * F.when(F.array_contains("flags", flag), factor).otherwise(1.0)
    score = capacity * (0.4 + 0.6 * liquidity) * (0.4 + 0.6 * spread) * (0.3 + 0.7 * c("confidence")) * fresh * (0.5 + 0.5 * near) * penalty
    return F.when(c("conservative_ev") <= 0, 0.0).otherwise(F.round(F.greatest(score, F.lit(0.0)), 4))


def gate() -> Column:
    """Why a candidate is refused: the first gate that it fails, or null."""
    c = F.col
    return (
        F.when(~c("independent"), "no_independent_prior")
        .when(c("conservative_ev") <= MIN_EV, "conservative_ev")
        .when(F.coalesce(c("depth"), F.lit(0)) < MIN_DEPTH, "depth")
        .when(c("spread") > MAX_SPREAD, "spread")
        .when(c("confidence") < MIN_CONFIDENCE, "confidence")
        .when(c("size") <= 0, "size")
        .when(c("occurred"), "event_already_occurred")
    )


def ranked(candidates: DataFrame, n: int = TOP_N) -> DataFrame:
    """The better side of each market, then the first n of each horizon; ties go to smaller keys."""
    ok = candidates.where(F.col("reason").isNull())
    side = Window.partitionBy("horizon", "market_id").orderBy(F.desc("score"), "side")
    best = ok.withColumn("__r", F.row_number().over(side)).where("__r = 1").drop("__r")
    top = Window.partitionBy("horizon").orderBy(F.desc("score"), "market_id")
    return best.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= n)


def funnel(candidates: DataFrame) -> DataFrame:
    """How many candidates are left after each gate, in one pass: stage and n."""
    order = ("no_independent_prior", "conservative_ev", "depth", "spread", "confidence", "size", "event_already_occurred")
    counts = candidates.agg(F.count("*").alias("all"), *(F.count(F.when(F.coalesce(F.col("reason").isin(*order[: i + 1]), F.lit(False)), 1)).alias(name) for i, name in enumerate(order)))
    stages = [F.struct(F.lit(0).alias("stage"), F.lit("all").alias("name"), F.col("all").alias("n"))]
    stages += [F.struct(F.lit(i + 1).alias("stage"), F.lit(f"after_{name}").alias("name"), (F.col("all") - F.col(name)).alias("n")) for i, name in enumerate(order)]
    return counts.select(F.explode(F.array(*stages)).alias("s")).select("s.*")


def disagreements(rows: DataFrame, least: float = 0.03, spread: float = 0.10) -> DataFrame:
    """Markets whose model and price are apart, where the price is tight enough to mean something."""
    gap = F.col("model_p") - F.col("market_p")
    return rows.withColumn("gap", gap).where((F.abs(F.round(gap, 9)) >= least) & (F.col("spread") <= spread))


def _placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], each: int, most: int) -> DataFrame:
    """The first ``most`` rows of a group among the first ``each`` of its series, with their place."""
    w = Window.partitionBy(*keys, "series").orderBy(*order)
    first = rows.withColumn("__s", F.row_number().over(w)).where(F.col("__s") <= each).drop("__s")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


class _Cycle:
    """The choices of one venue in one cycle: what is taken, and how much of it is of each series."""

    def __init__(self, cap: int):
        self.cap, self.taken, self.used = cap, set(), {}

    def take(self, members: list[tuple]) -> None:
        for market, series in members:
            if market not in self.taken:
                self.taken.add(market)
                self.used[series] = self.used.get(series, 0) + 1

    def pass_over(self, drivers: list[tuple], events: dict, budget: int) -> None:
        """Drivers in order; each brings its whole event where budget and series allow, or else comes alone."""
        for market, series, event in drivers:
            if len(self.taken) >= budget:
                return
            room = self.cap - self.used.get(series, 0)
            if market in self.taken or room <= 0:
                continue
            whole = events.get(event) if event is not None else [(market, series)]
            fits = whole is not None and len(whole) <= min(room, budget - len(self.taken))
            self.take(whole if fits else [(market, series)])


def book_budget(markets: DataFrame, budget: int, keys: Sequence[str] = ("platform",), reserve: float = 0.4, series_share: float = 0.2, series_least: int = 14, least_volume: float = MIN_VOLUME) -> DataFrame:
    """Markets whose books are fetched, at most ``budget`` for each venue: ``keys`` and market_id.

    ``markets`` has market_id, event_id, series (null: the event, or the market), open, accepting, modellable, horizon (1 to 3; null: none)
    and volume.  Only open markets that accept orders and trade at least ``least_volume`` are chosen for themselves.  A scoring
    pass takes those with a horizon by (modellable, horizon, volume) up to the budget less the ``reserve``; a coverage pass
    takes any by volume.  Each brings the open markets of its event where these fit, and none comes once its series has
    its share.  What is left goes to the scoring order, shares ignored.  Ties go to the smaller market_id.

    The loop is sequential, but what it can reach is bounded by the budget: in an order, only the first markets of a
    series up to its share can be chosen, and each step chooses, or meets a market that is chosen or whose series is
    full.  So three budgets of drivers suffice, and events no larger than a share.  Those are picked by windows that keep
    their first rows, and only they reach the task of a venue.
    """
    cap = max(series_least, int(budget * series_share))
    keys = list(keys)
    rows = markets.withColumn("series", F.coalesce(F.col("series").cast("string"), F.concat(F.lit("event:"), F.col("event_id").cast("string")), F.concat(F.lit("market:"), F.col("market_id").cast("string"))))
    rows = rows.withColumn("event_id", F.col("event_id").cast("string"))
    fair = rows.where(F.col("open") & F.col("accepting") & (F.coalesce(F.col("volume"), F.lit(0)) >= least_volume))
    columns = [*keys, "market_id", "series", "event_id"]
    modellable = F.when(F.col("modellable"), 0).otherwise(1)
    scoring = fair.where(F.col("horizon").isNotNull()).select(*columns, modellable.alias("m"), "horizon", (-F.col("volume")).alias("v"))
    by_score = ["m", "horizon", "v", "market_id"]
    by_volume = ["v", "market_id"]
    drivers = [
        _placed(scoring, keys, by_score, cap, 3 * budget).select(*columns, "place", F.lit(0).alias("step")),
        _placed(fair.select(*columns, (-F.col("volume")).alias("v")), keys, by_volume, cap, 3 * budget).select(*columns, "place", F.lit(1).alias("step")),
        scoring.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*by_score))).where(F.col("place") <= 2 * budget).select(*columns, "place", F.lit(2).alias("step")),
    ]
    asked = drivers[0].unionByName(drivers[1]).unionByName(drivers[2])
    # Events that could come whole, of the drivers only.
    members = rows.where(F.col("open") & F.col("event_id").isNotNull()).select(*columns)
    small = members.groupBy(*keys, "event_id").agg(F.count("*").alias("n")).where(F.col("n") <= min(cap, budget)).drop("n")
    small = small.join(asked.select(*keys, "event_id").distinct(), [*keys, "event_id"], "left_semi")
    siblings = members.join(small, [*keys, "event_id"], "left_semi").select(*columns, F.lit(0).alias("place"), F.lit(3).alias("step"))

    def choose(some: pd.DataFrame) -> pd.DataFrame:
        of = {step: list(part.sort_values("place")[["market_id", "series", "event_id"]].itertuples(index=False, name=None)) for step, part in some.groupby("step")}
        events: dict = {}
        for market, series, event in of.get(3, ()):
            events.setdefault(event, []).append((market, series))
        none = lambda x: None if pd.isna(x) else x
        steps = [[(m, s, none(e)) for m, s, e in of.get(i, ())] for i in range(3)]
        cycle, kept_back = _Cycle(cap), int(budget * reserve)
        cycle.pass_over(steps[0], events, budget - kept_back)
        if kept_back:
            cycle.pass_over(steps[1], events, budget)
        for market, series, _ in steps[2]:
            if len(cycle.taken) >= budget:
                break
            cycle.take([(market, series)])
        return pd.DataFrame({**{k: [some[k].iloc[0]] * len(cycle.taken) for k in keys}, "market_id": sorted(cycle.taken)})

    kinds = ", ".join(f"{k} {markets.schema[k].dataType.simpleString()}" for k in (*keys, "market_id"))
    return asked.unionByName(siblings).groupBy(*keys).applyInPandas(choose, kinds)
