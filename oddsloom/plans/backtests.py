"""Queries on settlement, backtests, scores and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import PRICE, shown
from ..functions.timeops import seconds_between
from ..operators import backtest as B
from ..operators import calibration, latest, metrics
from . import adapters as A

#: Payout, outcome and profit in 1/100, from sn.
PAID_SQL = """pd AS (SELECT *, CASE WHEN result IN ('yes', 'no') THEN CASE WHEN result = side THEN 100 ELSE 0 END WHEN result = 'fifty_fifty' THEN 50 WHEN result = 'void' THEN cost END AS paid,
        CASE WHEN result IN ('yes', 'no') THEN CASE WHEN result = side THEN 1.0 ELSE 0.0 END ELSE 0.5 END AS y FROM sn)"""


def grading(spark, sf_dir):
    g = B.graded(A.snapshots(spark, sf_dir))
    return g.select("snapshot_id", "result", shown(F.col("payout")).alias("payout"), shown(F.col("profit")).alias("profit"), shown(F.col("per_100"), 4).alias("per_100"))


GRADING_SQL = f"""
    WITH {A.SNAPSHOTS}, {PAID_SQL}
    SELECT snapshot_id, result, paid / 100.0::DOUBLE AS payout, round((paid - cost) / 100.0::DOUBLE, 6) AS profit, sign(paid - cost) * ((2 * abs(paid - cost) * 1000000 + cost) // (2 * cost)) / 1e4 AS per_100 FROM pd"""

TRADES_SQL = f"""{A.SNAPSHOTS}, {PAID_SQL},
    st(strategy, top, usd, hs, ps, mc) AS (VALUES {", ".join(f"('{s.name}', {s.top}, {s.stake or 'NULL'}, {list(s.horizons)}, {list(s.platforms)}, {round(float(s.min_confidence) * 10)})" for s in B.STRATEGIES)}),
    pk AS (SELECT pd.*, st.*, row_number() OVER (PARTITION BY provenance, strategy, day ORDER BY rank, snapshot_id) AS r
           FROM pd JOIN st ON list_contains(hs, horizon) AND list_contains(ps, platform) AND confidence >= mc WHERE result IS NOT NULL),
    kf AS (SELECT *, CASE WHEN p_low > cost THEN CAST((2 * (p_low - cost) * 2500 + (100 - cost)) // (2 * (100 - cost)) AS HUGEINT) ELSE 0 END AS k4 FROM pk WHERE r <= top),
    cn AS (SELECT *, coalesce(usd * 100000000::HUGEINT, k4 * 10000000) AS stake8 FROM kf),
    cc AS (SELECT *, (2 * stake8 * 100 + cost) // (2 * cost) AS c8 FROM cn),
    ct AS (SELECT *, CASE WHEN executable_size > 0 THEN least(c8, executable_size * 100000000::HUGEINT) ELSE c8 END AS n8 FROM cc),
    tr AS (SELECT *, (2 * n8 * cost + 1000000) // 2000000 AS stake4, sign(paid - cost) * ((2 * n8 * abs(paid - cost) + 1000000) // 2000000) AS pnl4,
                  CASE WHEN confidence >= 7 THEN 'high' WHEN confidence >= 4 THEN 'medium' ELSE 'low' END AS band FROM ct WHERE n8 > 0 AND (2 * n8 * cost + 1000000) // 2000000 > 0 AND paid IS NOT NULL)"""


def strategy_trades(spark, sf_dir):
    t = B.trades(A.snapshots(spark, sf_dir))
    return t.select("provenance", "strategy", "snapshot_id", shown(F.col("contracts"), 4).alias("contracts"), shown(F.col("stake"), 4).alias("stake"), shown(F.col("pnl"), 4).alias("pnl"))


STRATEGY_TRADES_SQL = f"""
    WITH {TRADES_SQL}
    SELECT provenance, strategy, snapshot_id, round(CAST(n8 AS DOUBLE) / 1e8, 4) AS contracts, CAST(stake4 AS DOUBLE) / 1e4 AS stake, CAST(pnl4 AS DOUBLE) / 1e4 AS pnl FROM tr"""

SUMMARY_SQL = """count(*) AS n_settled, count(*) FILTER (pnl4 > 0) AS wins, round(avg(CAST(pnl4 > 0 AS INTEGER)), 4) AS win_rate, (200 * CAST(sum(p_side) AS BIGINT) + count(*)) // (2 * count(*)) / 1e4 AS avg_p,
    round(CAST(sum(stake4) AS DOUBLE) / 1e4, 4) AS total_stake, round(CAST(sum(pnl4) AS DOUBLE) / 1e4, 4) AS total_pnl, round(CAST(sum(pnl4) AS DOUBLE) / CAST(sum(stake4) AS DOUBLE), 4) AS roi,
    CASE WHEN sum(CASE WHEN pnl4 < 0 THEN 1 ELSE 0 END) > 0 THEN round(coalesce(CAST(sum(pnl4) FILTER (pnl4 > 0) AS DOUBLE), 0) / -CAST(sum(pnl4) FILTER (pnl4 < 0) AS DOUBLE), 5) END AS profit_factor,
    CASE WHEN count(*) >= 2 AND stddev_samp(CAST(pnl4 AS DOUBLE) / CAST(stake4 AS DOUBLE)) > 0 THEN round(avg(CAST(pnl4 AS DOUBLE) / CAST(stake4 AS DOUBLE)) / stddev_samp(CAST(pnl4 AS DOUBLE) / CAST(stake4 AS DOUBLE)), 5) END AS sharpe,
    round(avg(pow(p_side / 100.0::DOUBLE - y, 2)), 5) AS brier, round(avg(pow(market_p / 100.0::DOUBLE - y, 2)), 5) AS market_brier,
    round(avg(-(y * ln(p_side / 100.0::DOUBLE) + (1 - y) * ln(1 - p_side / 100.0::DOUBLE))), 5) AS log_loss, round(avg(pow(market_p / 100.0::DOUBLE - y, 2)) - avg(pow(p_side / 100.0::DOUBLE - y, 2)) + 1e-9, 5) AS improvement"""


def strategy_summary(spark, sf_dir):
    t = B.trades(A.snapshots(spark, sf_dir))
    return t.groupBy("provenance", "strategy").agg(*(c.alias(n) for n, c in metrics.summary().items()), B.worst_quality(F.col("quality")).alias("quality"))


STRATEGY_SUMMARY_SQL = f"""
    WITH {TRADES_SQL}
    SELECT provenance, strategy, {SUMMARY_SQL}, ['unknown', 'candle', 'quote', 'orderbook'][min(list_position(['unknown', 'candle', 'quote', 'orderbook'], quality))] AS quality FROM tr GROUP BY provenance, strategy"""


def strategy_slices(spark, sf_dir):
    """The same figures by platform, horizon and confidence band, in one pass of grouping sets."""
    t = B.trades(A.snapshots(spark, sf_dir))
    keys = [F.col(c) for c in ("provenance", "strategy", "platform", "horizon", "band")]
    sets = [[*keys[:2], k] for k in keys[2:]]
    out = t.groupingSets(sets, *keys).agg(*(c.alias(n) for n, c in metrics.summary().items()))
    return out.select("provenance", "strategy", F.coalesce(F.concat(F.lit("platform="), "platform"), F.concat(F.lit("horizon="), "horizon"), F.concat(F.lit("confidence_band="), "band")).alias("slice"), *metrics.summary())


STRATEGY_SLICES_SQL = f"""
    WITH {TRADES_SQL}
    SELECT provenance, strategy, coalesce('platform=' || platform, 'horizon=' || horizon, 'confidence_band=' || band) AS slice, {SUMMARY_SQL}
    FROM tr GROUP BY GROUPING SETS ((provenance, strategy, platform), (provenance, strategy, horizon), (provenance, strategy, band))"""


def max_drawdown(spark, sf_dir):
    t = B.trades(A.snapshots(spark, sf_dir))
    return metrics.drawdown(t, ["provenance", "strategy"], ["day", "rank", "snapshot_id"], "pnl").withColumn("max_drawdown", shown(F.col("max_drawdown"), 4))


DRAWDOWN_SQL = f"""
    WITH {TRADES_SQL}, r AS (SELECT *, sum(pnl4) OVER (PARTITION BY provenance, strategy ORDER BY day, rank, snapshot_id) AS run FROM tr),
    p AS (SELECT *, greatest(max(run) OVER (PARTITION BY provenance, strategy ORDER BY day, rank, snapshot_id), 0) AS peak FROM r)
    SELECT provenance, strategy, CAST(least(min(run - peak), 0) AS DOUBLE) / 1e4 AS max_drawdown FROM p GROUP BY provenance, strategy"""


def calibration_curve(spark, sf_dir):
    s = A.snapshots(spark, sf_dir).where("result IS NOT NULL").withColumn("y", B.outcome(F.col("result"), F.col("side")))
    c = metrics.calibration_curve(s, "p_side", "y", ["provenance", "platform"])
    return c.select("provenance", "platform", "bin", "n", shown(F.col("mean_p")).alias("mean_p"), shown(F.col("frequency")).alias("frequency"))


CURVE_SQL = f"""
    WITH {A.SNAPSHOTS}, {PAID_SQL}
    SELECT provenance, platform, CAST(least(9, p_side // 10) AS INTEGER) AS bin, count(*) AS n, round(avg(p_side / 100.0::DOUBLE), 6) AS mean_p, round(avg(y), 6) AS frequency
    FROM pd WHERE result IS NOT NULL GROUP BY ALL"""


def segment_metrics(spark, sf_dir):
    s = A.snapshots(spark, sf_dir).where("result IS NOT NULL").withColumn("y", B.outcome(F.col("result"), F.col("side"))).withColumn("band", B.confidence_band(F.col("confidence")))
    m = metrics.paired(s, ["horizon", "band"], "p_side", "market_p", "y")
    return m.select("horizon", "band", "n", shown(F.col("difference")).alias("difference"), shown(F.col("se")).alias("se"), shown(F.col("t"), 4).alias("t"), "significant")


SEGMENT_SQL = f"""
    WITH {A.SNAPSHOTS}, {PAID_SQL},
    d AS (SELECT horizon, CASE WHEN confidence >= 7 THEN 'high' WHEN confidence >= 4 THEN 'medium' ELSE 'low' END AS band, pow(market_p / 100.0::DOUBLE - y, 2) - pow(p_side / 100.0::DOUBLE - y, 2) AS d FROM pd WHERE result IS NOT NULL),
    g AS (SELECT horizon, band, count(*) AS n, avg(d) AS m, stddev_samp(d) / sqrt(count(*)) AS se FROM d GROUP BY ALL)
    SELECT horizon, band, n, round(m, 6) AS difference, round(se, 6) AS se, round(m / se, 4) AS t, abs(m / se) > 2 AS significant FROM g"""


def isotonic_fit(spark, sf_dir):
    s = A.snapshots(spark, sf_dir).where("result IS NOT NULL").withColumn("y", B.outcome(F.col("result"), F.col("side")))
    k = calibration.isotonic(s, ["provenance"], "p_side", "y")
    return k.select("provenance", shown(F.col("x")).alias("x"), shown(F.col("fitted")).alias("fitted"))


ISOTONIC_SQL = f"""
    WITH {A.SNAPSHOTS}, {PAID_SQL},
    g AS (SELECT provenance, p_side AS x, sum(y) AS s, count(*) AS n FROM pd WHERE result IS NOT NULL GROUP BY ALL),
    c AS (SELECT *, sum(s) OVER (PARTITION BY provenance ORDER BY x) AS cs, sum(n) OVER (PARTITION BY provenance ORDER BY x) AS cn FROM g),
    m AS (SELECT i.provenance, i.x AS xi, j.x AS xj, min((k.cs - j.cs + j.s) / (k.cn - j.cn + j.n)) AS lo FROM c i JOIN c j ON i.provenance = j.provenance AND j.x <= i.x JOIN c k ON i.provenance = k.provenance AND k.x >= i.x GROUP BY ALL),
    f AS (SELECT provenance, xi AS x, max(lo) AS fitted FROM m GROUP BY ALL)
    SELECT provenance, round(max(x) / 100.0::DOUBLE, 6) AS x, round(fitted, 6) AS fitted FROM (SELECT provenance, x, round(fitted, 10) AS fitted FROM f) GROUP BY provenance, fitted"""


def beta_calibration(spark, sf_dir):
    """Newton's fit has no SQL; the tests hold it against its normal equations."""
    s = A.snapshots(spark, sf_dir).where("result IN ('yes', 'no')").withColumn("y", B.outcome(F.col("result"), F.col("side")))
    b = calibration.beta_fit(s, ["provenance"], "p_side", "y")
    return b.select("provenance", *(shown(F.col(c), 5).alias(c) for c in "abc"))


def adoption_gate(spark, sf_dir):
    """An isotonic map fitted on the earlier fold of each provenance and judged on the later one."""
    s = A.snapshots(spark, sf_dir).where("result IS NOT NULL").withColumn("y", B.outcome(F.col("result"), F.col("side")))
    f = calibration.folds(s, ["provenance"], ["day", "rank", "snapshot_id"])
    knots = calibration.isotonic(f.where("fold = 'train'"), ["provenance"], "p_side", "y")
    f = calibration.with_knots(f, knots, ["provenance"], "p_side", "mapped")
    fitted = F.col("mapped")
    v = F.col("fold") == "validate"
    out = f.groupBy("provenance").agg(F.count("*").alias("n"), F.count(F.when(v, 1)).alias("n_validation"), metrics.brier(F.when(v, F.col("p_side")), F.col("y")).alias("identity"), metrics.brier(F.when(v, fitted), F.col("y")).alias("fitted"))
    return out.select("provenance", "n", "n_validation", shown(F.col("identity")).alias("identity"), shown(F.col("fitted")).alias("fitted"), shown(calibration.threshold(F.col("n_validation"))).alias("threshold"), calibration.adopted(F.col("n"), F.col("identity"), F.col("fitted"), F.col("n_validation")).alias("adopted"))


GATE_SQL = f"""
    WITH {A.SNAPSHOTS}, {PAID_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY provenance ORDER BY day, rank, snapshot_id) AS i, count(*) OVER (PARTITION BY provenance) AS n FROM pd WHERE result IS NOT NULL),
    g AS (SELECT provenance, p_side AS x, sum(y) AS s, count(*) AS n FROM o WHERE i <= floor(n * 0.7) GROUP BY ALL),
    c AS (SELECT *, sum(s) OVER (PARTITION BY provenance ORDER BY x) AS cs, sum(n) OVER (PARTITION BY provenance ORDER BY x) AS cn FROM g),
    m AS (SELECT i.provenance, i.x AS xi, j.x AS xj, min((k.cs - j.cs + j.s) / (k.cn - j.cn + j.n)) AS lo FROM c i JOIN c j ON i.provenance = j.provenance AND j.x <= i.x JOIN c k ON i.provenance = k.provenance AND k.x >= i.x GROUP BY ALL),
    kn AS (SELECT provenance, max(x) AS x, fitted FROM (SELECT provenance, xi AS x, round(max(lo), 10) AS fitted FROM m GROUP BY ALL) GROUP BY provenance, fitted),
    w AS (SELECT o.*, (SELECT max(x) FROM kn WHERE kn.provenance = o.provenance AND kn.x <= p_side) AS xa, (SELECT min(x) FROM kn WHERE kn.provenance = o.provenance AND kn.x >= p_side) AS xb FROM o WHERE i > floor(n * 0.7)),
    z AS (SELECT w.*, ka.fitted AS fa, kb.fitted AS fb FROM w LEFT JOIN kn ka ON ka.provenance = w.provenance AND ka.x = xa LEFT JOIN kn kb ON kb.provenance = w.provenance AND kb.x = xb),
    v AS (SELECT provenance, any_value(n) AS n, count(*) AS nv, avg(pow(p_side / 100.0::DOUBLE - y, 2)) AS a, avg(pow(CASE WHEN xa IS NULL THEN fb WHEN xb IS NULL OR xa = xb THEN fa ELSE fa + (fb - fa) * (p_side - xa) / (xb - xa)::DOUBLE END - y, 2)) AS b FROM z GROUP BY provenance)
    SELECT provenance, n, nv AS n_validation, round(a, 6) AS identity, round(b, 6) AS fitted, round(0.08 / sqrt(nv), 6) AS threshold, n >= 150 AND a - b >= 0.08 / sqrt(nv) AS adopted FROM v"""


def recommendation_states(spark, sf_dir):
    s = A.snapshots(spark, sf_dir)
    now = ((F.col("snapshot_id") * 19 % 60 - 20) / F.lit(100).cast("decimal(3,0)")).cast(PRICE)
    out = s.withColumn("state", B.state(F.col("result").isNotNull() & (F.col("snapshot_id") % 3 == 0), F.col("snapshot_id") % 13 == 0, now, F.col("p_side") - F.col("cost")))
    return out.groupBy("provenance", "state").agg(F.count("*").alias("n"))


STATES_SQL = f"""
    WITH {A.SNAPSHOTS}, s AS (SELECT provenance, CASE WHEN result IS NOT NULL AND snapshot_id % 3 = 0 THEN 'settled' WHEN snapshot_id % 13 = 0 THEN 'closed' WHEN snapshot_id * 19 % 60 - 20 <= 0 THEN 'no_longer_valuable'
             WHEN 2 * (snapshot_id * 19 % 60 - 20) < p_side - cost THEN 'reduced' ELSE 'actionable' END AS state FROM sn)
    SELECT provenance, state, count(*) AS n FROM s GROUP BY ALL"""


def leakage(spark, sf_dir):
    """Evidence that was known when a recommendation was published, by market."""
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("market_id"), F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp")).alias("observed_at"))
    published = F.timestamp_add("DAY", (F.col("market_id") % 30).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    ok = B.admissible(F.col("observed_at"), published)
    return e.groupBy("market_id").agg(F.count(F.when(ok, 1)).alias("admissible"), F.count(F.when(~ok, 1)).alias("refused"))


LEAKAGE_SQL = """
    WITH e AS (SELECT user_id AS market_id, CASE WHEN event_id % 10 <> 0 THEN CAST(ts AS TIMESTAMP) END AS t FROM events),
    j AS (SELECT market_id, coalesce(t <= TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (market_id % 30), false) AS ok FROM e)
    SELECT market_id, count(*) FILTER (ok) AS admissible, count(*) FILTER (NOT ok) AS refused FROM j GROUP BY market_id"""


def retrodiction(spark, sf_dir):
    """Prices known at leads of 6 hours, one, three and seven days before each market's end, at most 2 hours old."""
    p = A.prices(spark, sf_dir)
    end = F.timestamp_add("DAY", (F.col("market_id") % 10).cast("int"), F.lit("2024-01-20 12:00:00").cast("timestamp"))
    leads = p.select("market_id").distinct().withColumn("lead", F.explode(F.array(*map(F.lit, (6, 24, 72, 168)))))
    asked = leads.withColumn("at", F.timestamp_add("HOUR", -F.col("lead"), end))
    out = latest.as_of(asked, p, "market_id", "at", "observed_at", ["price", "event_id"], "event_id", tolerance_seconds=7200)
    return out.select("market_id", "lead", F.col("price").alias("price"), F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.when(F.col("price").isNull(), "no_price").otherwise("used").alias("status"))


RETRO_SQL = f"""
    WITH {A.PRICES}, a AS (SELECT market_id, CAST(lead AS INTEGER) AS lead, TIMESTAMP '2024-01-20 12:00:00' + INTERVAL 1 DAY * (market_id % 10) - INTERVAL 1 HOUR * lead AS moment FROM (SELECT DISTINCT market_id FROM pr), (SELECT unnest([6, 24, 72, 168]) AS lead)),
    j AS (SELECT a.*, price, event_id, row_number() OVER (PARTITION BY a.market_id, lead ORDER BY observed_at DESC NULLS LAST, event_id DESC) AS r
          FROM a LEFT JOIN pr ON a.market_id = pr.market_id AND observed_at <= moment AND observed_at >= moment - INTERVAL 2 HOUR)
    SELECT market_id, lead, price, coalesce(event_id, -1) AS event_id, CASE WHEN price IS NULL THEN 'no_price' ELSE 'used' END AS status FROM j WHERE r = 1"""


def readiness(spark, sf_dir):
    """Settled recommendations, their rate and what is left to the milestones of 60 and 150."""
    s = A.snapshots(spark, sf_dir).where("result IS NOT NULL")
    g = s.groupBy("provenance", "platform").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))
    days = F.greatest(seconds_between(F.col("first"), F.col("last")) / 86400, F.lit(1.0))
    rate = F.col("n") / days
    left = lambda m: F.greatest(F.lit(m) - F.col("n"), F.lit(0))
    return g.select("provenance", "platform", "n", "first", "last", shown(rate).alias("rate"), left(60).alias("to_60"), left(150).alias("to_150"), F.when(rate > 0, F.ceil(left(1_000_000) / rate).cast("long")).alias("days_to_million"))


READINESS_SQL = f"""
    WITH {A.SNAPSHOTS}, g AS (SELECT provenance, platform, count(*) AS n, min(day) AS first, max(day) AS last FROM sn WHERE result IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, n / greatest(CAST(date_diff('day', first, last) AS DOUBLE), 1.0) AS rate FROM g)
    SELECT provenance, platform, n, first, last, round(rate, 6) AS rate, greatest(60 - n, 0) AS to_60, greatest(150 - n, 0) AS to_150, CAST(ceil(greatest(1000000 - n, 0) / rate) AS BIGINT) AS days_to_million FROM r"""


def weekly_review(spark, sf_dir):
    """Scores of independent and of derived forecasts that settled within a window."""
    s = A.snapshots(spark, sf_dir).where("result IS NOT NULL AND day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'").withColumn("y", B.outcome(F.col("result"), F.col("side"))).withColumn("independent", F.col("snapshot_id") % 6 < 2)
    market = F.when(F.col("snapshot_id") % 8 != 0, F.col("market_p"))
    return s.groupBy("independent").agg(F.count("*").alias("n"), F.count(market).alias("n_market"), shown(metrics.brier(F.col("p_side"), F.col("y"))).alias("model"), shown(metrics.brier(market, F.col("y"))).alias("market"))


WEEKLY_SQL = f"""
    WITH {A.SNAPSHOTS}, {PAID_SQL}
    SELECT snapshot_id % 6 < 2 AS independent, count(*) AS n, count(*) FILTER (snapshot_id % 8 <> 0) AS n_market, round(avg(pow(p_side / 100.0::DOUBLE - y, 2)), 6) AS model, round(avg(pow(market_p / 100.0::DOUBLE - y, 2)) FILTER (snapshot_id % 8 <> 0), 6) AS market
    FROM pd WHERE result IS NOT NULL AND day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY ALL"""


def forecast_scores(spark, sf_dir):
    """Quality labels scored against a forecast from the document's key."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = A.table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("p", (F.col("doc_id") * 53 % 97 + 1) / 98)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), shown(metrics.brier(F.col("p"), F.col("quality"))).alias("brier"), shown(metrics.log_loss(F.col("p"), F.col("quality"))).alias("log_loss"))


SCORES_SQL = """
    WITH r AS (SELECT lang, (doc_id * 53 % 97 + 1) / 98.0::DOUBLE AS p, quality AS y FROM labels JOIN documents USING (doc_id))
    SELECT lang, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM r GROUP BY lang"""


def case_study(spark, sf_dir):
    """The recommendation of the largest profit or loss in each provenance, by winners and losers."""
    g = B.graded(A.snapshots(spark, sf_dir)).where("profit <> 0").withColumn("kind", F.when(F.col("profit") > 0, "winner").otherwise("loser"))
    best = F.max_by(F.struct("snapshot_id", "profit"), F.struct(F.abs("profit"), -F.col("snapshot_id")))
    return g.groupBy("provenance", "kind").agg(best.alias("b")).select("provenance", "kind", "b.snapshot_id", shown(F.col("b.profit")).alias("profit"))


CASE_SQL = f"""
    WITH {A.SNAPSHOTS}, {PAID_SQL}, k AS (SELECT *, CASE WHEN paid > cost THEN 'winner' ELSE 'loser' END AS kind, row_number() OVER (PARTITION BY provenance, paid > cost ORDER BY abs(paid - cost) DESC, snapshot_id) AS r FROM pd WHERE paid <> cost)
    SELECT provenance, kind, snapshot_id, round((paid - cost) / 100.0::DOUBLE, 6) AS profit FROM k WHERE r = 1"""

QUERIES = {
    "grading": (grading, GRADING_SQL),
    "strategy_trades": (strategy_trades, STRATEGY_TRADES_SQL),
    "strategy_summary": (strategy_summary, STRATEGY_SUMMARY_SQL),
    "strategy_slices": (strategy_slices, STRATEGY_SLICES_SQL),
    "max_drawdown": (max_drawdown, DRAWDOWN_SQL),
    "calibration_curve": (calibration_curve, CURVE_SQL),
    "segment_metrics": (segment_metrics, SEGMENT_SQL),
    "isotonic_fit": (isotonic_fit, ISOTONIC_SQL),
    "beta_calibration": (beta_calibration, None),
    "adoption_gate": (adoption_gate, GATE_SQL),
    "recommendation_states": (recommendation_states, STATES_SQL),
    "leakage": (leakage, LEAKAGE_SQL),
    "retrodiction": (retrodiction, RETRO_SQL),
    "readiness": (readiness, READINESS_SQL),
    "weekly_review": (weekly_review, WEEKLY_SQL),
    "forecast_scores": (forecast_scores, SCORES_SQL),
    "case_study": (case_study, CASE_SQL),
}
