"""Queries on probability models and their pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import shown
from ..functions.special import gbm_above, normal_cdf, normal_cdf_sql, with_gbm_touch
from ..operators import books, latest
from ..operators import probability as P
from . import adapters as A

NAMES = [r[0] for r in P.REGISTRY] + ["undeclared_model"]


def _opinions(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = A.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("market_id"),
        k.alias("at"),
        F.element_at(F.array(*map(F.lit, NAMES)), (k % len(NAMES) + 1).cast("int")).alias("component"),
        F.when(k % 17 != 0, (k * 17 % 90 + 5) / 100).alias("probability"),
        ((k % 9) / 10).alias("confidence"),
        F.when(k % 5 != 0, (k % 7 + 1) / 100).alias("stdev"),
        (k * 37 % 5000).alias("freshness"),
    )
    return latest.latest(rows, ["market_id", "component"], ["at"])


OPINIONS = f"""op AS (SELECT * FROM (
    SELECT o_custkey AS market_id, {NAMES}[o_orderkey % {len(NAMES)} + 1] AS component, CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 17 % 90 + 5) / 100.0::DOUBLE END AS p,
           (o_orderkey % 9) / 10.0::DOUBLE AS w, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 7 + 1) / 100.0::DOUBLE ELSE 0.08 END AS sd, o_orderkey * 37 % 5000 AS freshness,
           row_number() OVER (PARTITION BY o_custkey, {NAMES}[o_orderkey % {len(NAMES)} + 1] ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND p IS NOT NULL AND w > 0)"""


def ensemble(spark, sf_dir):
    out = P.pooled(_opinions(spark, sf_dir))
    return out.select("market_id", *(shown(F.col(c)).alias(c) for c in ("mean", "low", "high", "model_confidence", "independent", "decision_yes", "decision_no")), "has_independent_prior", "independent_sources", "age", "n_components")


ENSEMBLE_SQL = f"""
    WITH {OPINIONS}, reg(component, grp, rel, ind) AS (VALUES {", ".join(f"('{c}', '{g}', {r}::DOUBLE, {s not in P.MARKET_SOURCES})" for c, s, g, r in P.REGISTRY)}),
    o AS (SELECT op.*, grp, rel, coalesce(ind, false) AS ind, ln(p / (1 - p)) AS lo, least(least(sd, sqrt(greatest(p * (1 - p), 1e-4))) / greatest(p * (1 - p), 1e-4), 3.0) AS sg FROM op LEFT JOIN reg USING (component)),
    a AS (SELECT market_id, sum(w) AS w, sum(w * lo) / sum(w) AS mlo, sum(w * sg) / sum(w) AS sg, sum(w * lo) FILTER (ind) / sum(w) FILTER (ind) AS ilo, coalesce(sum(w) FILTER (ind), 0) > 0 AS has, count(DISTINCT grp) FILTER (ind) AS groups, max(rel) FILTER (ind) AS rel, max(freshness) AS age, max(w) AS best, count(*) AS n FROM o GROUP BY market_id),
    m AS (SELECT *, 1 / (1 + exp(-mlo)) AS mean FROM a),
    d AS (SELECT market_id, sqrt(sum(o.w * pow(lo - mlo, 2)) / any_value(m.w)) AS dlo, sqrt(sum(o.w * pow(p - mean, 2)) / any_value(m.w)) AS dp FROM o JOIN m USING (market_id) GROUP BY market_id),
    c AS (SELECT *, round(least(greatest((best + (1 - best) * (1 - exp(-(w - best)))) / (1 + dp / 0.15), 1e-6), 1 - 1e-6), 6) AS conf FROM m JOIN d USING (market_id)),
    s AS (SELECT *, greatest((sg + dlo) * CASE WHEN age > 3600 THEN 1.3 WHEN age > 900 THEN 1.15 ELSE 1 END, 1 - conf, CASE WHEN has THEN 0 ELSE 2 END) AS sigma FROM c),
    i AS (SELECT *, sigma * CASE groups WHEN 0 THEN 3.0 WHEN 1 THEN 1.4 WHEN 2 THEN 1.15 ELSE 1 END AS wide FROM s),
    e AS (SELECT *, round(least(greatest(1 / (1 + exp(-(ilo - 1.2816 * wide))), 1e-6), 1 - 1e-6), 6) AS il, round(least(greatest(1 / (1 + exp(-(ilo + 1.2816 * wide))), 1e-6), 1 - 1e-6), 6) AS ih FROM i)
    SELECT market_id, round((mean), 6) AS mean, round((least(greatest(1 / (1 + exp(-(mlo - 1.2816 * sigma))), 1e-6), 1 - 1e-6)), 6) AS low, round((least(greatest(1 / (1 + exp(-(mlo + 1.2816 * sigma))), 1e-6), 1 - 1e-6)), 6) AS high, conf AS model_confidence,
           round((1 / (1 + exp(-ilo))), 6) AS independent, CASE WHEN has THEN round((least(greatest(il * rel - CASE WHEN age > 3600 THEN 0.02 ELSE 0 END, 0), 1) + 1e-9), 6) END AS decision_yes, CASE WHEN has THEN round((least(greatest((1 - ih) * rel - CASE WHEN age > 3600 THEN 0.02 ELSE 0 END, 0), 1) + 1e-9), 6) END AS decision_no,
           has AS has_independent_prior, groups AS independent_sources, age, n AS n_components FROM e"""


def cross_venue_consensus(spark, sf_dir):
    k = F.col("l_partkey")
    q = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("market_id"), F.when(F.col("l_orderkey") % 2 == 0, "kalshi").otherwise("polymarket").alias("platform"), F.when(k % 3 == 0, "kalshi").when(k % 3 == 1, "polymarket").otherwise("predictit").alias("other_platform"), ((k % 97 + 1) / 100).alias("price"))
    c = P.consensus(q)
    return c.select("market_id", "n", shown(F.col("probability"), 5).alias("probability"), shown(F.col("confidence"), 4).alias("confidence"), shown(F.col("stdev"), 5).alias("stdev"))


CONSENSUS_SQL = """
    WITH q AS (SELECT l_orderkey AS market_id, l_orderkey % 2 AS own, l_partkey % 3 AS other, (l_partkey % 97 + 1) / 100.0::DOUBLE AS p FROM lineitem),
    g AS (SELECT market_id, avg(p) AS m, stddev_pop(p) AS sd, count(*) AS n FROM q WHERE own <> other GROUP BY market_id),
    s AS (SELECT *, CASE WHEN n > 1 THEN sd ELSE 0.02 END AS sp, least(0.72, 0.45 + 0.12 * (n - 1)) AS b FROM g)
    SELECT market_id, n, round(round(m, 6), 5) AS probability, round(round(CASE WHEN round(sp, 9) > 0.08 THEN b * 0.6 ELSE b END, 6), 4) AS confidence, round(greatest(sp, 0.015), 5) AS stdev FROM s"""


def sibling_coherence(spark, sf_dir):
    k = F.col("o_orderkey")
    n = F.count("*").over(latest.Window.partitionBy("o_custkey"))
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"), k.alias("market_id"), ((k % 19 + 1) / F.lit(100).cast("decimal(3,0)")).cast("decimal(6,4)").alias("price"), F.when(F.col("o_custkey") % 4 != 0, n).alias("outcome_count"))
    c = P.sibling_coherence(rows)
    return c.select("market_id", shown(F.col("probability")).alias("probability"), shown(F.col("confidence")).alias("confidence"), shown(F.col("stdev")).alias("stdev"))


SIBLING_SQL = """
    WITH p AS (SELECT o_custkey AS e, o_orderkey AS market_id, o_orderkey % 19 + 1 AS c, sum(o_orderkey % 19 + 1) OVER (PARTITION BY o_custkey) AS t, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT market_id, round(CAST(c AS DOUBLE) / CAST(t AS DOUBLE), 6) AS probability, round(0.45 * (1 - least(1.0, abs(100 - t) / 50.0::DOUBLE)), 6) AS confidence, round(greatest(abs(100 - t) / 200.0::DOUBLE, 0.02), 6) AS stdev
    FROM p WHERE n >= 3 AND e % 4 <> 0 AND abs(100 - t) >= 2 AND abs(100 - t) < 50"""


def reference_prior(spark, sf_dir):
    t = books.top_of_book(A.levels(spark, sf_dir, "l_orderkey"), ["book_id"])
    bid, ask = F.col("yes_bid").cast("double"), F.col("yes_ask").cast("double")
    k = F.col("book_id")
    price = P.reference_price(bid, ask, F.when(k % 3 == 0, (k % 120) / 100))
    spread = F.round(F.when(k % 4 != 0, ask - bid), 4)
    return t.select("book_id", shown(price).alias("price"), shown(P.reference_confidence(bid.isNotNull() & ask.isNotNull(), spread, k % 3000, k % 1800), 5).alias("confidence"))


REFERENCE_SQL = f"""
    WITH {A.levels_sql("l_orderkey")}, t AS (SELECT book_id AS k, min(cents) FILTER (side = 'yes' AND is_ask) AS a, max(cents) FILTER (side = 'yes' AND NOT is_ask) AS b FROM lv GROUP BY book_id),
    s AS (SELECT *, CASE WHEN k % 4 <> 0 THEN a - b END AS sp FROM t)
    SELECT k AS book_id, round(coalesce((a + b) / 200.0::DOUBLE, a / 100.0::DOUBLE, b / 100.0::DOUBLE, CASE WHEN k % 3 = 0 AND k % 120 BETWEEN 1 AND 99 THEN k % 120 / 100.0::DOUBLE END), 6) AS price,
           round(round(least(0.9, CASE WHEN sp <= 1 THEN 0.85 WHEN sp <= 3 THEN 0.7 WHEN sp > 10 THEN 0.35 WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.55 ELSE 0.4 END * CASE WHEN k % 3000 < 1000 THEN 0.7 ELSE 1 END * CASE WHEN k % 1800 > 900 THEN 0.6 ELSE 1 END), 6), 5) AS confidence FROM s"""


def gbm(spark, sf_dir):
    """Spot from retail prices, strikes around them, volatility and time from keys."""
    k = F.col("p_partkey")
    spot, strike = F.col("p_retailprice"), F.col("p_retailprice") * (F.lit(0.7) + (k % 61) / 100)
    vol, years = (k % 50) / 100 + 0.1, (k % 90) / 365.25
    rows = A.table(spark, sf_dir, "part").select("p_partkey", spot.alias("spot"), strike.alias("strike"), vol.alias("vol"), years.alias("years"))
    terms = [F.col(c) for c in ("spot", "strike", "vol", "years")]
    rows = with_gbm_touch(rows, "touch", *terms)
    return rows.select("p_partkey", shown(gbm_above(*terms), 5).alias("above"), shown(F.col("touch"), 5).alias("touch"))


def _gbm_sql():
    d = "((ln(s / b) - v * v * y / 2) / (v * sqrt(y)))"
    mu, h = "(-v * v / 2)", "ln(b / s)"
    sd = "(v * sqrt(y))"
    n = normal_cdf_sql
    up = f"({n(f'(({mu} * y - {h}) / {sd})')} + exp(2 * {mu} * {h} / (v * v)) * {n(f'((-{h} - {mu} * y) / {sd})')})"
    down = f"({n(f'(({h} - {mu} * y) / {sd})')} + exp(2 * {mu} * {h} / (v * v)) * {n(f'(({h} + {mu} * y) / {sd})')})"
    return f"""
    WITH k AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * (0.7::DOUBLE + (p_partkey % 61) / 100.0::DOUBLE) AS b, (p_partkey % 50) / 100.0::DOUBLE + 0.1::DOUBLE AS v, (p_partkey % 90) / 365.25::DOUBLE AS y FROM part)
    SELECT p_partkey, round(CASE WHEN y <= 0 THEN CASE WHEN s > b THEN 1.0 ELSE 0.0 END ELSE {n(d)} END, 5) AS above, round(CASE WHEN b = s THEN 1.0 WHEN y <= 0 THEN 0.0 ELSE least(greatest(CASE WHEN b >= s THEN {up} ELSE {down} END, 0.0), 1.0) END, 5) AS touch FROM k"""


def volatility(spark, sf_dir):
    """Realised and exponentially weighted volatility of each user's series of values."""
    c = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", (F.col("value") + 100).alias("close"))
    w = latest.Window.partitionBy("key").orderBy("event_id")
    r = c.withColumn("r", F.log(F.col("close") / F.lag("close").over(w))).where("r IS NOT NULL")
    ew = P.ewma(r, "key", "event_id", "r")
    v = P.realised_vol(c, "key", "event_id", "close", 24 * 365.25)
    return v.join(ew, "key").select("key", "n", shown(F.col("vol"), 4).alias("vol"), shown(F.col("se"), 4).alias("se"), shown(F.col("ewma"), 5).alias("ewma"))


VOLATILITY_SQL = """
    WITH c AS (SELECT user_id AS key, event_id, ln((value + 100) / lag(value + 100) OVER (PARTITION BY user_id ORDER BY event_id)) AS r FROM events),
    i AS (SELECT key, r, row_number() OVER (PARTITION BY key ORDER BY event_id) AS i, count(*) OVER (PARTITION BY key) AS m FROM c WHERE r IS NOT NULL),
    v AS (SELECT key, count(*) AS n, stddev_samp(r) AS sd FROM c GROUP BY key),
    w AS (SELECT key, sqrt(avg(r * r) FILTER (i <= 21) * pow(0.94, greatest(any_value(m) - 21, 0)) + coalesce(sum(0.06 * pow(0.94, m - i) * r * r) FILTER (i > 21), 0)) AS ewma FROM i GROUP BY key)
    SELECT key, n, CASE WHEN n >= 48 THEN round(sd * sqrt(24 * 365.25), 4) END AS vol, CASE WHEN n >= 48 THEN round(sd * sqrt(24 * 365.25) / sqrt(2.0 * (n - 1)), 4) END AS se, round(ewma, 5) AS ewma FROM v JOIN w USING (key)"""


def weather(spark, sf_dir):
    """P of a maximum above, below or between whole degrees, from a forecast whose error grows with lead."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(F.lit("greater"), F.lit("less"), F.lit("between")), (k % 3 + 1).cast("int"))
    low, high, forecast, lead = k % 40 + 50, k % 40 + 52, k * 7 % 40 + 50, (k % 9).cast("int")
    rows = A.table(spark, sf_dir, "supplier").select("s_suppkey", kind.alias("kind"), low.alias("low"), high.alias("high"), forecast.alias("forecast"), P.forecast_sigma(lead).alias("sigma"), P.weather_confidence(lead, k % 12).alias("confidence"))
    p = lambda times: P.weather(F.col("kind"), F.col("low"), F.col("high"), F.col("forecast"), F.col("sigma") * times)
    # The interval shows how much depends on the deviation that is assumed.
    return rows.select("s_suppkey", shown(p(1.0), 5).alias("probability"), shown(F.col("confidence"), 4).alias("confidence"), shown(F.abs(p(0.75) - p(1.35)) / 2, 5).alias("stdev"))


def _weather_sql() -> str:
    z = lambda x, t: normal_cdf_sql(f"(({x} - f) / (sg * {t}::DOUBLE))")
    p = lambda t: f"CASE m WHEN 2 THEN greatest({z('(lo + 2.5::DOUBLE)', t)} - {z('(lo - 0.5::DOUBLE)', t)}, 0.0) WHEN 1 THEN {z('(lo + 1.5::DOUBLE)', t)} ELSE 1 - {z('(lo + 0.5::DOUBLE)', t)} END"
    return f"""
    WITH k AS (SELECT s_suppkey, s_suppkey % 3 AS m, s_suppkey % 40 + 50 AS lo, s_suppkey * 7 % 40 + 50 AS f, s_suppkey % 9 AS lead, CAST({list(P.FORECAST_SIGMA)} AS DOUBLE[])[least(s_suppkey % 9, 7) + 1] AS sg FROM supplier),
    q AS (SELECT s_suppkey, lead, {p(1.0)} AS p, {p(0.75)} AS a, {p(1.35)} AS b FROM k)
    SELECT s_suppkey, round(p, 5) AS probability, round(0.75::DOUBLE * greatest(0.3::DOUBLE, 1 - 0.11::DOUBLE * lead) * CASE WHEN s_suppkey % 12 > 6 THEN 0.8::DOUBLE ELSE 1.0 END, 4) AS confidence, round(abs(a - b) / 2, 5) AS stdev FROM q"""


def cpi_bucket(spark, sf_dir):
    """P(a print within half a tenth of a value) from a nowcast and its error."""
    k = F.col("s_suppkey")
    p = P.gaussian_band((k % 7) / 10, 0.05 + (k % 5) / 100, (k % 9) / 10 - 0.05, (k % 9) / 10 + 0.05)
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", shown(p, 5).alias("probability"))


CPI_SQL = f"""
    WITH k AS (SELECT s_suppkey, s_suppkey % 7 / 10.0::DOUBLE AS v, 0.05::DOUBLE + s_suppkey % 5 / 100.0::DOUBLE AS sd, s_suppkey % 9 / 10.0::DOUBLE AS t FROM supplier),
    z AS (SELECT s_suppkey, (t + 0.05::DOUBLE - v) / sd AS a, (t - 0.05::DOUBLE - v) / sd AS b FROM k)
    SELECT s_suppkey, round({normal_cdf_sql("a")} - {normal_cdf_sql("b")}, 5) AS probability FROM z"""


def sports(spark, sf_dir):
    """Records before a day, shrunk rates, Log5 and a home edge: suppliers are teams, a line is a game."""
    li = A.table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp"))
    rec = li.groupBy("l_suppkey").agg(F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("w"), F.count(F.when(F.col("l_returnflag") != "A", 1)).alias("l"))
    rate = rec.select("l_suppkey", P.shrunk_rate(F.col("w"), F.col("l")).alias("rate"))
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("home"), (F.col("s_suppkey") * 7 % 97 + 1).alias("away"))
    j = s.join(rate.withColumnsRenamed({"l_suppkey": "home", "rate": "h"}), "home").join(rate.withColumnsRenamed({"l_suppkey": "away", "rate": "a"}), "away")
    return j.select("home", "away", shown(P.home_edge(P.log5(F.col("h"), F.col("a")), 0.16), 5).alias("probability"))


SPORTS_SQL = """
    WITH r AS (SELECT l_suppkey AS t, (count(*) FILTER (l_returnflag = 'A') + 4.0::DOUBLE) / (count(*) + 8.0::DOUBLE) AS rate FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY l_suppkey),
    g AS (SELECT s_suppkey AS home, s_suppkey * 7 % 97 + 1 AS away FROM supplier),
    p AS (SELECT home, away, (h.rate - h.rate * a.rate) / (h.rate + a.rate - 2 * h.rate * a.rate) AS p FROM g JOIN r h ON h.t = home JOIN r a ON a.t = away)
    SELECT home, away, round(1 / (1 + exp(-(ln(p / (1 - p)) + 0.16))), 5) AS probability FROM p"""


def nowcast_errors(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("measure"), (F.col("l_partkey") % 30).alias("lead_days"), F.col("l_quantity").alias("forecast"), (F.col("l_quantity") + (F.col("l_partkey") % 11 - 5) / 10).alias("actual"))
    e = P.forecast_errors(li)
    return e.select("measure", "bucket", "n", shown(F.col("rms")).alias("rms"))


NOWCAST_SQL = """
    WITH e AS (SELECT l_returnflag AS measure, CASE WHEN l_partkey % 30 <= 3 THEN '0-3' WHEN l_partkey % 30 <= 10 THEN '4-10' WHEN l_partkey % 30 <= 20 THEN '11-20' ELSE '21+' END AS bucket, (l_partkey % 11 - 5) / 10.0::DOUBLE AS e FROM lineitem)
    SELECT measure, bucket, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rms FROM e GROUP BY ALL HAVING count(*) >= 12"""

QUERIES = {
    "ensemble": (ensemble, ENSEMBLE_SQL),
    "cross_venue_consensus": (cross_venue_consensus, CONSENSUS_SQL),
    "sibling_coherence": (sibling_coherence, SIBLING_SQL),
    "reference_prior": (reference_prior, REFERENCE_SQL),
    "gbm": (gbm, _gbm_sql()),
    "volatility": (volatility, VOLATILITY_SQL),
    "weather": (weather, _weather_sql()),
    "cpi_bucket": (cpi_bucket, CPI_SQL),
    "sports": (sports, SPORTS_SQL),
    "nowcast_errors": (nowcast_errors, NOWCAST_SQL),
}
