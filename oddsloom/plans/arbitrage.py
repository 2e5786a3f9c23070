"""Queries on arbitrage scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import shown
from ..functions.timeops import at
from ..operators import arbitrage as R
from ..operators import books
from . import adapters as A
from .pricing import MATCHED


def _terms(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("book_id"))
    k = F.col("book_id")
    return A.book_terms(s).withColumn("accepting", k % 9 != 0).withColumn("age", (k % 11 * 60).cast("double")).select("book_id", "platform", "fee_rate", "fee_type", "tick_size", "resolves", "accepting", "age")


RESULT = ("gross_edge", "cost_per_set", "profit_per_set", "max_net_profit", "capital_required", "net_roi")


def complete_set_scan(spark, sf_dir):
    out = R.complete_set(A.levels(spark, sf_dir), _terms(spark, sf_dir), "book_id", at(A.NOW))
    return out.select("book_id", F.col("sets").cast("long").alias("sets"), *(shown(F.col(c), 4).alias(c) for c in RESULT), "label")


#: CTE fn: average price in 1/10000 (a4) of walking ``sets`` (an integer) on each ladder of tg(key, leg, sets, k), k the book.
COSTED = """
    fl AS (SELECT tg.key, leg, k, sets, CAST(sum(least(size, sets - lo) * cents) AS HUGEINT) AS spent FROM tg JOIN iv ON iv.book_id = k AND iv.side = tg.side WHERE lo < sets GROUP BY ALL),
    fa AS (SELECT *, (200 * spent + sets) // (2 * sets) AS a4 FROM fl),
    fn AS (SELECT *, CASE WHEN k % 10 = 8 THEN 7 * sets * 1000000000000::HUGEINT WHEN k % 2 = 0 THEN (70000::HUGEINT * sets * a4 * (10000 - a4) + 999999999999) // 1000000000000 * 1000000000000
                   ELSE (2 * 70000::HUGEINT * sets * a4 * (10000 - a4) + 1000000000) // 2000000000 * 1000000000 END // 1000000000 AS fee5,
                  CASE WHEN k % 2 = 0 THEN 100 ELSE 10 END AS tick4, CASE WHEN k % 2 = 0 THEN 0 ELSE (10000 + sets) // (2 * sets) END AS transfer4 FROM fa)"""
#: A result's columns in 1/10000 from sets, gross4 and total5 (1/100000).
RESULT_SQL = """round((10000 - gross4 / CAST(sets AS DOUBLE)) / 1e4, 4) AS gross_edge, round(total5 / CAST(sets AS DOUBLE) / 1e5, 4) AS cost_per_set, round(1 - total5 / CAST(sets AS DOUBLE) / 1e5, 4) AS profit_per_set,
           round((CAST(sets AS DOUBLE) * 1e5 - total5) / 1e5, 4) AS max_net_profit, round(total5 / 1e5, 4) AS capital_required, round((CAST(sets AS DOUBLE) * 1e5 - total5) / total5, 4) AS net_roi"""
COMPLETE_SCAN_SQL = f"""
    WITH {MATCHED},
    st AS (SELECT a.book_id, CAST(sum(least(a.hi, b.hi, 10000) - greatest(a.lo, b.lo)) AS HUGEINT) AS sets, CAST(sum((least(a.hi, b.hi, 10000) - greatest(a.lo, b.lo)) * (a.cents + b.cents)) AS HUGEINT) AS cost
           FROM iv a JOIN iv b ON a.book_id = b.book_id AND a.side = 'yes' AND b.side = 'no' AND a.lo < least(b.hi, 10000) AND b.lo < least(a.hi, 10000) WHERE a.cents + b.cents < 100 GROUP BY a.book_id),
    tg AS (SELECT book_id AS key, s AS leg, s AS side, book_id AS k, sets FROM st, (SELECT unnest(['yes', 'no']) AS s)), {COSTED},
    g AS (SELECT key AS book_id, any_value(sets) AS sets, sum(fee5) + sum(tick4 * sets * 10) + sum(transfer4 * sets * 10) + CAST(round(CAST(sum(a4) AS DECIMAL(38,0)) * 0.05::DECIMAL(38,2) * CAST(round((key % 60) / 365.25, 10) AS DECIMAL(38,10)), 0) AS HUGEINT) * any_value(sets) * 10 AS extra5 FROM fn GROUP BY key),
    r AS (SELECT book_id, g.sets, CAST(cost * 100 AS DOUBLE) AS gross4, CAST(extra5 + cost * 1000 AS DOUBLE) AS total5 FROM g JOIN st USING (book_id))
    SELECT book_id, CAST(sets AS BIGINT) AS sets, {RESULT_SQL},
           CASE WHEN book_id % 9 = 0 THEN 'EXECUTION_RISK' WHEN total5 < 25e5 THEN 'INSUFFICIENT_LIQUIDITY' WHEN book_id % 11 * 60 > 300 THEN 'STALE_QUOTE' ELSE 'EXECUTABLE' END AS label
    FROM r WHERE sets * 1e5 > total5"""


def arbitrage_labels(spark, sf_dir):
    """Complete sets by label, with what the label permits."""
    out = complete_set_scan(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("max_net_profit"), 2).alias("profit"))
    return out.withColumn("d", R.described(F.col("label"))).select("label", "n", "profit", "d.kind", "d.actionable", "d.may_be_called_arbitrage")


LABELS_SQL = f"""
    SELECT label, count(*) AS n, round(sum(max_net_profit), 2) AS profit, CASE WHEN label IN ('EXECUTABLE', 'EXECUTION_RISK') THEN 'arbitrage' ELSE 'diagnostic' END AS kind, label = 'EXECUTABLE' AS actionable, label = 'EXECUTABLE' AS may_be_called_arbitrage
    FROM ({COMPLETE_SCAN_SQL}) GROUP BY label"""


VERDICTS = ["VERIFIED_EQUIVALENT_STRICT", "VERIFIED_EQUIVALENT_STANDARD", "PROBABLE_MATCH", "RELATED_NOT_EQUIVALENT", "REJECTED"]


def cross_platform_scan(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    top = s.agg(F.max("s_suppkey").alias("top"))
    pairs = s.where(k % 2 == 0).crossJoin(F.broadcast(top)).where(k < F.col("top")).select(k.alias("pair_id"), k.alias("a"), (k + 1).alias("b"), F.element_at(F.array(*map(F.lit, VERDICTS)), (k % 10 / 2 + 1).cast("int")).alias("verdict"), (k % 3 == 0).alias("inverted"))
    out = R.cross_platform(A.levels(spark, sf_dir), pairs, _terms(spark, sf_dir), at(A.NOW))
    return out.select("pair_id", "side_a", "side_b", F.col("sets").cast("long").alias("sets"), *(shown(F.col(c), 4).alias(c) for c in RESULT), "label")


CROSS_SQL = f"""
    WITH {MATCHED},
    pr AS (SELECT s_suppkey AS pair, {VERDICTS}[s_suppkey % 10 // 2 + 1] AS verdict, sa, CASE WHEN s_suppkey % 3 = 0 THEN sa WHEN sa = 'yes' THEN 'no' ELSE 'yes' END AS sb
           FROM supplier, (SELECT unnest(['yes', 'no']) AS sa) WHERE s_suppkey % 2 = 0 AND s_suppkey < (SELECT max(s_suppkey) FROM supplier) AND s_suppkey % 10 // 2 < 4),
    st AS (SELECT pair, verdict, sa, sb, CAST(sum(least(a.hi, b.hi, 10000) - greatest(a.lo, b.lo)) AS HUGEINT) AS sets
           FROM pr JOIN iv a ON a.book_id = pair AND a.side = sa JOIN iv b ON b.book_id = pair + 1 AND b.side = sb AND a.lo < least(b.hi, 10000) AND b.lo < least(a.hi, 10000) WHERE a.cents + b.cents < 100 GROUP BY ALL),
    tg AS (SELECT pair || sa AS key, 'a' AS leg, sa AS side, pair AS k, sets FROM st UNION ALL SELECT pair || sa, 'b', sb, pair + 1, sets FROM st), {COSTED},
    dp AS (SELECT book_id, side, sum(size * cents) AS usd FROM lv WHERE is_ask GROUP BY ALL),
    g AS (SELECT key, sum(a4) AS a4, sum(spent) AS spent, sum(fee5) + sum(tick4 * sets * 10) + sum(transfer4 * sets * 10) AS extra5 FROM fn GROUP BY key),
    h AS (SELECT st.*, CAST(spent * 100 AS DOUBLE) AS gross4, CAST(spent * 1000 + extra5 + CAST(round(CAST(a4 AS DECIMAL(38,0)) * 0.05::DECIMAL(38,2) * CAST(round(greatest(pair % 60, (pair + 1) % 60) / 365.25, 10) AS DECIMAL(38,10)), 0) AS HUGEINT) * sets * 10 + 1000 * sets AS DOUBLE) AS total5,
                 least(da.usd, db.usd) AS depth FROM st JOIN g ON key = pair || sa JOIN dp da ON da.book_id = pair AND da.side = sa JOIN dp db ON db.book_id = pair + 1 AND db.side = sb),
    b AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(1 - total5 / CAST(sets AS DOUBLE) / 1e5, 4) DESC, sa DESC) AS r FROM h WHERE sets * 1e5 > total5 AND (sets * 1e5 - total5) / total5 >= CASE WHEN depth >= 200000 THEN 0.04 ELSE 0.05 END),
    l AS (SELECT *, CASE WHEN pair % 9 = 0 OR (pair + 1) % 9 = 0 THEN 'EXECUTION_RISK' WHEN total5 < 25e5 THEN 'INSUFFICIENT_LIQUIDITY' WHEN greatest(pair % 11, (pair + 1) % 11) * 60 > 300 THEN 'STALE_QUOTE'
                        ELSE ['EXECUTABLE', 'RULE_MISMATCH_RISK', 'RULE_MISMATCH_RISK', 'NOT_GUARANTEED'][pair % 10 // 2 + 1] END AS found FROM b WHERE r = 1)
    SELECT pair AS pair_id, sa AS side_a, sb AS side_b, CAST(sets AS BIGINT) AS sets, {RESULT_SQL}, CASE WHEN found = 'EXECUTABLE' AND abs(pair % 60 - (pair + 1) % 60) > 1 THEN 'EXECUTION_RISK' ELSE found END AS label FROM l"""


def multi_outcome_scan(spark, sf_dir):
    """Events of two thin books; the size is found by bisection, so the tests hold it against brute force."""
    k = F.col("book_id")
    legs = A.book_terms(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"))).withColumn("event_id", F.floor(k / 2)).withColumn("age", (k % 11 * 60).cast("double"))
    events = legs.groupBy("event_id").agg(F.count("*").alias("outcome_count")).withColumn("mutually_exclusive", F.lit(True)).withColumn("exhaustive", F.col("event_id") % 2 == 0).withColumn("negative_risk", F.col("event_id") % 5 == 0)
    out = R.multi_outcome(A.levels(spark, sf_dir, "l_orderkey"), legs.select("event_id", "book_id", "platform", "fee_rate", "fee_type", "tick_size", "age"), events)
    return out.select("event_id", "n_legs", shown(F.col("sets"), 2).alias("sets"), *(shown(F.col(c), 4).alias(c) for c in RESULT), "label")


def _tops(spark, sf_dir):
    t = books.top_of_book(A.levels(spark, sf_dir, "l_orderkey"), ["book_id"])
    return t.select("book_id", F.floor(F.col("book_id") / 8).alias("event_id"), (F.col("book_id") % 8).alias("strike"), "yes_ask")


TOPS = f"""{A.levels_sql("l_orderkey")}, tp AS (SELECT book_id, book_id // 8 AS event_id, book_id % 8 AS strike, min(cents) FILTER (side = 'yes' AND is_ask) AS ask FROM lv GROUP BY book_id)"""


def monotonicity(spark, sf_dir):
    out = R.monotonicity(_tops(spark, sf_dir).where("yes_ask IS NOT NULL"))
    return out.select("event_id", "weaker", "stronger", "weaker_strike", "stronger_strike", shown(F.col("gap")).alias("gap"))


MONO_SQL = f"""
    WITH {TOPS}, l AS (SELECT *, lag(book_id) OVER w AS wb, lag(ask) OVER w AS wa, lag(strike) OVER w AS ws FROM tp WHERE ask IS NOT NULL WINDOW w AS (PARTITION BY event_id ORDER BY strike, book_id))
    SELECT event_id, wb AS weaker, book_id AS stronger, ws AS weaker_strike, strike AS stronger_strike, round((ask - wa) / 100.0::DOUBLE, 6) AS gap FROM l WHERE ask - wa > 2"""


def exhaustive_sum(spark, sf_dir):
    out = R.exhaustive_sum(_tops(spark, sf_dir))
    return out.select("event_id", "n_legs", shown(F.col("total")).alias("total"), shown(F.col("deviation")).alias("deviation"))


SUM_SQL = f"""
    WITH {TOPS} SELECT event_id, count(ask) AS n_legs, CAST(sum(ask) AS DOUBLE) / 100 AS total, round(CAST(sum(ask) - 100 AS DOUBLE) / 100, 6) AS deviation
    FROM tp WHERE ask IS NOT NULL GROUP BY event_id HAVING count(ask) >= 2 AND abs(sum(ask) - 100) > 3"""


def stale_quotes(spark, sf_dir):
    w = Window.partitionBy("market_id").orderBy(F.desc("observed_at"), F.desc("event_id"))
    p = A.prices(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 2").withColumn("price", F.col("price").cast("decimal(10,6)"))
    moves = p.groupBy("market_id").agg(F.max(F.when(F.col("r") == 1, F.col("price"))).alias("mid"), F.max(F.when(F.col("r") == 2, F.col("price"))).alias("previous"))
    pairs = moves.where(F.col("market_id") % 2 == 0).select(F.col("market_id").alias("a"), (F.col("market_id") + 1).alias("b"))
    out = R.stale_quotes(moves, pairs)
    return out.select("leader", "laggard", shown(F.col("divergence")).alias("divergence"), "side")


STALE_SQL = f"""
    WITH {A.PRICES}, r AS (SELECT market_id, CAST(round(price * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY market_id ORDER BY observed_at DESC, event_id DESC) AS r FROM pr),
    m AS (SELECT market_id, max(c) FILTER (r = 1) AS mid, max(c) FILTER (r = 1) - max(c) FILTER (r = 2) AS mv FROM r WHERE r <= 2 GROUP BY market_id),
    e AS (SELECT market_id AS a, market_id + 1 AS b FROM m WHERE market_id % 2 = 0), d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)
    SELECT a AS leader, b AS laggard, round((x.mid - y.mid) / 100.0::DOUBLE, 6) AS divergence, CASE WHEN x.mid > y.mid THEN 'yes' ELSE 'no' END AS side
    FROM d JOIN m x ON x.market_id = a JOIN m y ON y.market_id = b WHERE abs(x.mv) >= 4 AND (y.mv IS NULL OR 2 * abs(y.mv) < abs(x.mv)) AND abs(x.mid - y.mid) >= 4"""

QUERIES = {
    "complete_set_scan": (complete_set_scan, COMPLETE_SCAN_SQL),
    "arbitrage_labels": (arbitrage_labels, LABELS_SQL),
    "cross_platform_scan": (cross_platform_scan, CROSS_SQL),
    "multi_outcome_scan": (multi_outcome_scan, None),
    "monotonicity": (monotonicity, MONO_SQL),
    "exhaustive_sum": (exhaustive_sum, SUM_SQL),
    "stale_quotes": (stale_quotes, STALE_SQL),
}
