"""Queries on sessions, single-category models, the past, summary costs, listings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import shown
from ..functions.special import normal_cdf_sql
from ..functions.timeops import at, humanized
from ..operators import books, calendar, cost, latest, models, probability, replay
from ..sources import feeds
from . import adapters as A
from . import arbitrage as arbitrage_plans
from . import probability as probability_plans
from . import relational as relational_plans

pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))


def _spans(spark, sf_dir):
    """Events a year later, each until up to four days after."""
    start = F.timestamp_add("DAY", F.lit(366), F.col("ts").cast("timestamp"))
    return A.table(spark, sf_dir, "events").select("event_id", start.alias("a"), F.timestamp_add("HOUR", (F.col("event_id") % 97).cast("int"), start).alias("b"))


def trading_hours(spark, sf_dir):
    """Cash and overnight hours of spans, and their length in years of volatility."""
    rows = _spans(spark, sf_dir).withColumn("cash", calendar.cash_hours(F.col("a"), F.col("b"))).withColumn("overnight", calendar.overnight_hours(F.col("a"), F.col("b")))
    return rows.select("event_id", shown(F.col("cash"), 4).alias("cash"), shown(F.col("overnight"), 4).alias("overnight"), shown(calendar.volatility_years(F.col("cash"), F.col("overnight"))).alias("years"))


#: The spans lie in winter, when New York is five hours behind; days are told by hand.
HOURS_SQL = f"""
    WITH e AS (SELECT event_id, CAST(ts AS TIMESTAMP) + INTERVAL 366 DAY - INTERVAL 5 HOUR AS a, CAST(ts AS TIMESTAMP) + INTERVAL 366 DAY - INTERVAL 5 HOUR + INTERVAL 1 HOUR * (event_id % 97) AS b FROM events),
    d AS (SELECT event_id, a, b, unnest(generate_series(date_trunc('day', a), date_trunc('day', b), INTERVAL 1 DAY)) AS day FROM e),
    c AS (SELECT event_id, sum(CASE WHEN isodow(day) < 6 AND NOT list_contains({list(calendar.HOLIDAYS)}, strftime(day, '%Y-%m-%d')) THEN greatest(0, epoch_us(least(b, day + INTERVAL 16 HOUR)) - epoch_us(greatest(a, day + INTERVAL 570 MINUTE))) ELSE 0 END) / 3.6e9 AS cash FROM d GROUP BY event_id),
    q AS (SELECT event_id, b, unnest(generate_series(a, b - INTERVAL 1 MICROSECOND, INTERVAL 15 MINUTE)) AS lo FROM e WHERE b > a),
    m AS (SELECT event_id, epoch_us(least(lo + INTERVAL 15 MINUTE, b)) - epoch_us(lo) AS w, make_timestamp((epoch_us(lo) + epoch_us(least(lo + INTERVAL 15 MINUTE, b))) // 2) AS mid FROM q),
    f AS (SELECT event_id, w, date_part('hour', mid) * 3600 + date_part('minute', mid) * 60 + floor(date_part('second', mid)) AS s, isodow(mid) AS dow, list_contains({list(calendar.HOLIDAYS)}, strftime(mid, '%Y-%m-%d')) AS off FROM m),
    o AS (SELECT event_id, sum(CASE WHEN CASE dow WHEN 6 THEN false WHEN 7 THEN s >= 64800 WHEN 5 THEN s < 61200 ELSE s < 61200 OR s >= 64800 END AND NOT (dow < 6 AND NOT off AND s >= 34200 AND s < 57600) THEN w ELSE 0 END) / 3.6e9 AS overnight FROM f GROUP BY event_id)
    SELECT c.event_id, round(cash, 4) AS cash, round(coalesce(overnight, 0), 4) AS overnight, round((cash + 0.1::DOUBLE * coalesce(overnight, 0)) / {calendar.YEAR_HOURS}::DOUBLE, 6) AS years FROM c LEFT JOIN o USING (event_id)"""

ASSETS = ["Bitcoin", "Ethereum", "Dogecoin", "Gold"]
WAYS = ["above", "below", "between", "to hit", "up or down,"]


def crypto_model(spark, sf_dir):
    """Parts as crypto contracts: spot from retail prices, strikes from titles or the venue, volatility and time from keys."""
    k, spot = F.col("p_partkey"), F.col("p_retailprice")
    strike = F.floor(spot * (0.7 + (k % 61) / 100)).cast("double")
    low, high = strike.cast("decimal(12,2)").cast("string"), (strike + 50).cast("decimal(12,2)").cast("string")
    shape = k % 5
    title = F.concat(pick(ASSETS, k % 4), F.lit(" "), pick(WAYS, shape), F.lit(" $"), low, F.when(shape == 2, F.concat(F.lit(" and $"), high)).otherwise(""), F.when(k % 50 == 7, " for $2m").otherwise(""))
    told = k % 3 == 0
    rows = A.table(spark, sf_dir, "part").select(
        k.alias("market_id"), title.alias("title"), F.when(told, pick(["greater", "less", "between", "greater", "greater"], shape)).alias("strike_type"), F.when(told & (shape != 1), strike).alias("floor"), F.when(told & shape.isin(1, 2), strike + 50).alias("cap"),
        F.when(k % 23 != 0, spot).alias("spot"), ((k % 50) / 100 + 0.1).alias("vol"), (k % 200 + 24).alias("n_returns"), ((k % 90) / 365.25).alias("years"),
    )
    out = models.crypto(rows)
    return out.select("market_id", F.coalesce("reason", F.lit("")).alias("reason"), *(shown(F.col(c), 5).alias(c) for c in ("probability", "confidence", "stdev")))


def _crypto_sql() -> str:
    n, mu, sd = normal_cdf_sql, "(-v * v / 2)", "(v * sqrt(y))"
    above = lambda b: f"CASE WHEN y <= 0 OR v <= 0 THEN CASE WHEN s > {b} THEN 1.0 ELSE 0.0 END ELSE {n(f'((ln(s / {b}) - v * v * y / 2) / {sd})')} END"
    h = "ln(lo / s)"
    up = f"({n(f'(({mu} * y - {h}) / {sd})')} + exp(2 * {mu} * {h} / (v * v)) * {n(f'((-{h} - {mu} * y) / {sd})')})"
    down = f"({n(f'(({h} - {mu} * y) / {sd})')} + exp(2 * {mu} * {h} / (v * v)) * {n(f'(({h} + {mu} * y) / {sd})')})"
    touch = f"CASE WHEN lo = s THEN 1.0 WHEN y <= 0 THEN 0.0 ELSE least(greatest(CASE WHEN lo >= s THEN {up} ELSE {down} END, 0.0), 1.0) END"
    return f"""
    WITH k AS (SELECT p_partkey AS id, p_partkey % 5 AS sh, p_partkey % 3 = 0 AS told, p_partkey % 4 AS asset, CASE WHEN p_partkey % 23 <> 0 THEN p_retailprice END AS s, floor(p_retailprice * (0.7::DOUBLE + (p_partkey % 61) / 100.0::DOUBLE)) AS st, (p_partkey % 50) / 100.0::DOUBLE + 0.1::DOUBLE AS v0, p_partkey % 200 + 24 AS n, (p_partkey % 90) / 365.25::DOUBLE AS y FROM part),
    b AS (SELECT *, CASE WHEN told AND sh = 1 THEN st + 50 ELSE st END AS lo, CASE WHEN sh = 2 THEN st + 50 END AS hi FROM k),
    r AS (SELECT *, CASE WHEN asset = 3 THEN 'no_asset' WHEN sh = 4 THEN 'directional' WHEN lo <= 0 THEN 'no_strike' WHEN y <= 0 THEN 'no_time' WHEN s IS NULL THEN 'no_data' WHEN NOT told AND (lo / s NOT BETWEEN 0.02 AND 50 OR coalesce(hi / s NOT BETWEEN 0.02 AND 50, false)) THEN 'implausible_strike' ELSE '' END AS reason FROM b),
    a AS (SELECT *, unnest([0, 1, 2]) AS i, unnest([v0, greatest(v0 - v0 / sqrt(2.0::DOUBLE * n), 1e-6), v0 + v0 / sqrt(2.0::DOUBLE * n)]) AS v FROM r),
    p AS (SELECT *, CASE WHEN reason <> '' THEN NULL WHEN sh = 3 THEN {touch} WHEN sh = 2 THEN greatest({above('lo')} - ({above('hi')}), 0.0) WHEN sh = 1 THEN 1 - ({above('lo')}) ELSE {above('lo')} END AS p FROM a),
    g AS (SELECT id, any_value(reason) AS reason, any_value(y) * 24 * 365.25::DOUBLE AS hours, max(p) FILTER (i = 0) AS p, abs(max(p) FILTER (i = 2) - max(p) FILTER (i = 1)) AS sp FROM p GROUP BY id)
    SELECT id AS market_id, reason, CASE WHEN p IS NOT NULL THEN round(least(greatest(p, 1e-6), 1 - 1e-6), 5) END AS probability, CASE WHEN p IS NOT NULL THEN round(0.68::DOUBLE * CASE WHEN hours <= 48 THEN 1.0 ELSE greatest(48 / hours, 0.35) END * CASE WHEN p < 0.02 OR p > 0.98 THEN 0.5 ELSE 1 END, 5) END AS confidence,
           CASE WHEN p IS NOT NULL THEN round(greatest(sp / 2, 0.01), 5) END AS stdev FROM g"""


def tail_anchors(spark, sf_dir):
    """Prices in the tails, drawn on; the rest gives no opinion, nor do categories without a source."""
    k = F.col("o_orderkey")
    price, category = (k % 400 + 1) / 401, pick([*models.UNSOURCED, "crypto"], k % 7)
    unsourced = F.element_at(F.create_map(*(F.lit(x) for pair in models.UNSOURCED.items() for x in pair)), category)
    rows = A.table(spark, sf_dir, "orders").select(k.alias("market_id"), shown(models.tail_anchor(price)).alias("anchor"), unsourced.alias("declined"))
    return rows.where("anchor IS NOT NULL OR declined IS NOT NULL")


_NAMES = [*models.UNSOURCED, "crypto"]
TAIL_SQL = f"""
    WITH k AS (SELECT o_orderkey AS market_id, (o_orderkey % 400 + 1) / 401.0::DOUBLE AS p, {_NAMES}[o_orderkey % 7 + 1] AS c FROM orders),
    t AS (SELECT market_id, CASE WHEN p < 0.02 THEN round(greatest(p * 0.9::DOUBLE, 1e-6), 6) WHEN p > 0.98 THEN round(1 - (1 - p) * 0.9::DOUBLE, 6) END AS anchor, CASE WHEN c IN ('politics', 'geopolitics') THEN 'politics_unsourced' WHEN c <> 'crypto' THEN 'generic_unsourced' END AS declined FROM k)
    SELECT * FROM t WHERE anchor IS NOT NULL OR declined IS NOT NULL"""


def lookahead_guard(spark, sf_dir):
    """Opinions that may be used, asked about the present and about the past, by component."""
    k = F.col("o_orderkey")
    o = A.table(spark, sf_dir, "orders").select(pick(probability_plans.NAMES, k % len(probability_plans.NAMES)).alias("component"), F.when(k % 2 == 0, F.col("o_orderdate").cast("timestamp")).alias("as_of"))
    ok = models.allowed(F.col("component"), F.col("as_of"))
    return o.groupBy("component").agg(F.count(F.when(ok, 1)).alias("used"), F.count(F.when(~ok, 1)).alias("declined"))


GUARD_SQL = f"""
    WITH o AS (SELECT {probability_plans.NAMES}[o_orderkey % {len(probability_plans.NAMES)} + 1] AS component, o_orderkey % 2 = 0 AS past FROM orders)
    SELECT component, count(*) FILTER (NOT past OR component IN {models.WITH_PAST}) AS used, count(*) FILTER (past AND component NOT IN {models.WITH_PAST}) AS declined FROM o GROUP BY component"""


def evidence(spark, sf_dir):
    """Lines as research sources of their order: quality by novelty, and the confidence that it leaves."""
    li = A.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("quality"), (F.col("l_returnflag") != "N").alias("is_novel"))
    q = models.evidence_quality(li, "l_orderkey")
    return q.select("l_orderkey", "n_novel", shown(F.col("quality"), 5).alias("quality"), shown(models.research_confidence((F.col("l_orderkey") % 10) / 10, F.col("quality")), 5).alias("confidence"))


EVIDENCE_SQL = """
    WITH g AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N') AS n, max(l_discount * 10) FILTER (l_returnflag <> 'N') AS b, max(l_discount * 10) AS m FROM lineitem GROUP BY l_orderkey),
    q AS (SELECT l_orderkey, n, CASE WHEN n > 0 THEN least(1.0, b * (0.7::DOUBLE + 0.3::DOUBLE * least(n / 3.0::DOUBLE, 1.0))) ELSE least(0.25, m) END AS q FROM g)
    SELECT l_orderkey, n AS n_novel, round(q, 5) AS quality, round(least(0.35, l_orderkey % 10 / 10.0::DOUBLE * q), 5) AS confidence FROM q"""


def explanations(spark, sf_dir):
    """The three most trusted components of each market's estimate."""
    return models.explanation(probability_plans._opinions(spark, sf_dir), "market_id")


EXPLAIN_SQL = f"""
    WITH {probability_plans.OPINIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY w DESC, component) AS i FROM op)
    SELECT market_id, string_agg(component || ' ' || printf('%.3f', p), '; ' ORDER BY i) AS explanation FROM r WHERE i <= 3 GROUP BY market_id"""


def _past(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    return A.table(spark, sf_dir, "orders").select(
        k.alias("market_id"), F.col("o_custkey").alias("event_id"), F.when(k % 2 == 0, "kalshi").otherwise("polymarket").alias("platform"), pick(["crypto", "finance", "weather", "sports"], k % 4).alias("category"),
        F.when(k % 6 != 0, F.timestamp_add("DAY", F.lit(-200), day)).alias("opens"), F.when(k % 5 != 0, day).alias("closes"), F.when(k % 7 != 0, F.timestamp_add("DAY", F.lit(3), day)).alias("resolves"),
        F.col("o_orderstatus").alias("status"), F.when(k % 3 != 0, "yes").alias("result"), F.when(k % 3 != 0, F.timestamp_add("DAY", F.lit(4), day)).alias("settled_at"), ((k % 5) / 4).alias("payout"),
        F.col("o_totalprice").alias("volume"), (k % 11 == 0).alias("disputed"), F.when(k % 13 == 0, "demo").otherwise("live").alias("provenance"),
    )


def rewind(spark, sf_dir):
    """Orders as markets, as they were at the start of 1997: who may be asked about, and what was cleared."""
    r = replay.rewound(_past(spark, sf_dir), at("1997-01-01 00:00:00"))
    return r.select("market_id", "category", "status", F.array_join("cleared", ",").alias("cleared"), F.coalesce("refused", F.lit("")).alias("refused"))


PAST = """pt AS (SELECT o_orderkey AS k, ['crypto', 'finance', 'weather', 'sports'][o_orderkey % 4 + 1] AS category, CAST(o_orderdate AS TIMESTAMP) AS day, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) - INTERVAL 200 DAY END AS opens,
        CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS closes, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 3 DAY END AS resolves, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 4 DAY END AS settled FROM orders)"""
REWIND_SQL = f"""
    WITH {PAST}
    SELECT k AS market_id, category, 'open' AS status, CASE WHEN k % 3 <> 0 THEN 'disputed,payout,result,settled_at,volume' ELSE 'disputed,payout,volume' END AS cleared,
           CASE WHEN TIMESTAMP '1997-01-01' < opens THEN 'before_open' WHEN TIMESTAMP '1997-01-01' >= coalesce(closes, resolves) THEN 'after_close' ELSE '' END AS refused FROM pt"""


def settled_sample(spark, sf_dir):
    """The newest settled markets that may be scored."""
    s = replay.settled_sample(_past(spark, sf_dir), ["crypto", "finance"], at("1997-06-01 00:00:00"))
    return s.select("market_id", "category", shown(F.col("outcome"), 2).alias("outcome"), F.unix_seconds("settled_at").alias("settled_at"))


SAMPLE_SQL = f"""
    WITH {PAST}
    SELECT k AS market_id, category, k % 5 / 4.0::DOUBLE AS outcome, CAST(epoch(settled) AS BIGINT) AS settled_at FROM pt
    WHERE k % 13 <> 0 AND k % 11 <> 0 AND category IN ('crypto', 'finance') AND settled BETWEEN TIMESTAMP '1997-06-01' - INTERVAL 60 DAY AND TIMESTAMP '1997-06-01' AND k % 5 IN (0, 2, 4) AND o_totalprice >= 1000 AND (resolves IS NOT NULL OR closes IS NOT NULL)
    ORDER BY settled DESC, k LIMIT 200"""


def entry_evidence(spark, sf_dir):
    """What the market gave a side at entry, from frozen evidence, and the decision for NO from a stored report."""
    k = F.col("o_orderkey")
    proof = F.when(k % 4 != 0, F.concat(F.lit('{"implied_yes": '), ((k % 90 + 5) / 100).cast("decimal(4,2)").cast("string"), F.lit("}"))).otherwise("{}")
    report = F.when(k % 3 != 0, F.concat(F.lit('{"conservative_decision_probability_no": "'), ((k % 80) / 100).cast("decimal(4,2)").cast("string"), F.lit('"}')))
    side = F.when(k % 2 == 0, "yes").otherwise("no")
    return A.table(spark, sf_dir, "orders").select(k.alias("market_id"), shown(replay.entry_probability(proof, side, (k % 99 + 1) / 100), 4).alias("market_p"), shown(replay.no_side_probability(report), 4).alias("decision_no"))


ENTRY_SQL = """
    SELECT o_orderkey AS market_id, round(CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 99 + 1) / 100.0::DOUBLE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 90 + 5) / 100.0::DOUBLE ELSE 1 - (o_orderkey % 90 + 5) / 100.0::DOUBLE END, 4) AS market_p,
           CASE WHEN o_orderkey % 3 <> 0 THEN round((o_orderkey % 80) / 100.0::DOUBLE, 4) END AS decision_no FROM orders"""


def immutable_fields(spark, sf_dir):
    """Frozen columns of recommendations that a later copy has changed."""
    s = A.snapshots(spark, sf_dir).select("snapshot_id", "cost", "p_side", "side")
    k = F.col("snapshot_id")
    later = s.withColumn("cost", F.when(k % 17 == 0, F.col("cost") + F.lit(0.01).cast("decimal(4,2)")).otherwise(F.col("cost"))).withColumn("side", F.when(k % 19 == 0, F.lit(None)).otherwise(F.col("side")))
    return replay.changed_immutable(s, later, "snapshot_id", ["cost", "p_side", "side"]).withColumn("changed", F.array_join("changed", ","))


IMMUTABLE_SQL = f"""
    WITH {A.SNAPSHOTS} SELECT snapshot_id, CASE WHEN snapshot_id % 17 = 0 AND snapshot_id % 19 = 0 THEN 'cost,side' WHEN snapshot_id % 17 = 0 THEN 'cost' ELSE 'side' END AS changed FROM sn WHERE snapshot_id % 17 = 0 OR snapshot_id % 19 = 0"""


def summary_costs(spark, sf_dir):
    """What a contract costs at each size where only the best price is known: the impact of depth stays unknown."""
    tops = books.asks(A.levels(spark, sf_dir)).groupBy("book_id", "side").agg(F.min("price").alias("average"))
    sized = tops.withColumn("filled", F.explode(F.array(*map(F.lit, cost.LADDER_SIZES)))).withColumn("filled", F.col("filled").cast("decimal(18,6)"))
    c = cost.breakdown(A.book_terms(sized), at(A.NOW))
    return c.select("book_id", "side", F.col("filled").cast("long").alias("size"), *(shown(F.col(p)).alias(p) for p in ("entry_price", "platform_fee", "fee_rounding", "slippage", "transfer_cost", "capital_cost", "total_cost")), (F.col("filled") < F.col("min_size")).alias("below_min"), F.lit(None).cast("double").alias("depth_impact"))


SUMMARY_SQL = f"""
    WITH {A.levels_sql()}, wk AS (SELECT book_id, side, req, CAST(req AS HUGEINT) AS filled, CAST(nominal AS HUGEINT) AS a4 FROM (SELECT book_id, side, 100 * min(cents) AS nominal FROM lv WHERE is_ask GROUP BY ALL), (SELECT unnest({list(cost.LADDER_SIZES)}) AS req)), {A.costs_sql()}
    SELECT book_id, side, CAST(req AS BIGINT) AS size, a4 / 1e4 AS entry_price, fee / 1e4 AS platform_fee, rounding / 1e4 AS fee_rounding, slippage / 1e4 AS slippage, transfer / 1e4 AS transfer_cost, capital / 1e4 AS capital_cost,
           round((a4 + fee + rounding + transfer + capital + slippage) / 1e4, 6) AS total_cost, req < CASE WHEN book_id % 2 = 0 THEN 1 ELSE 5 END AS below_min, CAST(NULL AS DOUBLE) AS depth_impact FROM co"""


def cost_caveats(spark, sf_dir):
    """What a reader of a cost must know, by market, as codes."""
    k = F.col("book_id")
    rows = A.book_terms(A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("book_id")))
    rows = rows.withColumn("source", F.when(k % 3 == 0, "summary").otherwise("orderbook")).withColumn("age", k % 8 * 600)
    return rows.select("book_id", F.array_join(cost.caveats(), ",").alias("caveats"), F.when(cost.stale(F.col("age")), humanized(F.col("age"))).alias("observed"))


CAVEATS_SQL = """
    SELECT s_suppkey AS book_id, array_to_string(list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'depth_unknown' END, CASE WHEN s_suppkey % 8 * 600 > 1800 THEN 'stale_quote' END, CASE WHEN s_suppkey % 2 = 0 THEN 'fee_rounds_up_on_the_order' ELSE 'transfer_is_shared' END,
           CASE WHEN s_suppkey % 2 = 1 THEN 'minimum_order' END, 'capital_is_locked_up', 'slippage_is_assumed'], lambda x: x IS NOT NULL), ',') AS caveats,
           CASE WHEN s_suppkey % 8 * 600 > 3540 THEN '1h' WHEN s_suppkey % 8 * 600 > 1800 THEN s_suppkey % 8 * 10 || 'm' END AS observed FROM supplier"""


def market_detail(spark, sf_dir):
    """A row for each market with its event's size, last price, best quotes, five deepest levels and settlement."""
    m = A.markets(spark, sf_dir).withColumn("n_siblings", F.count("*").over(Window.partitionBy("event_id")) - 1)
    lv = A.levels(spark, sf_dir, "l_orderkey")
    top = books.top_of_book(lv, ["book_id"]).select(F.col("book_id").alias("market_id"), "yes_bid", "yes_ask")
    depth = lv.where("is_ask").groupBy(F.col("book_id").alias("market_id")).agg(F.count("*").alias("n_levels"), F.sum("size").cast("long").alias("ask_size"))
    last = latest.latest(A.prices(spark, sf_dir).select("market_id", "observed_at", "event_id", "price"), ["market_id"], ["observed_at", "event_id"]).select("market_id", F.col("price").alias("last_price"))
    settled = A.snapshots(spark, sf_dir).select(F.col("snapshot_id").alias("market_id"), "result")
    out = m
    for other in (top, depth, last, settled):
        out = out.join(other, "market_id", "left")
    return out.select("market_id", "event_id", "platform", "category", "status", "n_siblings", shown(F.col("yes_bid"), 4).alias("yes_bid"), shown(F.col("yes_ask"), 4).alias("yes_ask"), "n_levels", "ask_size", shown(F.col("last_price"), 4).alias("last_price"), "result")


DETAIL_SQL = f"""
    WITH {A.MARKETS}, {A.levels_sql("l_orderkey")}, {A.PRICES}, {A.SNAPSHOTS},
    tp AS (SELECT book_id, min(cents) FILTER (side = 'yes' AND is_ask) AS ask, max(cents) FILTER (side = 'yes' AND NOT is_ask) AS bid FROM lv GROUP BY book_id),
    dp AS (SELECT book_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS sz FROM lv WHERE is_ask GROUP BY book_id),
    la AS (SELECT market_id, arg_max(price, epoch_us(observed_at) * 10000000::HUGEINT + event_id) AS p FROM pr GROUP BY market_id)
    SELECT mk.market_id, event_id, platform, category, status, count(*) OVER (PARTITION BY event_id) - 1 AS n_siblings, bid / 100.0::DOUBLE AS yes_bid, ask / 100.0::DOUBLE AS yes_ask, dp.n AS n_levels, dp.sz AS ask_size, round(la.p, 4) AS last_price, sn.result
    FROM mk LEFT JOIN tp ON tp.book_id = mk.market_id LEFT JOIN dp ON dp.book_id = mk.market_id LEFT JOIN la ON la.market_id = mk.market_id LEFT JOIN (SELECT snapshot_id, result FROM sn) sn ON sn.snapshot_id = mk.market_id"""


def watchlist(spark, sf_dir):
    """Markets scored on nothing but their own price: the latest prediction of each, newest first."""
    k = F.col("o_orderkey")
    p = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("market_id"), k.alias("created"), (k % 3 == 0).alias("independent"), ((k * 17 % 90 + 5) / 100).alias("mean"))
    last = latest.latest(p.where("NOT independent"), ["market_id"], ["created"])
    return last.select("market_id", "created", shown(F.col("mean"), 4).alias("mean")).orderBy(F.desc("created")).limit(25)


WATCH_SQL = """
    SELECT o_custkey AS market_id, max(o_orderkey) AS created, round((max(o_orderkey) * 17 % 90 + 5) / 100.0::DOUBLE, 4) AS mean FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey ORDER BY created DESC LIMIT 25"""


def arbitrage_report(spark, sf_dir):
    """All scans of one batch: how many results of each kind and label."""
    named = lambda df, kind, label=None: df.select(F.lit(kind).alias("kind"), label if label is not None else F.col("label"))
    watch = F.lit("NOT_GUARANTEED").alias("label")
    scans = [
        named(arbitrage_plans.complete_set_scan(spark, sf_dir), "complete_set"),
        named(arbitrage_plans.cross_platform_scan(spark, sf_dir), "cross_platform"),
        named(arbitrage_plans.monotonicity(spark, sf_dir), "monotonicity", watch),
        named(arbitrage_plans.exhaustive_sum(spark, sf_dir), "exhaustive_sum", watch),
        named(arbitrage_plans.stale_quotes(spark, sf_dir), "stale_quote", F.lit("STALE_QUOTE").alias("label")),
    ]
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out.groupBy("kind", "label").agg(F.count("*").alias("n"))


REPORT_SQL = f"""
    SELECT kind, label, count(*) AS n FROM (
        SELECT 'complete_set' AS kind, label FROM ({arbitrage_plans.COMPLETE_SCAN_SQL}) UNION ALL SELECT 'cross_platform', label FROM ({arbitrage_plans.CROSS_SQL})
        UNION ALL SELECT 'monotonicity', 'NOT_GUARANTEED' FROM ({arbitrage_plans.MONO_SQL}) UNION ALL SELECT 'exhaustive_sum', 'NOT_GUARANTEED' FROM ({arbitrage_plans.SUM_SQL}) UNION ALL SELECT 'stale_quote', 'STALE_QUOTE' FROM ({arbitrage_plans.STALE_SQL}))
    GROUP BY ALL"""


def digest(spark, sf_dir):
    """What a daily digest says of candidates: refusals by reason, stale quotes held back after 30 minutes, and the rest."""
    c = relational_plans._candidates(spark, sf_dir)
    why = F.coalesce("reason", F.when(F.col("data_age") > 1800, "stale_quote"), F.lit("candidate"))
    return c.groupBy("horizon", why.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("market_id").alias("markets"))


DIGEST_SQL = f"""
    WITH {relational_plans.CANDIDATE_SQL}
    SELECT horizon, coalesce(reason, CASE WHEN da > 1800 THEN 'stale_quote' END, 'candidate') AS outcome, count(*) AS n, count(DISTINCT k) AS markets FROM cs GROUP BY ALL"""


def trade_sample(spark, sf_dir):
    """Trades of the 25 markets of largest volume on each venue, the newest 50 of each."""
    k = F.col("l_orderkey")
    vol = A.markets(spark, sf_dir).select("market_id", "platform", "volume")
    top = latest.top_per_group(vol, ["platform"], [F.desc("volume"), F.col("market_id")], 25)
    trades = A.table(spark, sf_dir, "lineitem").select(k.alias("market_id"), "l_linenumber", "l_partkey", F.col("l_shipdate").cast("timestamp").alias("at"))
    out = latest.top_per_group(trades.join(F.broadcast(top.select("market_id", "platform")), "market_id"), ["market_id"], [F.desc("at"), F.col("l_linenumber"), F.col("l_partkey")], 50)
    return out.groupBy("platform", "market_id").agg(F.count("*").alias("n"), F.unix_seconds(F.max("at")).alias("last"))


TRADE_SQL = f"""
    WITH {A.MARKETS}, t AS (SELECT market_id, platform FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY volume DESC, market_id) AS r FROM mk) WHERE r <= 25)
    SELECT platform, market_id, least(count(*), 50) AS n, CAST(epoch(max(CAST(l_shipdate AS TIMESTAMP))) AS BIGINT) AS last FROM lineitem JOIN t ON l_orderkey = market_id GROUP BY ALL"""


def missing_economics(spark, sf_dir):
    """Required columns that markets lack, by name."""
    p = _past(spark, sf_dir)
    rows = p.select(F.explode(replay.missing_economics(["opens", "closes", "resolves", "result", "volume"])).alias("field"))
    return rows.groupBy("field").agg(F.count("*").alias("n"))


MISSING_SQL = f"""
    WITH {PAST} SELECT field, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN opens IS NULL THEN 'opens' END, CASE WHEN closes IS NULL THEN 'closes' END, CASE WHEN resolves IS NULL THEN 'resolves' END, CASE WHEN k % 3 = 0 THEN 'result' END, CASE WHEN o_totalprice IS NULL THEN 'volume' END], lambda x: x IS NOT NULL)) AS field FROM pt) GROUP BY field"""


def related_markets(spark, sf_dir):
    """The mean price of the other markets of an event, and the little confidence that it has."""
    k = F.col("o_orderkey")
    rows = A.table(spark, sf_dir, "orders").select(k.alias("market_id"), F.col("o_custkey").alias("event_id"), F.when(k % 8 != 0, ((k % 97 + 1) / F.lit(100).cast("decimal(3,0)")).cast("decimal(6,4)")).alias("price"))
    sib = latest.siblings(rows.where("price IS NOT NULL"), "event_id", "price").where("n_siblings > 0")
    n = F.col("n_siblings")
    return sib.select("market_id", n.alias("n"), shown(F.col("sibling_sum"), 2).alias("total"), F.floor(F.col("sibling_sum") * 10000 / n).cast("long").alias("mean_in_10000ths"), shown(probability.related(n), 4).alias("confidence"))


RELATED_SQL = """
    WITH r AS (SELECT o_orderkey AS k, o_orderkey % 97 + 1 AS c, sum(o_orderkey % 97 + 1) OVER w AS s, count(*) OVER w AS n FROM orders WHERE o_orderkey % 8 <> 0 WINDOW w AS (PARTITION BY o_custkey))
    SELECT k AS market_id, n - 1 AS n, round(CAST(s - c AS DOUBLE) / 100.0::DOUBLE, 2) AS total, CAST((s - c) * 100 // (n - 1) AS BIGINT) AS mean_in_10000ths, round(least(0.3::DOUBLE, 0.12::DOUBLE * (n - 1)), 4) AS confidence FROM r WHERE n > 1"""


def market_rules(spark, sf_dir):
    """The moment that settles each market: when its event occurs, else its resolution, else its close; and its strike: floor, else cap."""
    k = F.col("market_id")
    p = _past(spark, sf_dir).withColumn("occurs", F.when(k % 4 == 0, F.timestamp_add("HOUR", F.lit(5), F.col("resolves")))).withColumn("floor", F.when(k % 3 == 0, k % 100)).withColumn("cap", F.when(k % 5 == 0, k % 100 + 10))
    return p.select("market_id", F.unix_seconds(F.coalesce("occurs", "resolves", "closes")).alias("cutoff"), F.coalesce("floor", "cap").alias("strike"))


RULES_SQL = f"""
    WITH {PAST} SELECT k AS market_id, CAST(epoch(coalesce(CASE WHEN k % 4 = 0 THEN resolves + INTERVAL 5 HOUR END, resolves, closes)) AS BIGINT) AS cutoff, CASE WHEN k % 3 = 0 THEN k % 100 WHEN k % 5 = 0 THEN k % 100 + 10 END AS strike FROM pt"""

NAMED = ["S&P 500 above 5,000", "Nasdaq-100 close", "Dow Jones on Friday", "Russell 2000", "VIX over 20", "High in New York City", "Rain in York", "Nothing known"]
PLACES = ["york", "new york city", "new york", "chicago"]


def detections(spark, sf_dir):
    """Which index or place the titles of suppliers' markets name."""
    title = F.concat(pick(NAMED, F.col("s_suppkey") % len(NAMED)), F.lit(" "), F.col("s_name"))
    rows = A.table(spark, sf_dir, "supplier").select("s_suppkey", models.index_of(title).alias("i"), models.longest_named(title, PLACES).alias("place"))
    return rows.select("s_suppkey", F.col("i.cash").alias("cash"), F.col("i.futures").alias("futures"), "place")


DETECT_SQL = """
    WITH k AS (SELECT s_suppkey, s_suppkey % 8 AS m FROM supplier)
    SELECT s_suppkey, CASE WHEN m < 5 THEN ['^GSPC', '^NDX', '^DJI', '^RUT', '^VIX'][m + 1] END AS cash, CASE WHEN m < 4 THEN ['ES=F', 'NQ=F', 'YM=F', 'RTY=F'][m + 1] END AS futures, CASE m WHEN 5 THEN 'new york city' WHEN 6 THEN 'york' END AS place FROM k"""


def kept_levels(spark, sf_dir):
    """Books as they are stored: at most 25 levels of each side, best first."""
    lv = A.levels(spark, sf_dir)
    order = F.when(F.col("is_ask"), F.col("price")).otherwise(-F.col("price"))
    kept = latest.top_per_group(lv.where("size > 0"), ["book_id", "side", "is_ask"], [order], books.KEPT_LEVELS)
    return kept.groupBy("book_id", "side", "is_ask").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("size"), shown(F.min("price"), 4).alias("low"), shown(F.max("price"), 4).alias("high"))


KEPT_SQL = f"""
    WITH {A.levels_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, side, is_ask ORDER BY CASE WHEN is_ask THEN cents ELSE -cents END) AS i FROM lv)
    SELECT book_id, side, is_ask, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, min(cents) / 100.0::DOUBLE AS low, max(cents) / 100.0::DOUBLE AS high FROM r WHERE i <= 25 GROUP BY ALL"""


def snapshot_pruning(spark, sf_dir):
    """Markets that a published snapshot keeps: those that recommendations, trades or prices name, by what they are."""
    m = A.markets(spark, sf_dir)
    names = [A.snapshots(spark, sf_dir).where("rank <= 2").select("snapshot_id"), A.table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select("l_orderkey"), A.prices(spark, sf_dir).select("market_id")]
    kept = feeds.purged(feeds.reachable(m, "market_id", names))
    return kept.groupBy("platform", "status").agg(F.count("*").alias("n"), F.sum("market_id").alias("total"))


PRUNE_SQL = f"""
    WITH {A.MARKETS}, {A.SNAPSHOTS}, k AS (SELECT snapshot_id AS id FROM sn WHERE rank <= 2 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45 UNION SELECT user_id FROM events)
    SELECT platform, status, count(*) AS n, CAST(sum(market_id) AS BIGINT) AS total FROM mk WHERE market_id IN (SELECT id FROM k) AND provenance <> 'demo' GROUP BY ALL"""


def set_operations(spark, sf_dir):
    """Customers with open orders, with finished ones, with both, and with open ones only."""
    o = A.table(spark, sf_dir, "orders")
    ids = lambda status: o.where(F.col("o_orderstatus") == status).select("o_custkey")
    sets = {"union": ids("O").union(ids("F")).distinct(), "union_all": ids("O").unionAll(ids("F")), "intersect": ids("O").intersect(ids("F")), "except": ids("O").exceptAll(ids("F")).distinct().join(ids("F").distinct(), "o_custkey", "left_anti")}
    out = None
    for name, df in sets.items():
        part = df.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total")).select(F.lit(name).alias("operation"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


SET_SQL = """
    WITH a AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    SELECT 'union' AS operation, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM (FROM a UNION FROM b) UNION ALL SELECT 'union_all', count(*), CAST(sum(o_custkey) AS BIGINT) FROM (FROM a UNION ALL FROM b)
    UNION ALL SELECT 'intersect', count(*), CAST(sum(o_custkey) AS BIGINT) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', count(*), CAST(sum(o_custkey) AS BIGINT) FROM (FROM a EXCEPT FROM b)"""

QUERIES = {
    "trading_hours": (trading_hours, HOURS_SQL),
    "crypto_model": (crypto_model, _crypto_sql()),
    "tail_anchors": (tail_anchors, TAIL_SQL),
    "lookahead_guard": (lookahead_guard, GUARD_SQL),
    "evidence": (evidence, EVIDENCE_SQL),
    "explanations": (explanations, EXPLAIN_SQL),
    "rewind": (rewind, REWIND_SQL),
    "settled_sample": (settled_sample, SAMPLE_SQL),
    "entry_evidence": (entry_evidence, ENTRY_SQL),
    "immutable_fields": (immutable_fields, IMMUTABLE_SQL),
    "summary_costs": (summary_costs, SUMMARY_SQL),
    "cost_caveats": (cost_caveats, CAVEATS_SQL),
    "market_detail": (market_detail, DETAIL_SQL),
    "watchlist": (watchlist, WATCH_SQL),
    "arbitrage_report": (arbitrage_report, REPORT_SQL),
    "digest": (digest, DIGEST_SQL),
    "trade_sample": (trade_sample, TRADE_SQL),
    "missing_economics": (missing_economics, MISSING_SQL),
    "set_operations": (set_operations, SET_SQL),
    "related_markets": (related_markets, RELATED_SQL),
    "market_rules": (market_rules, RULES_SQL),
    "detections": (detections, DETECT_SQL),
    "kept_levels": (kept_levels, KEPT_SQL),
    "snapshot_pruning": (snapshot_pruning, PRUNE_SQL),
}
