"""Queries on fees, order books and executable cost."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import PRICE, dec, shown, snap_to_tick
from ..functions.timeops import age_seconds, at
from ..operators import baskets, books, cost, fees
from . import adapters as A


def fee_schedule(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    price = ((F.col("p_partkey") % 99 + 1) / F.lit(100).cast("decimal(3,0)")).cast(PRICE)
    rows = p.select("p_partkey", F.col("p_size").alias("contracts"), price.alias("price"), dec("0.07", "decimal(8,6)").alias("rate"), F.when(F.col("p_partkey") % 2 == 0, "kalshi").otherwise("polymarket").alias("platform"), F.when(F.col("p_partkey") % 6 == 0, "flat").otherwise("quadratic").alias("fee_type"))
    args = [F.col(c) for c in ("platform", "contracts", "price", "rate", "fee_type")]
    return rows.select("p_partkey", "platform", shown(fees.taker_fee(*args), 5).alias("taker"), shown(fees.maker_fee(F.col("contracts"), F.col("price")), 5).alias("maker"), shown(fees.fee_per_contract(*args), 8).alias("each"), shown(fees.rounding_cost(*args), 8).alias("rounding"), shown(fees.settlement_fee()).alias("settlement"))


FEES_SQL = """
    WITH r AS (SELECT p_partkey, CAST(p_size AS HUGEINT) AS c, CAST(p_partkey % 99 + 1 AS HUGEINT) AS p, p_partkey % 2 = 0 AS k, p_partkey % 6 = 0 AS flat FROM part),
    n AS (SELECT *, 700 * c * p * (100 - p) AS n, 175 * c * p * (100 - p) AS m FROM r),
    f AS (SELECT *, CASE WHEN flat THEN 7 * c * 1000000 WHEN k THEN (n + 999999) // 1000000 * 1000000 ELSE (2 * n + 1000) // 2000 * 1000 END AS t, (m + 999999) // 1000000 AS mk FROM n)
    SELECT p_partkey, CASE WHEN k THEN 'kalshi' ELSE 'polymarket' END AS platform, round(CAST(t AS DOUBLE) / 1e8, 5) AS taker, round(CAST(mk AS DOUBLE) / 100, 5) AS maker,
           round(CAST(t AS DOUBLE) / 1e8 / c, 8) AS each, CASE WHEN flat THEN 0.0 ELSE round(CAST(t - n AS DOUBLE) / 1e8 / c, 8) END AS rounding, 0.0::DOUBLE AS settlement
    FROM f"""


def walk_book(spark, sf_dir):
    ladder = books.asks(A.levels(spark, sf_dir))
    out = books.walk(ladder, ["book_id", "side"], F.array(*map(F.lit, books.STANDARD_SIZES)))
    return out.select("book_id", "side", F.col("requested").cast("long").alias("requested"), F.col("filled").cast("long").alias("filled"), shown(F.col("notional")).alias("notional"), shown(F.col("average")).alias("average"), shown(F.col("worst")).alias("worst"), "n_levels", "fully_filled")


WALK_SQL = f"""
    WITH {A.walk_sql([10, 50, 100])}
    SELECT book_id, side, CAST(req AS BIGINT) AS requested, CAST(filled AS BIGINT) AS filled, round(CAST(spent AS DOUBLE) / 100, 6) AS notional, round(CAST(a4 AS DOUBLE) / 10000, 6) AS average,
           round(CAST(worst AS DOUBLE) / 100, 6) AS worst, n_levels, filled >= req AS fully_filled FROM wk"""


def walk_thin_books(spark, sf_dir):
    ladder = books.asks(A.levels(spark, sf_dir, "l_orderkey"), "yes")
    out = books.walk(ladder, ["book_id"], F.lit(100))
    return out.select("book_id", F.col("filled").cast("long").alias("filled"), shown(F.col("notional")).alias("notional"), "n_levels", "fully_filled")


WALK_THIN_SQL = f"""
    WITH {A.levels_sql("l_orderkey")},
    dp AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY book_id ORDER BY cents ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lv WHERE is_ask AND side = 'yes')
    SELECT book_id, CAST(sum(least(size, 100 - before)) AS BIGINT) AS filled, round(CAST(sum(least(size, 100 - before) * cents) AS DOUBLE) / 100, 6) AS notional, count(*) AS n_levels, sum(least(size, 100 - before)) >= 100 AS fully_filled
    FROM dp WHERE before < 100 GROUP BY book_id"""


def top_of_book(spark, sf_dir):
    t = books.top_of_book(A.levels(spark, sf_dir, "l_orderkey"), ["book_id"])
    ya, yb, na, nb = (F.col(c) for c in ("yes_ask", "yes_bid", "no_ask", "no_bid"))
    return t.select("book_id", shown(ya).alias("yes_ask"), shown(yb).alias("yes_bid"), shown(na).alias("no_ask"), shown(nb).alias("no_bid"), shown(books.spread(ya, yb)).alias("yes_spread"), shown(books.implied_probability(ya, yb)).alias("yes_implied"), shown(books.imbalance(F.col("yes_bid_usd"), F.col("yes_ask_usd")), 6).alias("yes_imbalance"), shown(ya + na).alias("complete_set"))


TOP_SQL = f"""
    WITH {A.levels_sql("l_orderkey")},
    t AS (SELECT book_id, min(cents) FILTER (side = 'yes' AND is_ask) AS ya, max(cents) FILTER (side = 'yes' AND NOT is_ask) AS yb, min(cents) FILTER (side = 'no' AND is_ask) AS na, max(cents) FILTER (side = 'no' AND NOT is_ask) AS nb,
                 coalesce(sum(cents * size) FILTER (side = 'yes' AND is_ask), 0) AS au, coalesce(sum(cents * size) FILTER (side = 'yes' AND NOT is_ask), 0) AS bu FROM lv GROUP BY book_id)
    SELECT book_id, ya / 100.0::DOUBLE AS yes_ask, yb / 100.0::DOUBLE AS yes_bid, na / 100.0::DOUBLE AS no_ask, nb / 100.0::DOUBLE AS no_bid, round((ya - yb) / 100.0::DOUBLE, 6) AS yes_spread,
           round(coalesce((ya + yb) / 200.0::DOUBLE, ya / 100.0::DOUBLE, yb / 100.0::DOUBLE), 6) AS yes_implied,
           CASE WHEN au + bu > 0 THEN round(CAST(bu - au AS DOUBLE) / CAST(au + bu AS DOUBLE), 6) END AS yes_imbalance, round((ya + na) / 100.0::DOUBLE, 6) AS complete_set FROM t"""


def depth_profile(spark, sf_dir):
    d = books.depth_profile(A.levels(spark, sf_dir), ["book_id"])
    return d.select("book_id", "side", *(shown(F.col(c)).alias(c) for c in d.columns if c not in ("book_id", "side")))


DEPTH_SQL = f"""
    WITH {A.levels_sql()}, b AS (SELECT *, min(cents) OVER (PARTITION BY book_id, side) AS best FROM lv WHERE is_ask)
    SELECT book_id, side, min(best) / 100.0::DOUBLE AS best_price,
           {", ".join(f"CAST(sum(size) FILTER (cents <= best + {c}) AS DOUBLE) AS size_{n}, round(CAST(sum(size * cents) FILTER (cents <= best + {c}) AS DOUBLE) / 100, 6) AS usd_{n}" for n, c in (("at_best", 0), ("within_1c", 1), ("within_3c", 3)))}
    FROM b GROUP BY book_id, side"""


def complete_sets(spark, sf_dir):
    lv = A.levels(spark, sf_dir)
    m = books.matched_walk(books.asks(lv, "yes"), books.asks(lv, "no"), ["book_id"])
    return m.select("book_id", F.col("sets").cast("long").alias("sets"), shown(F.col("cost")).alias("cost"))


MATCHED = f"""{A.levels_sql()},
    iv AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY book_id, side ORDER BY cents ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(size) OVER (PARTITION BY book_id, side ORDER BY cents) AS hi FROM lv WHERE is_ask)"""
COMPLETE_SQL = f"""
    WITH {MATCHED}
    SELECT a.book_id, CAST(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS BIGINT) AS sets, round(CAST(sum((least(a.hi, b.hi) - greatest(a.lo, b.lo)) * (a.cents + b.cents)) AS DOUBLE) / 100, 6) AS cost
    FROM iv a JOIN iv b ON a.book_id = b.book_id AND a.side = 'yes' AND b.side = 'no' AND a.lo < b.hi AND b.lo < a.hi WHERE a.cents + b.cents < 100 GROUP BY a.book_id"""


def book_arrays(spark, sf_dir):
    b = books.rebuilt(A.levels(spark, sf_dir), ["book_id"], 5)
    flat = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws("x", F.round(x["price"] * 100, 0).cast("int").cast("string"), x["size"].cast("long").cast("string"))))
    return b.select("book_id", *(flat(c).alias(c) for c in ("yes_asks", "yes_bids", "no_asks", "no_bids")))


BOOK_ARRAYS_SQL = f"""
    WITH {A.levels_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, side, is_ask ORDER BY CASE WHEN is_ask THEN cents ELSE -cents END) AS i FROM lv)
    SELECT book_id, {", ".join(f"coalesce(string_agg(cents || 'x' || size, ',' ORDER BY i) FILTER (side = '{s}' AND {k}is_ask), '') AS {s}_{n}" for s, k, n in (("yes", "", "asks"), ("yes", "NOT ", "bids"), ("no", "", "asks"), ("no", "NOT ", "bids")))}
    FROM r WHERE i <= 5 GROUP BY book_id"""


def _quotes(spark, sf_dir, sizes):
    ladder = books.asks(A.levels(spark, sf_dir))
    nominal = F.min("price").over(Window.partitionBy("book_id", "side"))
    walked = books.walk(ladder.withColumn("nominal", nominal), ["book_id", "side"], F.array(*map(F.lit, sizes)), ["nominal"])
    return A.book_terms(walked)


PARTS = ("entry_price", "platform_fee", "fee_rounding", "slippage", "transfer_cost", "capital_cost")


def execution_cost(spark, sf_dir):
    c = cost.breakdown(_quotes(spark, sf_dir, books.STANDARD_SIZES), at(A.NOW))
    win, total = F.col("win"), F.col("total_cost")
    ev = cost.net_ev(win, total)
    return c.select("book_id", "side", F.col("requested").cast("long").alias("requested"), *(shown(F.col(p)).alias(p) for p in (*PARTS, "total_cost")), shown(ev).alias("net_ev"), shown(cost.gross_profit(win, F.col("entry_price"))).alias("gross"), shown(cost.net_roi(win, total)).alias("roi"), shown(cost.kelly(win, total)).alias("kelly"), shown(cost.profit_per_100(ev, total)).alias("per_100"))


EXECUTION_SQL = f"""
    WITH {A.walk_sql([10, 50, 100])}, {A.costs_sql()},
    t AS (SELECT *, a4 + fee + rounding + transfer + capital + slippage AS total FROM co)
    SELECT book_id, side, CAST(req AS BIGINT) AS requested, a4 / 1e4 AS entry_price, fee / 1e4 AS platform_fee, rounding / 1e4 AS fee_rounding, slippage / 1e4 AS slippage, transfer / 1e4 AS transfer_cost, capital / 1e4 AS capital_cost,
           round(total / 1e4, 6) AS total_cost, round((win - total) / 1e4, 6) AS net_ev, round((win - a4) / 1e4, 6) AS gross,
           CASE WHEN total <= 0 THEN 0.0 ELSE sign(win - total) * ((2 * abs(win - total) * 10000 + total) // (2 * total)) / 1e4 END AS roi,
           CASE WHEN total <= 0 OR total >= 10000 OR win <= total THEN 0.0 ELSE (2 * (win - total) * 2500 + (10000 - total)) // (2 * (10000 - total)) / 1e4 END AS kelly,
           CASE WHEN total <= 0 THEN 0.0 ELSE sign(win - total) * ((2 * abs(win - total) * 1000000 + total) // (2 * total)) / 1e4 END AS per_100
    FROM t"""


def cost_ladder(spark, sf_dir):
    """The flagship: what a contract costs at each size, against the price that is shown."""
    c = cost.measured(_quotes(spark, sf_dir, cost.LADDER_SIZES), at(A.NOW))
    return c.select("book_id", "side", "platform", F.col("requested").cast("long").alias("requested"), F.col("filled").cast("long").alias("filled"), *(shown(F.col(x)).alias(x) for x in ("nominal", "measured", "premium", "outlay", "breakeven")), shown(F.col("ratio"), 4).alias("ratio"), "fully_filled")


LADDER = f"""{A.walk_sql(list(cost.LADDER_SIZES))}, {A.costs_sql()},
    la AS (SELECT *, a4 + fee + rounding + transfer + capital AS measured, (SELECT 1) AS one FROM co),
    no AS (SELECT book_id, side, 100 * min(cents) AS nominal FROM lv WHERE is_ask GROUP BY ALL),
    lr AS (SELECT la.*, nominal, sign(measured - nominal) * ((2 * abs(measured - nominal) * 10000 + nominal) // (2 * nominal)) AS ratio4 FROM la JOIN no USING (book_id, side))"""
LADDER_SQL = f"""
    WITH {LADDER}
    SELECT book_id, side, CASE WHEN cent THEN 'kalshi' ELSE 'polymarket' END AS platform, CAST(req AS BIGINT) AS requested, CAST(filled AS BIGINT) AS filled, nominal / 1e4 AS nominal, round(measured / 1e4, 6) AS measured, round((measured - nominal) / 1e4, 6) AS premium,
           round(CAST(measured * filled AS DOUBLE) / 1e4, 6) AS outlay, CASE WHEN measured > 0 AND measured < 10000 THEN round(measured / 1e4, 6) END AS breakeven, ratio4 / 1e4 AS ratio, filled >= req AS fully_filled
    FROM lr"""


def cost_by_category(spark, sf_dir):
    """Median and index quartiles of the cost ratio at 100 contracts, by category of book."""
    c = cost.measured(_quotes(spark, sf_dir, (100,)), at(A.NOW)).withColumn("category", (F.col("book_id") % 8).cast("int"))
    # Ratios have four places, so a category has few of them, however many books.
    g = c.groupBy("category", F.col("ratio").cast("double").alias("r")).agg(F.count("*").alias("c"), F.sum(F.col("fully_filled").cast("int")).alias("full"))
    up, whole = Window.partitionBy("category").orderBy("r"), Window.partitionBy("category")
    g = g.withColumn("end", F.sum("c").over(up)).withColumn("n", F.sum("c").over(whole))
    at_place = lambda i: F.max(F.when((i < F.col("end")) & (i >= F.col("end") - F.col("c")), F.col("r")))
    n = F.col("n")
    out = g.groupBy("category").agg(
        F.max("n").alias("n"),
        F.round((at_place(F.floor((n - 1) / 2)) + at_place(F.ceil((n - 1) / 2))) / 2, 6).alias("median"),
        at_place(F.floor(n / 4)).alias("p25"),
        at_place(F.floor(3 * n / 4)).alias("p75"),
        F.bround(F.sum("full") / F.sum("c"), 4).alias("coverage"),
    )
    return out.where("n >= 8")


CATEGORY_SQL = f"""
    WITH {LADDER.replace(str(list(cost.LADDER_SIZES)), "[100]")},
    k AS (SELECT CAST(book_id % 8 AS INTEGER) AS category, ratio4 / 1e4 AS ratio, filled >= req AS whole,
                 row_number() OVER (PARTITION BY book_id % 8 ORDER BY ratio4, book_id, side) - 1 AS i, count(*) OVER (PARTITION BY book_id % 8) AS n FROM lr)
    SELECT category, count(*) AS n, round(quantile_cont(ratio, 0.5), 6) AS median, max(ratio) FILTER (i = n // 4) AS p25, max(ratio) FILTER (i = 3 * n // 4) AS p75, round(avg(CAST(whole AS INTEGER)), 4) AS coverage
    FROM k GROUP BY category HAVING count(*) >= 8"""


def profitable_size(spark, sf_dir):
    """Bisection for the largest size with an edge; held against brute force in the tests."""
    b = books.rebuilt(A.levels(spark, sf_dir), ["book_id"], 97)
    rows = A.book_terms(b).withColumn("asks", F.col("yes_asks"))
    out = cost.max_profitable_size(rows, at(A.NOW))
    return out.select("book_id", shown(F.col("cap_size"), 2).alias("cap_size"), shown(F.col("cap_profit"), 4).alias("cap_profit"))


def basket_simulation(spark, sf_dir):
    """Baskets of ten books each: buy 100 units of YES on all of them."""
    ladder = books.asks(A.levels(spark, sf_dir), "yes").withColumn("leg_no", F.col("book_id") % 10).withColumn("basket", F.floor(F.col("book_id") / 10))
    legs = ladder.groupBy("basket", "leg_no").agg(F.sum("size").alias("available"), F.max("book_id").cast("string").alias("label")).withColumn("ratio", (F.col("leg_no") % 3 + 1).cast("decimal(12,4)"))
    out = baskets.simulate(ladder.select("basket", "leg_no", "price", "size"), legs, ["basket"], F.lit(100))
    profit, edge = baskets.edge(F.col("executable_units"), F.col("total_cost"), F.lit(12), F.lit(0))
    return out.select("basket", shown(F.col("executable_units"), 4).alias("units"), "binding_leg", "n_legs", shown(F.col("total_cost"), 4).alias("total_cost"), "fully_executable", "fully_hedged", shown(profit, 4).alias("net_profit"), shown(edge, 4).alias("net_edge"))


BASKET_SQL = f"""
    WITH {A.levels_sql()},
    y AS (SELECT *, book_id // 10 AS basket, book_id % 10 AS leg, book_id % 10 % 3 + 1 AS ratio FROM lv WHERE is_ask AND side = 'yes'),
    c AS (SELECT basket, leg, ratio, max(book_id) AS book_id, CAST(sum(size) AS BIGINT) AS available FROM y GROUP BY ALL),
    u AS (SELECT basket, round(min(CAST(available AS DECIMAL(18,6)) / ratio), 6) AS cap, arg_min(CAST(book_id AS VARCHAR), available * 6 // ratio * 100 + leg) AS binding_leg FROM c GROUP BY basket),
    t AS (SELECT c.*, least(cap, 100.0) AS units, CAST(round(least(cap, 100.0) * ratio, 4) AS DECIMAL(18,4)) AS target, binding_leg FROM c JOIN u USING (basket)),
    d AS (SELECT basket, leg, cents, size, coalesce(sum(size) OVER (PARTITION BY basket, leg ORDER BY cents ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM y),
    f AS (SELECT basket, leg, sum(least(size, target - before)) AS filled, round(sum(least(size, target - before) * cents) / 100, 4) AS spent FROM d JOIN t USING (basket, leg) WHERE before < target GROUP BY ALL),
    r AS (SELECT basket, any_value(units) AS units, any_value(binding_leg) AS binding_leg, count(*) AS n_legs, CAST(sum(spent) AS DOUBLE) AS total_cost, bool_and(filled >= target) AS whole FROM t JOIN f USING (basket, leg) GROUP BY basket)
    SELECT basket, round(CAST(units AS DOUBLE), 4) AS units, binding_leg, n_legs, round(total_cost, 4) AS total_cost, units >= 100 AS fully_executable, whole AS fully_hedged, round(12 * CAST(units AS DOUBLE) - total_cost, 4) AS net_profit,
           round((12 * CAST(units AS DOUBLE) - total_cost) / total_cost, 4) AS net_edge FROM r"""


def quote_coherence(spark, sf_dir):
    """Each market's latest observation against the one before it: drift, spread of time, staleness."""
    w = Window.partitionBy("market_id").orderBy(F.desc("observed_at"), F.desc("event_id"))
    p = A.prices(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 2")
    out = p.groupBy("market_id").agg(F.max(F.when(F.col("r") == 1, F.col("price"))).alias("price"), F.max(F.when(F.col("r") == 2, F.col("price"))).alias("summary"), F.max(F.when(F.col("r") == 1, F.col("observed_at"))).alias("observed_at"))
    age = age_seconds(F.col("observed_at"), at("2024-01-30 00:00:00"))
    return out.select("market_id", "price", "summary", (F.round(F.abs(F.col("price") - F.col("summary")), 4) > 0.01).alias("drifted"), F.round(age, 0).cast("long").alias("age"), cost.stale(age).alias("stale"))


COHERENCE_SQL = f"""
    WITH {A.PRICES}, r AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY observed_at DESC, event_id DESC) AS r FROM pr),
    g AS (SELECT market_id, max(price) FILTER (r = 1) AS price, max(price) FILTER (r = 2) AS summary, max(observed_at) FILTER (r = 1) AS t FROM r WHERE r <= 2 GROUP BY market_id)
    SELECT market_id, price, summary, round(abs(price - summary), 4) > 0.01 AS drifted, CAST(round(greatest(epoch_us(TIMESTAMP '2024-01-30') - epoch_us(t), 0) / 1e6, 0) AS BIGINT) AS age, greatest(epoch_us(TIMESTAMP '2024-01-30') - epoch_us(t), 0) / 1e6 > 1800 AS stale FROM g"""


def ticks(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 7919 % 9999 + 1) / F.lit(10000).cast("decimal(5,0)")).cast(PRICE).alias("price"))
    tick = dec("0.01", PRICE)
    return p.select("p_partkey", *(shown(snap_to_tick(F.col("price"), tick, how)).alias(how) for how in ("up", "down", "nearest")))


TICKS_SQL = """
    WITH t AS (SELECT p_partkey, p_partkey * 7919 % 9999 + 1 AS p FROM part)
    SELECT p_partkey, (p + 99) // 100 / 100.0::DOUBLE AS up, p // 100 / 100.0::DOUBLE AS down, (p + 50) // 100 / 100.0::DOUBLE AS nearest FROM t"""

QUERIES = {
    "fee_schedule": (fee_schedule, FEES_SQL),
    "walk_book": (walk_book, WALK_SQL),
    "walk_thin_books": (walk_thin_books, WALK_THIN_SQL),
    "top_of_book": (top_of_book, TOP_SQL),
    "depth_profile": (depth_profile, DEPTH_SQL),
    "complete_sets": (complete_sets, COMPLETE_SQL),
    "book_arrays": (book_arrays, BOOK_ARRAYS_SQL),
    "execution_cost": (execution_cost, EXECUTION_SQL),
    "cost_ladder": (cost_ladder, LADDER_SQL),
    "cost_by_category": (cost_by_category, CATEGORY_SQL),
    "profitable_size": (profitable_size, None),
    "basket_simulation": (basket_simulation, BASKET_SQL),
    "quote_coherence": (quote_coherence, COHERENCE_SQL),
    "ticks": (ticks, TICKS_SQL),
}
