"""Views of the test tables as market data, once for Spark and once as SQL text.

All rules are integer or decimal arithmetic on keys, so both dialects see the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import PRICE, SIZE, dec

#: The present, for every query.
NOW = "2024-01-15 00:00:00"
#: The present for markets made from orders, which end between 1995 and 2001.
ORDER_NOW = "1998-01-01 00:00:00"
FEE_RATE = "0.07"
#: Rows of thin books that a task works on.
THIN_ROWS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def levels(spark: SparkSession, sf_dir: str, by: str = "l_suppkey") -> DataFrame:
    """Order-book levels (book_id, side, is_ask, price, size) from lineitem; equal prices are one level.

    An order has a few lines, so books by order are hardly any smaller for being combined before the shuffle: that would
    only hold most rows of a task in memory.  They are dealt by book into parts of bounded size, which aggregates and
    windows by book share.
    """
    rows = table(spark, sf_dir, "lineitem").select(
        F.col(by).alias("book_id"),
        F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("side"),
        (F.col("l_returnflag") != "R").alias("is_ask"),
        ((F.col("l_partkey") % 97 + 1) / F.lit(100).cast("decimal(3,0)")).cast(PRICE).alias("price"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )
    if by == "l_orderkey":
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // THIN_ROWS + 1)
        rows = rows.repartition(parts, "book_id")
    return rows.groupBy("book_id", "side", "is_ask", "price").agg(F.sum("quantity").cast(SIZE).alias("size"))


def book_terms(rows: DataFrame, key: str = "book_id") -> DataFrame:
    """Adds the terms of a market to rows that have its key: platform, fees, tick, resolution."""
    now, k = F.lit(NOW).cast("timestamp"), F.col(key)
    return rows.withColumns(
        {
            "platform": F.when(k % 2 == 0, "kalshi").otherwise("polymarket"),
            "fee_type": F.when(k % 10 == 8, "flat").otherwise("quadratic"),
            "fee_rate": dec(FEE_RATE, "decimal(8,6)"),
            "tick_size": F.when(k % 2 == 0, dec("0.01", PRICE)).otherwise(dec("0.001", PRICE)),
            "min_size": F.when(k % 2 == 0, F.lit(1)).otherwise(F.lit(5)),
            "resolves": F.timestamp_add("DAY", (k % 60).cast("int"), now),
            "win": ((k * 37 % 89 + 5) / F.lit(100).cast("decimal(3,0)")).cast("decimal(10,6)"),
        }
    )


LEVELS = """lv AS (
    SELECT {by} AS book_id, CASE WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END AS side, l_returnflag <> 'R' AS is_ask,
           l_partkey % 97 + 1 AS cents, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size
    FROM lineitem GROUP BY ALL)"""


def levels_sql(by: str = "l_suppkey") -> str:
    return LEVELS.format(by=by)


def walk_sql(sizes: list[int], extra: str = "") -> str:
    """CTEs lv, dp and wk: ladders with depth, and their walk; a4 is the average price in 1/10000."""
    return f"""{levels_sql()},
    dp AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY book_id, side ORDER BY cents ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lv WHERE is_ask{extra}),
    wk AS (SELECT *, (200 * spent + filled) // (2 * filled) AS a4 FROM (
        SELECT book_id, side, req, CAST(sum(least(size, req - before)) AS HUGEINT) AS filled, CAST(sum(least(size, req - before) * cents) AS HUGEINT) AS spent, max(cents) AS worst, count(*) AS n_levels
        FROM dp, (SELECT unnest({sizes}) AS req) WHERE before < req GROUP BY ALL))"""


def costs_sql() -> str:
    """CTE co: wk with the parts of a contract's cost in 1/10000 of a dollar, as integers."""
    return """ch AS (SELECT *, book_id % 2 = 0 AS cent, book_id % 10 = 8 AS flat, 70000::HUGEINT * filled * a4 * (10000 - a4) AS n FROM wk),
    cg AS (SELECT *,
        CASE WHEN flat THEN (7 * filled + 0) * 1000000000000::HUGEINT
             WHEN cent THEN (n + 999999999999) // 1000000000000 * 1000000000000
             ELSE (2 * n + 1000000000) // 2000000000 * 1000000000 END AS charged
    FROM ch),
    co AS (SELECT *,
        CASE WHEN flat THEN (2 * charged + filled * 10000000000) // (2 * filled * 10000000000)
             ELSE (2 * 70000::HUGEINT * a4 * (10000 - a4) + 10000000000) // 20000000000 END AS fee,
        CASE WHEN flat THEN 0
             ELSE sign(charged - n) * ((2 * abs(charged - n) + filled * 10000000000) // (2 * filled * 10000000000)) END AS rounding,
        CASE WHEN cent THEN 0 ELSE (2 * 5000 + filled) // (2 * filled) END AS transfer,
        CAST(round(CAST(a4 AS DECIMAL(38,0)) * 0.05::DECIMAL(38,2) * CAST(round((book_id % 60) / 365.25, 10) AS DECIMAL(38,10)), 0) AS HUGEINT) AS capital,
        CASE WHEN cent THEN 100 ELSE 10 END AS slippage,
        (book_id * 37 % 89 + 5) * 100 AS win
    FROM cg)"""


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets from orders: market_id, event_id, platform, category, status, volume, resolves, title."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("market_id"),
        F.col("o_custkey").alias("event_id"),
        F.when(k % 2 == 0, "kalshi").otherwise("polymarket").alias("platform"),
        F.lower("o_orderpriority").alias("category"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "settled").otherwise("paused").alias("status"),
        F.col("o_totalprice").alias("volume"),
        F.col("o_orderdate").cast("timestamp").alias("resolves"),
        F.when(k % 7 == 0, "demo").otherwise("live").alias("provenance"),
    )


MARKETS = """mk AS (
    SELECT o_orderkey AS market_id, o_custkey AS event_id, CASE WHEN o_orderkey % 2 = 0 THEN 'kalshi' ELSE 'polymarket' END AS platform,
           lower(o_orderpriority) AS category, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'settled' ELSE 'paused' END AS status,
           o_totalprice AS volume, CAST(o_orderdate AS TIMESTAMP) AS resolves, CASE WHEN o_orderkey % 7 = 0 THEN 'demo' ELSE 'live' END AS provenance
    FROM orders)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price observations from events: market_id, observed_at, price (cents over 500), event_id."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("market_id"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        (F.floor(F.col("value") / 5) / 100).alias("price"),
        F.col("event_id"),
        F.col("event_type"),
    )


PRICES = """pr AS (
    SELECT user_id AS market_id, CAST(ts AS TIMESTAMP) AS observed_at, floor(value / 5) / 100 AS price, event_id, event_type FROM events)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen recommendations from orders, with settlements: one for each order that is not paused.

    Money and probabilities are in 1/100, so that sums are exact.
    """
    k = F.col("o_orderkey")
    cost, fair = (k * 31 % 80 + 10), (k * 17 % 90 + 5)
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P").select(
        k.alias("snapshot_id"),
        F.col("o_orderdate").cast("date").alias("day"),
        (k * 13 % 10 + 1).cast("int").alias("rank"),
        F.when(k % 3 == 0, "24h").when(k % 3 == 1, "7d").otherwise("30d").alias("horizon"),
        F.when(k % 2 == 0, "kalshi").otherwise("polymarket").alias("platform"),
        F.when(k % 4 < 2, "yes").otherwise("no").alias("side"),
        (cost / F.lit(100).cast("decimal(3,0)")).cast(PRICE).alias("cost"),
        (fair / F.lit(100).cast("decimal(3,0)")).cast(PRICE).alias("p_side"),
        (F.greatest(fair - 10, F.lit(1)) / F.lit(100).cast("decimal(3,0)")).cast(PRICE).alias("p_low"),
        ((k * 7 % 90 + 5) / F.lit(100).cast("decimal(3,0)")).cast(PRICE).alias("market_p"),
        ((k % 11) / F.lit(10).cast("decimal(2,0)")).cast(PRICE).alias("confidence"),
        (k * 3 % 200).cast(SIZE).alias("executable_size"),
        F.when(k % 23 == 0, "void").when(k % 29 == 0, "fifty_fifty").when(k * 11 % 5 < 2, "yes").when(k % 31 == 0, F.lit(None)).otherwise("no").alias("result"),
        F.when(k % 7 == 0, "demo").otherwise("live").alias("provenance"),
        F.when(k % 5 == 0, "quote").when(k % 41 == 0, "candle").otherwise("orderbook").alias("quality"),
    )


SNAPSHOTS = """sn AS (
    SELECT o_orderkey AS snapshot_id, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey * 13 % 10 + 1 AS INTEGER) AS rank,
           CASE o_orderkey % 3 WHEN 0 THEN '24h' WHEN 1 THEN '7d' ELSE '30d' END AS horizon,
           CASE WHEN o_orderkey % 2 = 0 THEN 'kalshi' ELSE 'polymarket' END AS platform,
           CASE WHEN o_orderkey % 4 < 2 THEN 'yes' ELSE 'no' END AS side,
           o_orderkey * 31 % 80 + 10 AS cost, o_orderkey * 17 % 90 + 5 AS p_side, greatest(o_orderkey * 17 % 90 - 5, 1) AS p_low,
           o_orderkey * 7 % 90 + 5 AS market_p, o_orderkey % 11 AS confidence, o_orderkey * 3 % 200 AS executable_size,
           CASE WHEN o_orderkey % 23 = 0 THEN 'void' WHEN o_orderkey % 29 = 0 THEN 'fifty_fifty' WHEN o_orderkey * 11 % 5 < 2 THEN 'yes' WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'no' END AS result,
           CASE WHEN o_orderkey % 7 = 0 THEN 'demo' ELSE 'live' END AS provenance,
           CASE WHEN o_orderkey % 5 = 0 THEN 'quote' WHEN o_orderkey % 41 = 0 THEN 'candle' ELSE 'orderbook' END AS quality
    FROM orders WHERE o_orderstatus <> 'P')"""
