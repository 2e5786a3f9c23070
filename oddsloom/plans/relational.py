"""Queries of relational shape: pages, latest rows, as-of joins, groupings, upserts, streams, ranks, operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import timeops
from ..functions.numeric import shown
from ..operators import latest, operations, places, ranking
from ..sources import sinks
from ..streaming import windows
from . import adapters as A


def _ordered(spark, sf_dir):
    now = timeops.at(A.ORDER_NOW)
    return A.markets(spark, sf_dir).withColumn("horizon", timeops.horizon(F.col("resolves"), now))


HORIZON_SQL = """CASE WHEN epoch(resolves) - epoch(TIMESTAMP '1998-01-01') < 0 THEN NULL WHEN epoch(resolves) - epoch(TIMESTAMP '1998-01-01') <= 86400 THEN '24h'
    WHEN epoch(resolves) - epoch(TIMESTAMP '1998-01-01') <= 604800 THEN '7d' WHEN epoch(resolves) - epoch(TIMESTAMP '1998-01-01') <= 2592000 THEN '30d' END"""


def markets_page(spark, sf_dir):
    """A page of open markets by volume: filter, search, sort, offset and limit."""
    m = latest.with_provenance(A.markets(spark, sf_dir), "live").where("status = 'open' AND volume >= 1000")
    m = latest.search(m, ["category", "platform"], "ur")
    return m.orderBy(F.desc("volume"), "market_id").offset(20).limit(100).select("market_id", "platform", "category", "volume")


PAGE_SQL = f"WITH {A.MARKETS} SELECT market_id, platform, category, volume FROM mk WHERE provenance = 'live' AND status = 'open' AND volume >= 1000 AND (contains(category, 'ur') OR contains(platform, 'ur')) ORDER BY volume DESC, market_id LIMIT 100 OFFSET 20"


def category_counts(spark, sf_dir):
    return _ordered(spark, sf_dir).groupBy("category", "status", F.coalesce("horizon", F.lit("none")).alias("horizon")).agg(F.count("*").alias("n"), F.round(F.sum("volume"), 2).alias("volume"))


COUNTS_SQL = f"WITH {A.MARKETS} SELECT category, status, coalesce({HORIZON_SQL}, 'none') AS horizon, count(*) AS n, round(sum(volume), 2) AS volume FROM mk GROUP BY ALL"


def coverage(spark, sf_dir):
    """Counts by category, platform and horizon in one pass of grouping sets."""
    m = _ordered(spark, sf_dir).withColumn("bucket", F.when(F.col("volume") >= 200000, "large").otherwise("small")).withColumn("horizon", F.coalesce("horizon", F.lit("none")))
    cols = [F.col(c) for c in ("category", "platform", "horizon", "bucket")]
    g = m.groupingSets([[cols[0], cols[3]], [cols[1], cols[3]], [cols[2], cols[3]], [cols[3]]], *cols).agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "settled", 1)).alias("n_settled"))
    return g.select(F.coalesce("category", "platform", "horizon", F.lit("all")).alias("slice"), "bucket", "n", "n_settled")


COVERAGE_SQL = f"""
    WITH {A.MARKETS}, b AS (SELECT *, CASE WHEN volume >= 200000 THEN 'large' ELSE 'small' END AS bucket, coalesce({HORIZON_SQL}, 'none') AS horizon FROM mk)
    SELECT coalesce(category, platform, horizon, 'all') AS slice, bucket, count(*) AS n, count(*) FILTER (status = 'settled') AS n_settled FROM b GROUP BY GROUPING SETS ((category, bucket), (platform, bucket), (horizon, bucket), (bucket))"""


def latest_prices(spark, sf_dir):
    return latest.latest(A.prices(spark, sf_dir), ["market_id"], ["observed_at", "event_id"], ["price", "event_id"])


LATEST_SQL = f"WITH {A.PRICES} SELECT market_id, price, event_id FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY observed_at DESC, event_id DESC) AS r FROM pr) WHERE r = 1"


def price_as_of(spark, sf_dir):
    """For each trade, the last price of the market strictly before it."""
    p = A.prices(spark, sf_dir)
    asked = p.where("event_type = 'purchase' OR event_id % 10 = 0").select("market_id", F.col("event_id").alias("trade_id"), F.col("observed_at").alias("traded_at"))
    out = latest.as_of(asked, p, "market_id", "traded_at", "observed_at", ["price", "event_id"], "event_id", strict=True)
    return out.select("trade_id", "price", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


AS_OF_SQL = f"""
    WITH {A.PRICES}, t AS (SELECT market_id, event_id AS trade_id, observed_at AS traded_at FROM pr WHERE event_type = 'purchase' OR event_id % 10 = 0),
    j AS (SELECT trade_id, price, event_id, row_number() OVER (PARTITION BY trade_id ORDER BY observed_at DESC NULLS LAST, event_id DESC) AS r FROM t LEFT JOIN pr ON t.market_id = pr.market_id AND observed_at < traded_at)
    SELECT trade_id, price, coalesce(event_id, -1) AS event_id FROM j WHERE r = 1"""


def sibling_sums(spark, sf_dir):
    m = A.markets(spark, sf_dir).withColumn("cents", F.round(F.col("volume") * 100).cast("long"))
    return latest.siblings(m.select("market_id", "event_id", "cents"), "event_id", "cents").select("market_id", "sibling_sum", "n_siblings")


SIBLINGS_SQL = f"WITH {A.MARKETS}, c AS (SELECT *, CAST(round(volume * 100) AS BIGINT) AS cents FROM mk) SELECT market_id, CAST(sum(cents) OVER w - cents AS BIGINT) AS sibling_sum, count(*) OVER w - 1 AS n_siblings FROM c WINDOW w AS (PARTITION BY event_id)"


def sector_sample(spark, sf_dir):
    """At most 120 priced markets of each category, by volume; only priced ones count towards the cap."""
    m = A.markets(spark, sf_dir).where("status <> 'paused'")
    return latest.top_per_group(m, ["category"], [F.desc("volume"), F.col("market_id")], 120).select("category", "market_id")


SAMPLE_SQL = f"WITH {A.MARKETS} SELECT category, market_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY volume DESC, market_id) AS r FROM mk WHERE status <> 'paused') WHERE r <= 120"


def unsettled(spark, sf_dir):
    """Markets past their end without a settlement, and those whose event has one."""
    m = A.markets(spark, sf_dir)
    settled = m.where("status = 'settled'")
    over = m.where(F.col("resolves") < timeops.at(A.ORDER_NOW))
    pending = over.join(settled.select("market_id"), "market_id", "left_anti")
    return pending.join(settled.select("event_id").distinct(), "event_id", "left_semi").select("market_id", "event_id")


UNSETTLED_SQL = f"WITH {A.MARKETS} SELECT market_id, event_id FROM mk WHERE resolves < TIMESTAMP '1998-01-01' AND status <> 'settled' AND event_id IN (SELECT event_id FROM mk WHERE status = 'settled')"


def settlement_join(spark, sf_dir):
    """Settled markets with their customer, nation and region: a star join."""
    m = A.markets(spark, sf_dir).where("status = 'settled'")
    c, n, r = (A.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = m.join(c, m.event_id == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "platform").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.round(F.avg("volume"), 2).alias("volume"))


STAR_SQL = f"""WITH {A.MARKETS} SELECT r_name, platform, count(*) AS n, count(DISTINCT event_id) AS events, round(avg(volume), 2) AS volume
    FROM mk JOIN customer ON event_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE status = 'settled' GROUP BY ALL"""


def match_endpoints(spark, sf_dir):
    """Matches of a market at either end."""
    pairs = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).where("a <> b").distinct()
    return latest.either_endpoint(pairs, "a", "b").groupBy("node").agg(F.count("*").alias("n"), F.min("other").alias("first"))


ENDPOINTS_SQL = """WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey <> l_suppkey), e AS (SELECT a AS node, b AS other FROM p UNION ALL SELECT b, a FROM p)
    SELECT node, count(*) AS n, min(other) AS first FROM e GROUP BY node"""


def order_statistics(spark, sf_dir):
    """Median, and quartiles by place without interpolation."""
    q = places.values_at(A.markets(spark, sf_dir), ["category"], "volume", places.MIDDLE | places.QUARTILES)
    return q.select("category", F.round((F.col("low") + F.col("high")) / 2, 4).alias("median"), "p25", "p75")


STATISTICS_SQL = f"""WITH {A.MARKETS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY volume, market_id) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM mk)
    SELECT category, round(quantile_cont(volume, 0.5), 4) AS median, max(volume) FILTER (i = n // 4) AS p25, max(volume) FILTER (i = 3 * n // 4) AS p75 FROM r GROUP BY category"""


def upsert(spark, sf_dir):
    """Merge a batch of prices into a table by market: newer rows win, others stay."""
    p = A.prices(spark, sf_dir).select("market_id", "price", "event_id", "observed_at")
    return sinks.upserted(p.where("event_id % 2 = 0"), p.where("event_id % 2 = 1"), ["market_id"], ["observed_at", "event_id"]).select("market_id", "price", "event_id")


def insert_or_skip(spark, sf_dir):
    """Trades that a table does not have yet, one for each key."""
    p = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trade"), F.col("l_linenumber").alias("line"), "l_quantity", "l_extendedprice")
    new = sinks.insertable(p.where("trade % 4 < 2"), p.where("trade % 4 >= 1"), ["trade", "line"], ["l_extendedprice", "l_quantity"])
    return new.select("trade", "line", "l_quantity", "l_extendedprice")


SKIP_SQL = """WITH p AS (SELECT l_orderkey AS trade, l_linenumber AS line, l_quantity, l_extendedprice FROM lineitem)
    SELECT trade, line, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY trade, line ORDER BY l_extendedprice, l_quantity) AS r FROM p WHERE trade % 4 >= 1 AND (trade, line) NOT IN (SELECT (trade, line) FROM p WHERE trade % 4 < 2)) WHERE r = 1"""


def retention(spark, sf_dir):
    """Books of the last ten days with their levels; older ones are pruned."""
    e = A.table(spark, sf_dir, "events")
    books = e.select(F.col("event_id").alias("book_id"), F.col("ts").cast("timestamp").alias("observed_at"))
    kept = sinks.retained(books, "observed_at", timeops.at("2024-01-30 00:00:00"), 10)
    levels = e.select(F.col("event_id").alias("book_id"), "value")
    return levels.join(kept.select("book_id"), "book_id", "left_semi").agg(F.count("*").alias("n"), F.min("book_id").alias("first"))


RETENTION_SQL = "SELECT count(*) AS n, min(event_id) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-20'"


def tumbling_windows(spark, sf_dir):
    return windows.tumbling(A.prices(spark, sf_dir), "6 hours").select(F.unix_seconds("window.start").alias("start"), "market_id", "n", shown(F.col("low")).alias("low"), shown(F.col("high")).alias("high"), shown(F.col("mean")).alias("mean"))


TUMBLING_SQL = f"WITH {A.PRICES} SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, observed_at, TIMESTAMP '1970-01-01')) AS BIGINT) AS start, market_id, count(*) AS n, min(price) AS low, max(price) AS high, round(avg(price), 6) AS mean FROM pr GROUP BY 1, 2"


def sliding_windows(spark, sf_dir):
    return windows.sliding(A.prices(spark, sf_dir), "12 hours", "6 hours").select(F.unix_seconds("window.start").alias("start"), "event_type", "n")


SLIDING_SQL = f"""WITH {A.PRICES}, b AS (SELECT event_type, epoch(time_bucket(INTERVAL 6 HOUR, observed_at, TIMESTAMP '1970-01-01')) AS s FROM pr)
    SELECT CAST(s - d AS BIGINT) AS start, event_type, count(*) AS n FROM b, (SELECT unnest([0, 21600]) AS d) GROUP BY ALL"""


def session_windows(spark, sf_dir):
    return windows.sessions(A.prices(spark, sf_dir), "8 hours").select("market_id", F.unix_seconds("session.start").alias("start"), "n")


SESSION_SQL = f"""WITH {A.PRICES}, g AS (SELECT *, CASE WHEN observed_at - lag(observed_at) OVER (PARTITION BY market_id ORDER BY observed_at) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM pr),
    s AS (SELECT *, sum(new) OVER (PARTITION BY market_id ORDER BY observed_at ROWS UNBOUNDED PRECEDING) AS id FROM g)
    SELECT market_id, CAST(floor(epoch(min(observed_at))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY market_id, id"""


def _candidates(spark, sf_dir):
    """Candidates from orders, a row for each side, with what the gates ask for."""
    k = F.col("o_orderkey")
    rows = A.table(spark, sf_dir, "orders").select(k.alias("market_id"), F.explode(F.array(F.lit("no"), F.lit("yes"))).alias("side"), k.alias("o_orderkey"))
    s = k * 2 + F.when(F.col("side") == "yes", 1).otherwise(0)
    rows = rows.withColumns(
        {
            "horizon": F.when(k % 3 == 0, "24h").when(k % 3 == 1, "7d").otherwise("30d"),
            "platform": F.when(k % 2 == 0, "kalshi").otherwise("polymarket"),
            "independent": s % 5 != 0,
            "confidence": (s % 100) / 100,
            "evidence": s % 3,
            "age": s * 7 % 600,
            "spread": F.when(s % 17 != 0, (s * 3 % 20) / 100),
            "depth": s * 11 % 900,
            "volume": k * 13 % 2000,
            "top": (s * 19 % 99 + 1) / 100,
            "hours": (s % 700).cast("double"),
            "occurred": s % 23 == 0,
            "early": s % 29 == 0,
            "open": s % 31 != 0,
            "provenance": F.when(k % 7 == 0, "demo").otherwise("live"),
            "conservative_ev": (s * 37 % 200 - 60) / 1000,
            "size": s * 5 % 100,
            "cap": s * 3 % 150,
            "data_age": s * 41 % 20000,
        }
    )
    rows = rows.withColumn("flags", ranking.risk_flags()).withColumn("score", ranking.composite_score()).withColumn("reason", ranking.gate())
    return rows.drop("o_orderkey")


CANDIDATE_SQL = """cd AS (SELECT *, s % 5 <> 0 AS ind, s % 100 / 100.0::DOUBLE AS conf, s * 7 % 600 AS age, CASE WHEN s % 17 <> 0 THEN s * 3 % 20 END AS sp, s * 11 % 900 AS depth, s * 19 % 99 + 1 AS top, s % 700 AS hours, (s * 37 % 200 - 60) / 1000.0::DOUBLE AS ev, s * 5 % 100 AS size, s * 3 % 150 AS cap, s * 41 % 20000 AS da
        FROM (SELECT o_orderkey AS k, side, o_orderkey * 2 + CASE WHEN side = 'yes' THEN 1 ELSE 0 END AS s, CASE o_orderkey % 3 WHEN 0 THEN '24h' WHEN 1 THEN '7d' ELSE '30d' END AS horizon FROM orders, (SELECT unnest(['no', 'yes']) AS side))),
    cs AS (SELECT *, list_filter([CASE WHEN NOT ind THEN 'no_independent_prior' END, CASE WHEN conf < 0.3 THEN 'low_model_confidence' END, CASE WHEN s % 3 <= 0 THEN 'no_research_evidence' END, CASE WHEN age > 300 THEN 'stale_quote' END, CASE WHEN sp > 5 THEN 'wide_spread' END, CASE WHEN depth < 25 THEN 'thin_liquidity' END,
                  CASE WHEN k * 13 % 2000 < 500 THEN 'low_volume' END, CASE WHEN top < 3 OR top > 97 THEN 'extreme_price' END, CASE WHEN hours < 1 THEN 'imminent_settlement' END, CASE WHEN s % 23 = 0 THEN 'event_already_occurred' END, CASE WHEN s % 29 = 0 THEN 'settles_before_close' END, CASE WHEN k % 2 = 1 THEN 'uma_oracle_settlement' END,
                  CASE WHEN s % 31 = 0 THEN 'not_accepting_orders' END, CASE WHEN k % 7 = 0 THEN 'provenance_demo' END], lambda x: x IS NOT NULL) AS flags,
           CASE WHEN ev <= 0 THEN 0.0 ELSE round(ln(1 + ev * least(size, CASE WHEN cap = 0 THEN size ELSE cap END)) * (0.4::DOUBLE + 0.6::DOUBLE * (depth / (depth + 500.0::DOUBLE))) * (0.4::DOUBLE + 0.6::DOUBLE * CASE WHEN sp IS NULL THEN 0.5 ELSE 1 - least(1.0, sp / 100.0::DOUBLE / 0.1::DOUBLE) END) * (0.3::DOUBLE + 0.7::DOUBLE * conf)
                * (CASE WHEN da > 0 THEN 1 / (1 + da / 3600.0::DOUBLE / 12) ELSE 1.0 END) * (0.5::DOUBLE + 0.5::DOUBLE / (1 + CASE WHEN hours = 0 THEN 720 ELSE hours END / 168.0::DOUBLE))
                * CASE WHEN NOT ind THEN 0.05 ELSE 1 END * CASE WHEN age > 300 THEN 0.3 ELSE 1 END * CASE WHEN depth < 25 THEN 0.4 ELSE 1 END * CASE WHEN top < 3 OR top > 97 THEN 0.5 ELSE 1 END, 4) END AS score,
           CASE WHEN NOT ind THEN 'no_independent_prior' WHEN ev <= 0.005 THEN 'conservative_ev' WHEN depth < 25 THEN 'depth' WHEN sp > 15 THEN 'spread' WHEN conf < 0.15 THEN 'confidence' WHEN size <= 0 THEN 'size' WHEN s % 23 = 0 THEN 'event_already_occurred' END AS reason FROM cd)"""


def candidate_scores(spark, sf_dir):
    return _candidates(spark, sf_dir).select("market_id", "side", F.array_join("flags", ",").alias("flags"), "score", F.coalesce("reason", F.lit("")).alias("reason"))


SCORES_SQL = f"WITH {CANDIDATE_SQL} SELECT k AS market_id, side, array_to_string(flags, ',') AS flags, score, coalesce(reason, '') AS reason FROM cs"


def recommendations(spark, sf_dir):
    return ranking.ranked(_candidates(spark, sf_dir)).select("horizon", "rank", "market_id", "side", "score")


RANK_SQL = f"""WITH {CANDIDATE_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY horizon, k ORDER BY score DESC, side) AS r FROM cs WHERE reason IS NULL), t AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY score DESC, k) AS rank FROM b WHERE r = 1)
    SELECT horizon, CAST(rank AS INTEGER) AS rank, k AS market_id, side, score FROM t WHERE rank <= 10"""


def funnel(spark, sf_dir):
    return ranking.funnel(_candidates(spark, sf_dir))


FUNNEL_NAMES = ["no_independent_prior", "conservative_ev", "depth", "spread", "confidence", "size", "event_already_occurred"]
FUNNEL_SQL = f"""WITH {CANDIDATE_SQL}, g AS (SELECT list_position({FUNNEL_NAMES}, reason) AS p FROM cs), s AS (SELECT unnest(range(0, {len(FUNNEL_NAMES) + 1})) AS stage)
    SELECT CAST(stage AS INTEGER) AS stage, CASE WHEN stage = 0 THEN 'all' ELSE 'after_' || {FUNNEL_NAMES}[stage] END AS name, count(*) FILTER (p IS NULL OR p > stage) AS n FROM s, g GROUP BY stage"""


def disagreements(spark, sf_dir):
    s = A.snapshots(spark, sf_dir).select("snapshot_id", F.col("p_side").cast("double").alias("model_p"), F.col("market_p").cast("double").alias("market_p"), ((F.col("snapshot_id") % 20) / 100).alias("spread"))
    d = ranking.disagreements(s)
    return d.orderBy(F.desc(F.round(F.abs("gap"), 6)), "snapshot_id").limit(50).select("snapshot_id", shown(F.col("gap")).alias("gap"))


DISAGREE_SQL = f"WITH {A.SNAPSHOTS} SELECT snapshot_id, round((p_side - market_p) / 100.0::DOUBLE, 6) AS gap FROM sn WHERE abs(p_side - market_p) >= 3 AND snapshot_id % 20 <= 10 ORDER BY abs(p_side - market_p) DESC, snapshot_id LIMIT 50"


def book_budget(spark, sf_dir):
    """Markets whose books are fetched, within a budget for each venue; the tests hold the choice against a plain loop."""
    k = F.col("market_id")
    days = F.datediff(F.col("resolves"), timeops.at(A.ORDER_NOW))
    m = A.markets(spark, sf_dir).select(
        "platform", "market_id", F.when(k % 31 != 0, F.col("event_id")).alias("event_id"), F.when(k % 17 != 0, F.col("event_id") % 40).alias("series"), (F.col("status") == "open").alias("open"), (k % 13 != 0).alias("accepting"),
        F.col("category").isin("1-urgent", "2-high").alias("modellable"), F.when(days.between(0, 1), 1).when(days.between(2, 7), 2).when(days.between(8, 30), 3).alias("horizon"), "volume",
    )
    return ranking.book_budget(m, 250)


def freshness(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    kinds = F.array(*map(F.lit, [*operations.FRESHNESS, "other"]))
    age = F.when(F.col("event_id") % 19 != 0, timeops.age_seconds(F.col("ts").cast("timestamp"), timeops.at("2024-01-30 00:00:00")))
    kind = F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(kind.alias("kind"), operations.freshness(age, kind).alias("state")).groupBy("kind", "state").agg(F.count("*").alias("n"))


FRESH_SQL = f"""WITH e AS (SELECT {[*operations.FRESHNESS, "other"]}[event_id % 5 + 1] AS kind, CASE WHEN event_id % 19 <> 0 THEN greatest(epoch_us(TIMESTAMP '2024-01-30') - epoch_us(CAST(ts AS TIMESTAMP)), 0) / 1e6 END AS age FROM events),
    l(kind, soft, hard) AS (VALUES {", ".join(f"('{k}', {a}, {b})" for k, (a, b) in operations.FRESHNESS.items())})
    SELECT kind, CASE WHEN age IS NULL OR soft IS NULL THEN 'unavailable' WHEN age <= soft THEN 'fresh' WHEN age <= hard THEN 'aging' ELSE 'stale' END AS state, count(*) AS n FROM e LEFT JOIN l USING (kind) GROUP BY ALL"""


def job_states(spark, sf_dir):
    """Events as job runs: the last success of each job and whether it is overdue."""
    r = A.table(spark, sf_dir, "events").select(F.concat(F.lit("job"), (F.col("user_id") % 12).cast("string")).alias("job"), F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("finished_at"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("succeeded").alias("status"))
    s = operations.stalls(r, {f"job{i}": 60 * (i + 1) for i in range(11)}, timeops.at("2024-01-30 00:00:00"))
    return s.join(operations.gaps(r), "job").select("job", "state", F.unix_seconds("last").alias("last"), "gap", "n")


JOBS_SQL = """WITH r AS (SELECT 'job' || user_id % 12 AS job, user_id % 12 AS j, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, ts, event_id % 3 <> 0 AS ok FROM events),
    g AS (SELECT job, any_value(j) AS j, max(t) FILTER (ok) AS last, count(*) AS n FROM r GROUP BY job), q AS (SELECT job, t - lag(t) OVER w AS gap, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS i FROM r WINDOW w AS (PARTITION BY job ORDER BY ts, event_id))
    SELECT g.job, CASE WHEN last IS NULL OR j = 11 THEN 'unknown' WHEN epoch(TIMESTAMP '2024-01-30') - last > 120 * (j + 1) THEN 'stalled' ELSE 'active' END AS state, last, gap, n FROM g JOIN q ON q.job = g.job AND i = 1"""


def _runs(spark, sf_dir):
    k = F.col("event_id")
    names = F.array(*map(F.lit, operations.JOBS))
    return A.table(spark, sf_dir, "events").select(F.floor(k / len(operations.JOBS)).alias("batch"), F.element_at(names, (k % len(operations.JOBS) + 1).cast("int")).alias("job"), F.when(k % 11 == 0, "failed").when(k % 97 == 1, "running").otherwise("succeeded").alias("status"))


def blocked_jobs(spark, sf_dir):
    """Jobs that must not run as one they wait for has failed, over all batches."""
    b = operations.blocked_runs(_runs(spark, sf_dir))
    return b.groupBy("job", F.array_join("failed", ",").alias("failed")).agg(F.count("*").alias("n"))


RUNS = f"""rn AS (SELECT event_id // {len(operations.JOBS)} AS batch, {list(operations.JOBS)}[event_id % {len(operations.JOBS)} + 1] AS job, CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 97 = 1 THEN 'running' ELSE 'succeeded' END AS status FROM events)"""
BLOCKED_SQL = f"""WITH {RUNS}, up(job, above) AS (VALUES {", ".join(f"('{j}', '{u}')" for j, us in operations.upstream().items() for u in us)}),
    b AS (SELECT r.batch, r.job, string_agg(f.job, ',' ORDER BY f.job) AS failed FROM rn r JOIN up ON up.job = r.job JOIN rn f ON f.batch = r.batch AND f.job = above AND f.status = 'failed' GROUP BY r.batch, r.job)
    SELECT job, failed, count(*) AS n FROM b GROUP BY ALL"""


def active_runs(spark, sf_dir):
    """Jobs of which more than one run is active."""
    return operations.doubly_active(_runs(spark, sf_dir))


ACTIVE_SQL = f"WITH {RUNS} SELECT job, count(*) AS n FROM rn WHERE status = 'running' GROUP BY job HAVING count(*) > 1"


def provider_runs(spark, sf_dir):
    """Batches by how many of their jobs went well."""
    g = _runs(spark, sf_dir).groupBy("batch").agg(F.count(F.when(F.col("status") != "failed", 1)).alias("ok"), F.count(F.when(F.col("status") == "failed", 1)).alias("bad"))
    return g.groupBy(operations.partial_success(F.col("ok"), F.col("bad")).alias("status")).agg(F.count("*").alias("n"))


PROVIDER_SQL = f"WITH {RUNS}, g AS (SELECT batch, count(*) FILTER (status <> 'failed') AS ok, count(*) FILTER (status = 'failed') AS bad FROM rn GROUP BY batch) SELECT CASE WHEN bad = 0 THEN 'succeeded' WHEN ok > 0 THEN 'partial' ELSE 'failed' END AS status, count(*) AS n FROM g GROUP BY 1"


def validators(spark, sf_dir):
    """Orders that break a rule of publication, by rule."""
    o = A.markets(spark, sf_dir)
    rules = {"volume_over_1000": F.col("volume") > 1000, "ends_after_1995": F.col("resolves") >= timeops.at("1995-06-01 00:00:00"), "known_status": F.col("status").isin("open", "settled")}
    return operations.violations(o, rules).groupBy("rule").agg(F.count("*").alias("n"))


VALIDATORS_SQL = f"""WITH {A.MARKETS}, v AS (SELECT unnest(list_filter([CASE WHEN NOT volume > 1000 THEN 'volume_over_1000' END, CASE WHEN NOT resolves >= TIMESTAMP '1995-06-01' THEN 'ends_after_1995' END, CASE WHEN status NOT IN ('open', 'settled') THEN 'known_status' END], lambda x: x IS NOT NULL)) AS rule FROM mk)
    SELECT rule, count(*) AS n FROM v GROUP BY rule"""

QUERIES = {
    "markets_page": (markets_page, PAGE_SQL),
    "category_counts": (category_counts, COUNTS_SQL),
    "coverage": (coverage, COVERAGE_SQL),
    "latest_prices": (latest_prices, LATEST_SQL),
    "price_as_of": (price_as_of, AS_OF_SQL),
    "sibling_sums": (sibling_sums, SIBLINGS_SQL),
    "sector_sample": (sector_sample, SAMPLE_SQL),
    "unsettled": (unsettled, UNSETTLED_SQL),
    "settlement_join": (settlement_join, STAR_SQL),
    "match_endpoints": (match_endpoints, ENDPOINTS_SQL),
    "order_statistics": (order_statistics, STATISTICS_SQL),
    "upsert": (upsert, LATEST_SQL),
    "insert_or_skip": (insert_or_skip, SKIP_SQL),
    "retention": (retention, RETENTION_SQL),
    "tumbling_windows": (tumbling_windows, TUMBLING_SQL),
    "sliding_windows": (sliding_windows, SLIDING_SQL),
    "session_windows": (session_windows, SESSION_SQL),
    "candidate_scores": (candidate_scores, SCORES_SQL),
    "recommendations": (recommendations, RANK_SQL),
    "funnel": (funnel, FUNNEL_SQL),
    "disagreements": (disagreements, DISAGREE_SQL),
    "book_budget": (book_budget, None),
    "freshness": (freshness, FRESH_SQL),
    "job_states": (job_states, JOBS_SQL),
    "validators": (validators, VALIDATORS_SQL),
    "blocked_jobs": (blocked_jobs, BLOCKED_SQL),
    "active_runs": (active_runs, ACTIVE_SQL),
    "provider_runs": (provider_runs, PROVIDER_SQL),
}
