"""Texts, matching, calibration, budgets, payloads and streams."""

import json
import math
import random
from decimal import Decimal as D

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsloom.functions import text as T
from oddsloom.functions.special import gbm_above, normal_cdf, with_gbm_touch
from oddsloom.operators import calibration, latest, matching, operations, ranking
from oddsloom.plans import adapters
from oddsloom.sources import paged, sinks, venues
from oddsloom.streaming import windows


def values(spark, column, *texts):
    return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column(F.col("t")).alias("x")).collect()]


def test_titles(spark):
    # Aliases apply in order, so "nyc" is lengthened twice, as the original matching keys are.
    assert values(spark, T.normalize_title, "Will the *high* temp in NYC be >87° on Jul 25?", "BTC & ETH", "Café?", None) == ["high temp in new york city city be 87° on jul 25", "bitcoin and ethereum", "cafe", ""]


def test_numbers(spark):
    # Cents after grouped thousands are no part of a number.
    got = values(spark, T.numbers, "above $70k by 3", "5k run", "2 million people", "$1,234.50", "none")
    assert got == [[70000.0, 3.0], [], [2e6], [1234.0], []]


def test_comparators_and_semantics(spark):
    assert values(spark, T.comparator, "at or above 5", "less than or equal to 3", "over 9", "plain") == ["gte", "lte", "gt", ""]
    assert values(spark, T.threshold_semantics, "highest temp today", "at the close", "average of x", "") == ["daily_high", "close_at_cutoff", "average", ""]
    assert values(spark, T.includes_overtime, "including overtime", "not including overtime", "regulation") == [True, False, None]


def test_candidates_find_planted_match(spark):
    def side(rows):
        df = spark.createDataFrame(rows, "market_id long, title string")
        return df.select("market_id", T.tokens(T.normalize_title(F.col("title"))).alias("tokens"), T.entities(T.normalize_title(F.col("title"))).alias("entities"), F.lit("x").alias("category"), F.lit(None).cast("timestamp").alias("resolves"))

    pairs = matching.candidates(side([(1, "Will Bitcoin reach 100000 in December?"), (3, "Rain in Paris")]), side([(2, "Bitcoin to reach 100000 during December"), (4, "Snow over Oslo")]))
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
    got = matching.recall(pairs, spark.createDataFrame([(1, 2, "equivalent"), (3, 4, "false_friend")], "a long, b long, label string"))
    assert {r.label: (r.n, r.proposed) for r in got.collect()} == {"equivalent": (1, 1), "false_friend": (1, 0)}


def test_isotonic_is_the_max_min_formula():
    rng = np.random.default_rng(5)
    x, y = np.arange(60.0), rng.random(60)
    edges, means = calibration.pool(x, y, np.ones(60))
    fitted = means[np.searchsorted(edges, x)]
    direct = [max(min(y[j : k + 1].mean() for k in range(i, 60)) for j in range(i + 1)) for i in range(60)]
    assert np.allclose(fitted, direct)
    assert calibration.apply_isotonic([0.2, 0.6], [0.1, 0.5], 0.4) == pytest.approx(0.3) and calibration.apply_isotonic([], [], 0.4) == 0.4


def test_beta_fit_solves_its_equations():
    rng = np.random.default_rng(7)
    p = rng.random(800) * 0.9 + 0.05
    y = (rng.random(800) < p**1.5 / (p**1.5 + (1 - p) ** 1.5)).astype(float)
    beta = calibration.newton(p, y, np.ones(800))
    x = np.stack([np.log(p), -np.log(1 - p), np.ones(800)], 1)
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ beta)))).max() < 1e-5
    assert calibration.newton(p[:2], y[:2], np.ones(2)) is None


def test_normal_cdf(spark):
    xs = [x / 10 for x in range(-80, 81)]
    got = [r.c for r in spark.createDataFrame([(x,) for x in xs], "x double").orderBy("x").select(normal_cdf(F.col("x")).alias("c")).collect()]
    assert max(abs(a - 0.5 * (1 + math.erf(x / math.sqrt(2)))) for a, x in zip(got, xs, strict=True)) < 1e-7


def test_gbm(spark):
    df = spark.createDataFrame([(100.0, 110.0, 0.5, 1.0), (100.0, 90.0, 0.5, 1.0), (100.0, 100.0, 0.5, 1.0), (100.0, 110.0, 0.5, 0.0)], "s double, k double, v double, t double")
    args = [F.col(c) for c in "skvt"]
    got = with_gbm_touch(df.withColumn("above", gbm_above(*args)), "touch", *args).collect()
    assert all(r.touch >= r.above - 1e-9 for r in got[:1]) and got[2].touch == 1.0 and got[3].touch == 0.0 and got[3].above == 0.0


def test_as_of_boundaries(spark):
    p = spark.createDataFrame([(1, "2024-01-01 00:00:00", 0.1, 1), (1, "2024-01-01 02:00:00", 0.2, 2)], "m long, at string, price double, id long").withColumn("at", F.col("at").cast("timestamp"))
    a = spark.createDataFrame([(1, "2024-01-01 02:00:00"), (1, "2024-01-01 04:00:01"), (1, "2023-01-01 00:00:00")], "m long, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = lambda **how: [r.price for r in latest.as_of(a, p, "m", "t", "at", ["price", "id"], "id", **how).orderBy("t").collect()]
    assert got() == [None, 0.2, 0.2]
    assert got(strict=True) == [None, 0.1, 0.2]
    assert got(tolerance_seconds=7200) == [None, 0.2, None]


def loop_budget(rows, budget, reserve=0.4, share=0.2, least=14, volume=500):
    """The rule as a plain loop over all markets of one venue."""
    cap = max(least, int(budget * share))
    series = lambda r: r["series"] if r["series"] is not None else (("e", r["event"]) if r["event"] is not None else ("m", r["id"]))
    fair = [r for r in rows if r["open"] and r["accepting"] and (r["volume"] or 0) >= volume]
    scoring = sorted((r for r in fair if r["horizon"]), key=lambda r: (not r["modellable"], r["horizon"], -r["volume"], r["id"]))
    events, chosen, used = {}, [], {}
    for r in rows:
        if r["open"] and r["event"] is not None:
            events.setdefault(r["event"], []).append(r)

    def add(r):
        if r["id"] not in chosen:
            chosen.append(r["id"])
            used[series(r)] = used.get(series(r), 0) + 1

    def fill(order, most):
        for r in order:
            if len(chosen) >= most:
                return
            if r["id"] in chosen or used.get(series(r), 0) >= cap:
                continue
            group = events.get(r["event"], [r])
            for x in group if len(chosen) + len(group) <= most and used.get(series(r), 0) + len(group) <= cap else [r]:
                add(x)

    held = int(budget * reserve)
    fill(scoring, budget - held)
    if held:
        fill(sorted(fair, key=lambda r: (-r["volume"], r["id"])), budget)
    for r in scoring:
        if len(chosen) >= budget:
            break
        add(r)
    return set(chosen)


@pytest.mark.parametrize("budget,reserve,n,deep", [(100, 0.4, 900, 6), (100, 0.0, 900, 6), (30, 0.4, 500, 40), (200, 0.4, 900, 2), (60, 1.0, 400, 6)])
def test_budget_against_a_loop(spark, budget, reserve, n, deep):
    rng = random.Random(budget + n)
    rows = []
    for v in "pq":
        for i in range(n):
            event = rng.randrange(n // 5) if rng.random() < 0.9 else None
            series = event % deep if event is not None and rng.random() < 0.95 else rng.choice([None, 3])
            rows.append((v, i, event, series, rng.random() < 0.9, rng.random() < 0.95, rng.random() < 0.4, rng.choice([None, 1, 2, 3]), rng.choice([None, *range(100, 3000, 50)])))
    df = spark.createDataFrame(rows, "platform string, market_id long, event_id long, series long, open boolean, accepting boolean, modellable boolean, horizon int, volume long")
    got = ranking.book_budget(df, budget, reserve=reserve).collect()
    for v in "pq":
        mine = [dict(zip(("id", "event", "series", "open", "accepting", "modellable", "horizon", "volume"), (i, e, None if s is None else str(s), o, a, m, h, x), strict=True)) for p, i, e, s, o, a, m, h, x in rows if p == v]
        assert {r.market_id for r in got if r.platform == v} == loop_budget(mine, budget, reserve)


def test_jobs():
    order = operations.topological()
    assert all(order.index(u) < order.index(j) for j, ups in operations.JOBS.items() for u in ups)
    with pytest.raises(ValueError):
        operations.topological({"a": ("b",), "b": ("a",)})


def test_violations_and_reconciliation(spark):
    rows = spark.createDataFrame([(1, 5), (2, None)], "id int, x int")
    assert [(r.id, r.rule) for r in operations.violations(rows, {"has_x": F.col("x").isNotNull()}).collect()] == [(2, "has_x")]
    reasons = spark.createDataFrame([("g", "a", 2), ("g", "b", 3), ("h", "a", 1)], "group string, reason string, n int")
    totals = spark.createDataFrame([("g", 5), ("h", 2)], "group string, total int")
    assert [r.group for r in operations.reconciled(reasons, totals).collect()] == ["h"]


def test_kalshi_payloads(spark):
    row = {"ticker": "K-1", "event_ticker": "KXB-26", "title": "Price", "subtitle": "$1", "status": "active", "yes_bid_dollars": "0.0000", "yes_ask_dollars": "1.0000", "yes_ask_size_fp": "0.00", "no_bid_dollars": "0.9900", "price_ranges": [{"start": "0", "end": "1", "step": "0.0100"}], "expected_expiration_time": "2026-07-25T06:05:00Z", "floor_strike": 74299.99}
    df = spark.createDataFrame([(json.dumps(row),), ("{not json",), (json.dumps({"title": "no ticker"}),)], "raw string")
    got = venues.kalshi_markets(df).collect()
    assert len(got) == 1 and got[0].yes_ask is None and got[0].spread is None and got[0].fee_rate == D("0.07") and got[0].tick_size == D("0.01") and got[0].floor_strike == D("74299.99") and got[0].accepting_orders
    book = {"ticker": "K-1", "orderbook_fp": {"yes_dollars": [], "no_dollars": [["0.9900", "73469"], ["0.5000", "10"]]}}
    levels = venues.kalshi_book(spark.createDataFrame([(json.dumps(book),)], "raw string")).collect()
    asks = sorted((r.price, r.size) for r in levels if r.side == "yes" and r.is_ask)
    assert asks[0] == (D("0.0100"), 73469) and not [r for r in levels if r.side == "no" and r.is_ask]


def test_polymarket_payloads(spark):
    row = {"id": "7", "question": "Who wins the elections?", "outcomes": '["Yes", "No"]', "clobTokenIds": '["a", "b"]', "outcomePrices": '["0.25", "0.75"]', "bestBid": 0.24, "bestAsk": 0.26, "endDate": "2026-06-01T00:00:00Z", "closed": False, "active": True, "orderPriceMinTickSize": 0.001, "orderMinSize": 5, "negRisk": True}
    m = venues.polymarket_markets(spark.createDataFrame([(json.dumps(row),), ("",)], "raw string")).collect()
    assert len(m) == 1
    m = m[0]
    assert (m.no_bid, m.no_ask, m.yes_token, m.no_token, m.last_price, m.status, m.market_type) == (D("0.74"), D("0.76"), "a", "b", D("0.25"), "open", "binary")
    assert m.fee_rate == D("0.04") and (m.resolves - m.close_time).total_seconds() == 7200 and m.negative_risk


def test_resolutions(spark):
    df = spark.createDataFrame([("finalized", "yes", None), ("settled", "no", "0.5"), ("active", "yes", None), ("settled", "", None)], "s string, r string, v string")
    assert [x.p for x in df.select(venues.kalshi_resolution(F.col("s"), F.col("r"), F.col("v")).alias("p")).collect()] == [1, D("0.5"), None, None]
    assert [x.r for x in spark.createDataFrame([(0.995,), (0.005,), (0.5,), (0.7,)], "p double").select(venues.polymarket_resolution(F.col("p")).alias("r")).collect()] == ["yes", "no", "fifty_fifty", None]


def test_pages_read_by_spark(spark, tmp_path):
    pages = [{"cursor": "", "items": [{"a": 1}], "next": "x"}, {"cursor": "x", "items": [{"a": 2}, {"a": 3}], "next": ""}, {"cursor": "y", "items": [{"a": 9}], "next": "y"}]
    for name in "pq":
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, pages if name == "p" else pages[:1])))
    got = paged.read_pages(spark, str(tmp_path)).collect()
    assert sorted((r.file[-7:], r.page, json.loads(r.raw)["a"]) for r in got) == [("p.jsonl", 0, 1), ("p.jsonl", 1, 2), ("p.jsonl", 1, 3), ("q.jsonl", 0, 1)]


def test_append_twice_is_append_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "k long, v string")
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.append_new(rows, path, ["k"], ["v"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b")]


def _stream(spark, df, path):
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _finished(spark, frame, name, mode):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_stream_windows_equal_batch(spark, sf, tmp_path):
    p = adapters.prices(spark, sf)
    batch = windows.tumbling(p, "6 hours").toPandas().sort_values(["window", "market_id"], key=lambda s: s.astype(str))
    live = _finished(spark, windows.tumbling(_stream(spark, p, str(tmp_path / "s")), "6 hours"), "tumbling", "complete").toPandas().sort_values(["window", "market_id"], key=lambda s: s.astype(str))
    pd.testing.assert_frame_equal(batch.reset_index(drop=True).drop(columns="mean"), live.reset_index(drop=True).drop(columns="mean"))


def test_stream_deduplication(spark, sf, tmp_path):
    p = adapters.prices(spark, sf)
    twice = p.unionByName(p)
    live = _finished(spark, windows.deduplicated(_stream(spark, twice, str(tmp_path / "d")), ["event_id"]), "dedup", "append")
    assert live.count() == p.count()
