"""Venue events, batches of books and model feeds from recorded payloads, sessions and past markets."""

import datetime
import json

from pyspark.sql import functions as F

from oddsloom.functions import text as T
from oddsloom.operators import calendar, matching, models, operations, replay
from oddsloom.sources import feeds


def payload(spark, *bodies, **columns):
    names = list(columns)
    rows = [(json.dumps(b) if not isinstance(b, str) else b, *(columns[n][i] for n in names)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, ["raw", *names])


def test_events_of_venues(spark):
    k = {"events": [{"event_ticker": "KXHIGH-26", "title": "", "sub_title": "High in Boston", "category": "Climate and Weather", "mutually_exclusive": True, "markets": [{"ticker": "a"}, {"ticker": "b"}]}, {"event_ticker": ""}]}
    got = feeds.kalshi_events(payload(spark, k, "no json")).collect()
    assert [(r.event_id, r.series_ticker, r.title, r.normalized_title, r.category, r.mutually_exclusive, r.exhaustive, r.outcome_count) for r in got] == [("KXHIGH-26", "KXHIGH", "High in Boston", "high in boston", "weather", True, False, 2)]
    p = [{"id": "7", "title": "Winner", "negRisk": True, "tags": [{"slug": "politics"}], "markets": [{"id": "1"}, {"id": "2"}, {"id": "3"}], "endDate": "2026-01-01T00:00:00Z"}, {"id": "8", "title": "Other"}]
    got = {r.event_id: (r.category, r.mutually_exclusive, r.exhaustive, r.outcome_count) for r in feeds.polymarket_events(payload(spark, p)).collect()}
    assert got == {"7": ("politics", True, True, 3), "8": ("other", False, False, 0)}


def test_batches_of_books(spark):
    book = lambda t: {"ticker": t, "orderbook_fp": {"yes_dollars": [["0.40", "10"]], "no_dollars": []}}
    rows = payload(spark, {"orderbooks": [book("a"), book("b")]}, {"orderbooks": [book("c")]}, batch=[1, 2])
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], "batch long, ticker string")
    levels, again = feeds.kalshi_batch_books(rows, asked)
    assert {r.market_id for r in levels.collect()} == {"a", "b"} and sorted(r.ticker for r in again.collect()) == ["c", "d"]


def test_model_feeds(spark):
    candles = feeds.coinbase_candles(payload(spark, [[3600, 1, 4, 2, 3, 9], [0, 1, 2, 1, 2, 5], [0, 1, 2, 1, 2, 5]], product=["BTC-USD"])).collect()
    assert sorted((r.close, r.volume) for r in candles) == [(2.0, 5.0), (3.0, 9.0)]
    chart = {"chart": {"result": [{"meta": {"symbol": "^GSPC"}, "timestamp": [10, 20, 30], "indicators": {"quote": [{"close": [1.5, None, 2.5]}]}}]}}
    assert [r.close for r in feeds.yahoo_chart(payload(spark, chart)).collect()] == [1.5, 2.5]
    nws = {"properties": {"periods": [{"startTime": "2026-01-02T06:00:00-05:00", "isDaytime": True, "temperature": 10, "temperatureUnit": "C"}, {"startTime": "2026-01-02T18:00:00-05:00", "isDaytime": False, "temperature": 90, "temperatureUnit": "F"}]}}
    assert [(r.station, r.day, r.high) for r in feeds.nws_forecasts(payload(spark, nws, station=["NYC"])).collect()] == [("NYC", datetime.date(2026, 1, 2), 50.0)]
    team = lambda side, name, won: {"homeAway": side, "score": "1", "winner": won, "team": {"abbreviation": name}}
    game = lambda i, at, state, won: {"id": i, "date": at, "status": {"type": {"name": state}}, "competitions": [{"competitors": [team("home", "A", won), team("away", "B", not won)]}]}
    games = feeds.espn_games(payload(spark, {"events": [game("1", "2026-01-01T00:00:00Z", "STATUS_FINAL", True), game("2", "2026-01-02T00:00:00Z", "STATUS_FINAL", False), game("3", "2026-01-03T00:00:00Z", "STATUS_SCHEDULED", False)]}))
    cutoff = F.lit("2026-01-02 00:00:00").cast("timestamp")
    assert {(r.team, r.wins, r.losses) for r in feeds.team_records(games, cutoff).collect()} == {("A", 1, 0), ("B", 0, 1)}
    asked = spark.createDataFrame([(1, "A", "B", "2026-01-03 04:00:00"), (2, "A", "B", "2026-01-03 09:00:00")], "key long, home string, away string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert [(r.key, r.game_id) for r in feeds.nearest_fixture(asked, games).collect()] == [(1, "3")]


def test_demo_rows_and_snapshots(spark):
    demo = feeds.demo_history(spark, 5, 4)
    assert demo.count() == 20 and sorted(map(tuple, demo.collect())) == sorted(map(tuple, feeds.demo_history(spark, 5, 4).repartition(3).collect()))
    both = demo.limit(2).unionByName(demo.limit(2).withColumn("provenance", F.lit(None).cast("string")))
    assert feeds.purged(both).count() == 2
    kept = feeds.reachable(spark.range(10).toDF("market_id"), "market_id", [spark.range(2).toDF("x"), spark.range(1, 4).toDF("y")])
    assert sorted(r.market_id for r in kept.collect()) == [0, 1, 2, 3]
    rows = spark.createDataFrame([("open", "S", 1), ("settled", "T", 2)], "status string, series_ticker string, event_id long")
    assert [feeds.discovered(rows, rows.limit(1), ["S"], m).count() for m in ("active", "modellable", "with_events", "historical")] == [1, 1, 1, 1]


def test_titles_and_rules(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v
    assert one("Čech ﬁnal Ångström", T.strip_accents) == "Cech final Angstrom"
    assert one("Open 2026: above $70k or 3 goals", T.thresholds) == [70000.0, 3.0] and one("Round 3", T.thresholds) == [3.0]
    assert one("by Jul 25, 2026 or 3 march, 31 Feb 2025 and 2024-02-29", lambda c: T.dates(c, 2030)) == [datetime.date(2024, 2, 29), datetime.date(2026, 7, 25), datetime.date(2030, 3, 3)]
    assert one("Settles by the National Weather Service", T.source_family) == "nws" and one("This market will resolve", T.source_family) == ""
    assert one("Will Scheffler beat Rory McIlroy by March", T.proper_nouns) == ["scheffler", "rory", "mcilroy"] and one("Denver wins", T.proper_nouns) == []
    assert one("Ties void. It settles early. End", lambda c: T.clause(c, ("settle", "void"))) == "Ties void. It settles early"
    assert one("Ties void. It settles early. End", lambda c: T.clause(c, ("settle", "void"), 9)) == "Ties void"


def test_names_on_one_side_only_make_pairs_incompatible(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [(1, "Will Scheffler win above 3", "espn", "sports", at, None), (2, "Will McIlroy win above 3", "espn", "sports", at, None), (3, "Will Scheffler win above 3", "espn", "sports", at, None)]
    terms = matching.market_terms(spark.createDataFrame(rows, "market_id long, title string, rules string, category string, resolves timestamp, strike double"))
    pairs = spark.createDataFrame([(1, 2, 0.9, 0.9, 0.9), (1, 3, 0.9, 0.9, 0.9)], "a long, b long, similarity double, overlap double, score double")
    got = {(r.a, r.b): (r.nouns_missing, r.compatibility) for r in matching.verify(matching.paired(pairs, terms, terms)).collect()}
    assert got == {(1, 2): (True, "INCOMPATIBLE"), (1, 3): (False, "IDENTICAL")}


def test_sessions(spark):
    utc = lambda *x: datetime.datetime(*x)
    rows = [
        (utc(2025, 1, 8, 14, 30), utc(2025, 1, 8, 21, 0), 6.5, 0.0),  # a session
        (utc(2025, 1, 9, 14, 30), utc(2025, 1, 9, 21, 0), 0.0, 6.5),  # a holiday: futures trade
        (utc(2025, 11, 28, 14, 30), utc(2025, 11, 28, 21, 0), 3.5, 3.0),  # an early close
        (utc(2025, 1, 11, 0, 0), utc(2025, 1, 12, 12, 0), 0.0, 0.0),  # a weekend
        (utc(2025, 1, 8, 15, 0), utc(2025, 1, 8, 14, 0), 0.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp, cash double, night double")
    got = df.select("cash", "night", calendar.cash_hours(F.col("a"), F.col("b")).alias("c"), calendar.overnight_hours(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(abs(r.cash - r.c) < 1e-9 and abs(r.night - r.n) < 1e-9 for r in got), got


def test_past_markets_and_guards(spark):
    day = lambda d: datetime.datetime(2026, 1, d)
    m = spark.createDataFrame([(1, day(2), day(9), "yes", 5.0), (2, day(6), day(9), None, None), (3, None, day(5), "no", 1.0)], "market_id long, opens timestamp, closes timestamp, result string, volume double").withColumn("resolves", F.col("closes")).withColumn("status", F.lit("settled"))
    got = {r.market_id: (r.refused, r.cleared) for r in replay.rewound(m, F.lit("2026-01-05 00:00:00").cast("timestamp")).collect()}
    assert got == {1: (None, ["result", "volume"]), 2: ("before_open", []), 3: ("after_close", ["result", "volume"])}
    assert not set(replay.REVEALING) & set(replay.rewound(m, F.current_timestamp()).columns)
    q = spark.createDataFrame([(1, 0.8, True), (1, 0.9, False), (2, 0.9, False)], "k long, quality double, is_novel boolean")
    assert {r.k: round(r.quality, 6) for r in models.evidence_quality(q, "k").collect()} == {1: 0.64, 2: 0.25}
    runs = spark.createDataFrame([(1, "orderbooks", "failed"), (1, "rank", "running"), (1, "settle", "succeeded"), (2, "rank", "running")], "batch long, job string, status string")
    assert [(r.batch, r.job, r.failed) for r in operations.blocked_runs(runs).collect()] == [(1, "rank", ["orderbooks"])]
    assert [(r.job, r.n) for r in operations.doubly_active(runs).collect()] == [("rank", 2)]
