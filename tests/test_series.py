"""Nearest joins, mergeable fits and drawdowns, registered models, table functions, rule inputs and research answers."""

import hashlib
import json
import math
import random
import sys
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.functions import canonical
from oddsloom.functions import text as T
from oddsloom.operators import calibration, evidence, latest, metrics, models, registry, rules
from oddsloom.plans import adapters


# ------------------------------------------------------------------------------------- time series


def test_nearest_in_both_directions(spark):
    rng = random.Random(1)
    right = [(rng.choice("ab"), rng.randrange(4000), rng.randrange(100)) for _ in range(120)] + [("b", None, 1)]
    left = [(i, rng.choice("abc"), rng.randrange(-200, 4300), rng.randrange(4500)) for i in range(200)] + [(900, None, 5, 5), (901, "a", None, 5)]
    a = spark.createDataFrame(left, "id long, k string, t long, now long")
    b = spark.createDataFrame(right, "k string, ts long, v long")
    for until in (None, "now"):
        got = {r.id: (r.ts, r.v) for r in latest.nearest(a, b, "k", "t", "ts", ["v"], 60, until=until).collect()}
        for i, k, t, now in left:
            near = [(abs(ts - t), ts, v) for key, ts, v in right if t is not None and ts is not None and key == k and abs(ts - t) <= 60 and (until is None or ts <= now)]
            # With a bound, the neighbours on both sides are what can be chosen from.
            if until:
                before, after = [x for x in near if x[1] <= t], [x for x in [(abs(ts - t), ts, v) for key, ts, v in right if t is not None and ts is not None and key == k and ts >= t] if x[0] <= 60]
                near = ([max(before, key=lambda x: (x[1], -x[2]))] if before else []) + ([x for x in [min(after, key=lambda x: (x[1], x[2]))] if x[1] <= now] if after else [])
            want = min(near, default=(None, None, None))[1:]
            assert got[i] == want, (i, k, t)


def test_futures_anchor(spark):
    bars = [("ES", t, 100.0 + t / 7200) for t in range(0, 40 * 1800, 1800)] + [("NQ", 0, 100.0), ("NQ", 1800, 101.0), ("RTY", 0, 100.0), ("RTY", 10, 100.0), ("RTY", 20, 100.0), ("RTY", 3600, 120.0), ("ES", 99, -1.0), ("ES", None, 5.0)]
    asked = [(1, "ES", 5000.0, 1900, 36000), (2, "NQ", 5000.0, 0, 36000), (3, "RTY", 10.0, 0, 4000), (4, None, 1.0, 0, 1), (5, "ES", 5000.0, 200_000, 210_000), (6, "ES", 5000.0, 36000, 36000), (7, "ES", 1.0, 0, 10**7)]
    got = {r.id: r for r in models.futures_anchor(spark.createDataFrame(asked, "id long, symbol string, spot double, closed long, now long"), spark.createDataFrame(bars, "symbol string, ts long, close double")).collect()}
    assert {i: r.reason for i, r in got.items()} == {1: None, 2: "few_bars", 3: "implausible", 4: "no_futures", 5: "no_anchor", 6: "no_anchor", 7: "few_bars"}
    assert got[1].implied == pytest.approx(5000 * 105.0 / 100.25) and got[3].implied is None


def test_isotonic_fits_merge(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(3000), 3)
    y = (rng.random(3000) < np.clip(p + 0.3 * np.sin(9 * p), 0, 1)).astype(float)
    df = spark.createDataFrame([("a", float(x), float(v)) for x, v in zip(p, y, strict=True)] + [("b", 0.5, 1.0), ("b", 0.5, 0.0), ("c", None, 1.0)], "k string, p double, y double")
    x = np.unique(p)
    mean = np.array([y[p == v].mean() for v in x])
    edges, fitted = calibration.pool(x, mean, np.array([(p == v).sum() for v in x], float))
    for ranges in (1, 7, 64, 500):
        got = sorted((r.x, r.fitted) for r in calibration.isotonic(df, ["k"], "p", "y", ranges).where("k = 'a'").collect())
        assert np.allclose([g[0] for g in got], edges) and np.allclose([g[1] for g in got], fitted)
    assert [(r.k, r.x, r.fitted) for r in calibration.isotonic(df, ["k"], "p", "y").where("k <> 'a'").collect()] == [("b", 0.5, 0.5)]


def test_blocks_pool_like_points():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        x, y, w = np.arange(n, dtype=float), rng.integers(0, 5, n) / 4, rng.integers(1, 4, n).astype(float)
        cuts = np.sort(rng.integers(0, n + 1, int(rng.integers(0, 4))))
        parts = [calibration.pool_weighed(*(v[a:b] for v in (x, y, w))) for a, b in zip([0, *cuts], [*cuts, n], strict=True) if b > a]
        merged = calibration.pool_weighed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        whole = calibration.pool_weighed(x, y, w)
        assert all(np.allclose(a, b) for a, b in zip(merged, whole, strict=True))


def test_drawdown_by_ranges_and_positions(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(12), rng.randrange(4), i, rng.randrange(-9, 9)) for i in range(300)] + [("c", 1, 1, 999, 4), ("d", 1, 1, 998, -4)]
    df = spark.createDataFrame(rows, "k string, day long, rank long, id long, pnl long")
    want = {}
    for k in "abcd":
        run = peak = fall = 0
        for _, _, _, _, x in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:4]):
            run += x
            peak = max(peak, run)
            fall = min(fall, run - peak)
        want[k] = fall
    assert {r.k: r.max_drawdown for r in metrics.drawdown(df, ["k"], ["day", "rank", "id"], "pnl").collect()} == want
    assert {r.k: r.max_drawdown for r in metrics.drawdown(df, ["k"], ["id"], "pnl").collect()}["d"] == -4
    place = {r.id: (r.position, r.total) for r in latest.with_position(df, ["k"], ["day", "rank", "id"]).collect()}
    for k in "abcd":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[1:4])
        assert [place[r[3]] for r in mine] == [(i + 1, len(mine)) for i in range(len(mine))]


# ------------------------------------------------------------------------------- models and ladders


def test_a_registered_model_joins_the_pool(spark):
    markets = spark.createDataFrame([(1, "crypto", 0.4), (2, "sports", 0.7), (3, "crypto", 0.5)], "market_id long, category string, price double")
    price = registry.Model("target_market_reference", "target_market_price", "venue", 0.9, lambda m: m.select("market_id", F.col("price").alias("probability"), F.lit(0.5).alias("confidence")))
    known = registry.Models([price])
    alone = {r.market_id: r for r in known.pool(markets).collect()}
    assert {r.has_independent_prior for r in alone.values()} == {False}
    known.register(registry.Model("mine", "external_reference_data", "my_feed", 0.8, lambda m: m.where("market_id <> 3").select("market_id", F.lit(0.9).alias("probability"), F.lit(0.6).alias("confidence"), F.lit(0.01).alias("stdev")), ("crypto",)))
    got = {r.market_id: r for r in known.pool(markets).collect()}
    assert {m: (r.n_components, r.has_independent_prior, r.independent_sources) for m, r in got.items()} == {1: (2, True, 1), 2: (1, False, 0), 3: (1, False, 0)}
    assert got[1].mean > alone[1].mean and got[1].decision_yes is not None and got[2].mean == alone[2].mean
    with pytest.raises(ValueError, match="registered"):
        known.register(price)
    with pytest.raises(ValueError, match="gives no"):
        registry.Models([registry.Model("bad", "x", "y", 0.5, lambda m: m.select("market_id"))]).opinions(markets)
    assert registry.Models().opinions(markets).count() == 0


def test_the_walk_function(spark):
    rows = [(b, s, p / 100, float(q)) for b in (1, 2) for s in ("yes", "no") for p, q in ((30, 5), (31, 0), (32, 7), (40, 100))]
    spark.createDataFrame(rows, "book_id long, side string, price double, size double").repartition(3).createOrReplaceTempView("test_levels")
    name = registry.register_walk(spark)
    got = {(r.book_id, r.side, r.requested): (r.filled, round(r.notional, 6), r.worst, r.n_levels) for r in spark.sql(f"SELECT * FROM {name}('5, 10,500', TABLE(SELECT * FROM test_levels) PARTITION BY (book_id, side) ORDER BY price)").collect()}
    assert len(got) == 12
    assert got[1, "no", 5.0] == (5.0, 1.5, 0.3, 1) and got[2, "yes", 10.0] == (10.0, 3.1, 0.32, 2) and got[1, "yes", 500.0] == (112.0, 43.74, 0.4, 3)


# ---------------------------------------------------------------------------------------- titles


def test_letters_without_marks_on_every_code_point(spark):
    points = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    texts = ["x" + "".join(points[i : i + 500]) + "y" for i in range(0, len(points), 500)] + ["résumé", "ﬁnal", "Ａpple", "½", "", "plain", None]
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert [r.p for r in df.select("i", T.strip_accents(F.col("t")).alias("p")).orderBy("i").collect()] == want


def test_canonical_json_is_pythons(spark):
    odd = ["plain", 'quo"te \\ back', "tab\tline\nfeed\r\x07\x1f", "é漢🎉 ", "", "/slash", None]
    got = [r.j for r in spark.createDataFrame(list(enumerate(odd)), "i long, t string").select("i", canonical.json_string(F.col("t")).alias("j")).orderBy("i").collect()]
    assert got == [None if x is None else json.dumps(x) for x in odd]
    rows = spark.createDataFrame([(["b", 'a"', "é"], True, None)], "x array<string>, y boolean, z boolean")
    got = rows.select(canonical.json_object({"z": canonical.json_boolean(F.col("z")), "a b": canonical.json_strings(F.col("x")), "y": canonical.json_boolean(F.col("y"))}).alias("j")).first().j
    assert got == json.dumps({"z": None, "a b": ["b", 'a"', "é"], "y": True}, sort_keys=True)
    numbers = ["70000", "3.50", "0.0", "1e3", "-2.10", "x", None]
    assert [r.n for r in spark.createDataFrame(list(enumerate(numbers)), "i long, t string").select("i", canonical.plain_number(F.col("t")).alias("n")).orderBy("i").collect()] == ["70000", "3.5", "0", "1000", "-2.1", None, None]


def test_rules_are_replayed_from_their_inputs(spark):
    cut = "2026-07-25 06:59:00"
    rows = [(1, "Will Bitcoin be above $70k?", "on Friday", "Revised data. CF Benchmarks BRTI, not including overtime", "", cut, None, None, False), (2, "Finish top 20", "", None, "ESPN", None, None, "gte", True), (3, "Bitcoin é above 3", "", "", "", cut, "74299.990", "gt", True)]
    df = spark.createDataFrame(rows, "id long, title string, subtitle string, description string, source string, cut string, strike string, cmp string, structured boolean").withColumn("cut", F.col("cut").cast("timestamp"))
    inputs = df.select("id", rules.rule_inputs(*(F.col(c) for c in ("title", "subtitle", "description", "source", "cut", "strike", "cmp", "structured"))).alias("inputs"))
    made = {r.id: r for r in rules.with_rules(inputs, "inputs").collect()}
    assert json.loads(made[3].inputs)["explicit_threshold"] == "74299.99" and made[3].inputs == json.dumps(json.loads(made[3].inputs), sort_keys=True)
    for r in made.values():
        assert r.payload == json.dumps(json.loads(r.payload), sort_keys=True) and r.hash == hashlib.sha256(r.payload.encode()).hexdigest()[:32]
    first = json.loads(made[1].payload)
    assert (first["comparator"], first["threshold"], first["cutoff"], first["source"], first["overtime"], first["revised"]) == ("gt", "70000", "2026-07-25T06", "cf_benchmarks", False, True)
    assert json.loads(made[2].payload)["threshold"] == "" and made[3].terms.threshold == "74299.99"
    stored = spark.createDataFrame([(1, made[1].inputs, made[1].hash), (2, made[1].inputs.replace("Bitcoin", "Solana"), made[1].hash), (3, None, "x"), (4, "{broken", "x"), (5, "[1]", "x"), (6, made[1].inputs.replace("06:59", "06:01"), made[1].hash)], "id long, inputs string, stored string")
    assert {r.id: r.finding for r in rules.replayed(stored, "inputs", "stored").collect()} == {1: None, 2: "changed", 3: "no_inputs", 4: "unreadable", 5: "unreadable", 6: None}


def test_research_answers_are_parsed_strictly(spark):
    good = {"decisive_question": "q", "sources": [{"name": "a", "source_quality": 0.8}, {"name": "b", "is_novel": False, "stance": "conflicting", "published_at": "2026-01-02T03:04:05Z"}], "supports_yes": ["x"], "probability": 1.7, "self_reported_confidence": "0.25", "extra": {"z": 1}}
    cases = {
        "good": json.dumps(good), "fenced": "```json\n" + json.dumps(good, indent=1) + "\n```", "words": "Sure: " + json.dumps(good) + " thanks", "minimal": "{}",
        "empty": "  ", "no_object": "none", "not_json": '{"a": }', "sources": '{"sources": [{"name": ""}]}', "sources2": '{"sources": "x"}', "sources3": '{"sources": [1]}', "sources4": '{"sources": null}', "sources5": '{"sources": [{"name": "a", "url": 3}]}', "sources6": '{"sources": [{"name": "a", "is_novel": "perhaps"}]}', "sources7": json.dumps({"sources": [{"name": "n" * 201}]}),
        "supports_yes": '{"supports_yes": [1]}', "conflicts": '{"conflicts": {}}', "reasoning": '{"reasoning": 5}', "decisive_question": '{"decisive_question": null}',
        "odd_numbers": '{"probability": "maybe", "self_reported_confidence": [1], "sources": [{"name": "a", "source_quality": -3}, {"name": "b", "source_quality": "NaN"}]}', "null": None,
    }
    got = {r.id: r for r in evidence.parsed(spark.createDataFrame(list(cases.items()), "id string, text string")).collect()}
    want = {k: k.rstrip("0123456789") for k in cases if k not in ("good", "fenced", "words", "minimal", "odd_numbers", "null")} | {"null": "empty"}
    assert {k: r.refused for k, r in got.items() if r.refused} == want
    for k in ("good", "fenced", "words"):
        r = got[k]
        assert (r.question, r.confidence, r.n_yes, r.n_conflicts, r.n_novel) == ("q", 0.25, 1, 0, 1) and r.probability == pytest.approx(1 - 1e-6) and r.quality == pytest.approx(0.8 * (0.7 + 0.1))
        assert [(s.name, s.stance, s.is_novel, s.quality) for s in r.sources] == [("a", "neutral", True, 0.8), ("b", "conflicting", False, 0.5)] and r.sources[1].published_at is not None
    assert (got["minimal"].quality, got["minimal"].probability, got["minimal"].confidence, got["minimal"].sources) == (0.0, None, 0.0, [])
    assert got["odd_numbers"].probability is None and got["odd_numbers"].confidence == 0 and [s.quality for s in got["odd_numbers"].sources] == [0.0, 0.5]
    assert all(r.quality is None and r.sources is None for r in got.values() if r.refused)
    assert math.isclose(got["odd_numbers"].quality, 0.5 * (0.7 + 0.3 * 2 / 3)) and adapters is not None


def test_order_statistics_with_outliers(spark):
    from oddsloom.operators import places

    rng = random.Random(7)
    rows = [("a", rng.randrange(50)) for _ in range(400)] + [("a", 10**9), ("a", -(10**9))] + [("b", 5)] + [("c", None)] + [("d", x) for x in range(1000)]
    got = {r.k: r for r in places.values_at(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", places.MIDDLE | places.QUARTILES, buckets=16).collect()}
    assert set(got) == {"a", "b", "d"}
    for k, r in got.items():
        v = sorted(x for key, x in rows if key == k)
        n = len(v)
        assert (r.n, r.low, r.high, r.p25, r.p75) == (n, v[(n - 1) // 2], v[-(-(n - 1) // 2)], v[n // 4], v[3 * n // 4])
