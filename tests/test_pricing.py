"""Golden values of fees, walks, costs and baskets."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from oddsloom.functions.numeric import PRICE, RATE, SIZE, ceil_cent, dec, exact, snap_to_tick
from oddsloom.functions.timeops import at, horizon, horizons, parse_moment
from oddsloom.operators import arbitrage, backtest, baskets, books, cost, fees

LEVELS = [("b", "yes", True, ".40", 100), ("b", "yes", True, ".42", 200), ("b", "yes", True, ".45", 500), ("b", "no", True, ".58", 150), ("b", "no", True, ".60", 300), ("b", "yes", False, ".39", 100), ("b", "yes", False, ".38", 200), ("b", "no", False, ".57", 100)]


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def book(spark, levels=LEVELS):
    rows = spark.createDataFrame([(*x[:3], str(x[3]), str(x[4])) for x in levels], "book_id string, side string, is_ask boolean, price string, size string")
    return rows.withColumn("price", F.col("price").cast(PRICE)).withColumn("size", F.col("size").cast(SIZE))


def test_taker_schedule(spark):
    known = {".01": ".07", ".10": ".63", ".25": "1.32", ".50": "1.75", ".75": "1.32", ".90": ".63", ".99": ".07"}
    for p, fee in known.items():
        assert one(spark, f=fees.cent_fee(F.lit(100), dec(p, PRICE), dec("0.07", RATE))).f == D(fee)


def test_maker_fine_flat_and_guards(spark):
    r = dec("0.07", RATE)
    got = one(
        spark,
        maker=fees.maker_fee(F.lit(100), dec("0.50", PRICE)),
        low=fees.maker_fee(F.lit(100), dec("0.01", PRICE)),
        fine=fees.fine_fee(F.lit(100), dec("0.01", PRICE), r),
        single=fees.cent_fee(F.lit(1), dec("0.20", PRICE), r),
        zero=fees.cent_fee(F.lit(1), dec("0", PRICE), r),
        full=fees.cent_fee(F.lit(1), dec("1", PRICE), r),
        none=fees.cent_fee(F.lit(0), dec("0.5", PRICE), r),
        flat=fees.taker_fee(F.lit("kalshi"), F.lit(3), dec("1", PRICE), r, F.lit("flat")),
        other=fees.taker_fee(F.lit("elsewhere"), F.lit(3), dec("0.5", PRICE), r, F.lit("")),
    )
    assert (got.maker, got.low, got.fine, got.single) == (D("0.44"), D("0.02"), D("0.0693"), D("0.02"))
    assert (got.zero, got.full, got.none, got.flat, got.other) == (0, 0, 0, D("0.21"), 0)


def test_fee_product_is_exact(spark):
    kind = spark.range(1).select(fees.quadratic(F.lit(1), F.lit("0.5").cast(PRICE), F.lit("0.07").cast(RATE)).alias("x")).schema["x"].dataType
    assert (kind.precision, kind.scale) == (36, 18)


def test_rounding_and_ticks(spark):
    got = one(spark, a=ceil_cent(dec(".0101", "decimal(8,4)")), b=ceil_cent(dec(".01", "decimal(8,4)")), up=snap_to_tick(dec(".4321", PRICE), dec(".01", PRICE), "up"), down=snap_to_tick(dec(".4321", PRICE), dec(".01", PRICE), "down"), bad=exact(F.lit("n/a")))
    assert (got.a, got.b, got.up, got.down, got.bad) == (D(".02"), D(".01"), D(".44"), D(".43"), None)


def test_walk_deep_book(spark):
    got = {int(r.requested): r for r in books.walk(books.asks(book(spark), "yes"), ["book_id"], F.array(*map(F.lit, (100, 200, 1000)))).collect()}
    assert (got[100].average, got[200].average, got[200].worst) == (D("0.4000"), D("0.4100"), D("0.42"))
    assert (got[1000].filled, got[1000].notional, got[1000].fully_filled) == (800, 349, False)


def test_top_of_book_and_arrays(spark):
    t = books.top_of_book(book(spark), ["book_id"]).first()
    assert t.yes_ask - t.yes_bid == D("0.01") and t.yes_ask + t.no_ask == D("0.98")
    r = books.rebuilt(book(spark), ["book_id"], 2).first()
    assert [float(x.price) for x in r.yes_asks] == [0.40, 0.42] and [float(x.price) for x in r.yes_bids] == [0.39, 0.38]


def test_complete_sets(spark):
    lv = book(spark, [("b", "yes", True, ".45", 100), ("b", "yes", True, ".50", 500), ("b", "no", True, ".52", 80), ("b", "no", True, ".54", 500)])
    m = books.matched_walk(books.asks(lv, "yes"), books.asks(lv, "no"), ["book_id"]).first()
    assert (m.sets, m.cost) == (100, D("97.40"))


def test_matched_walk_has_no_nested_loop(spark):
    lv = book(spark)
    plan = books.matched_walk(books.asks(lv, "yes"), books.asks(lv, "no"), ["book_id"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_value(spark):
    d = lambda x: dec(x, "decimal(10,6)")
    got = one(spark, ev=cost.net_ev(d(".60"), d(".58")), roi=cost.net_roi(d(".60"), d(".50")), kelly=cost.kelly(d(".60"), d(".50")), none=cost.kelly(d(".40"), d(".50")))
    assert (float(got.ev), float(got.roi), float(got.kelly), float(got.none)) == (0.02, 0.2, 0.05, 0.0)


def test_basket(spark):
    legs = spark.createDataFrame([("k", 0, "deep", 1, 400), ("k", 1, "thin", 1, 40)], "basket string, leg_no int, label string, ratio int, available int")
    got = baskets.capacity(legs, ["basket"]).first()
    assert (float(got.units), got.binding_leg) == (40.0, "thin")
    ladders = spark.createDataFrame([("k", 0, "0.45", 400), ("k", 1, "0.50", 40)], "basket string, leg_no int, price string, size int").withColumn("price", F.col("price").cast(PRICE)).withColumn("size", F.col("size").cast(SIZE))
    out = baskets.simulate(ladders, legs.withColumn("ratio", F.col("ratio").cast(SIZE)), ["basket"], F.lit(100)).first()
    assert (float(out.executable_units), float(out.total_cost), out.fully_executable, out.fully_hedged) == (40.0, 38.0, False, True)


def _ev(levels, size, win, fee=0.07):
    left, spent = size, 0.0
    for p, s in levels:
        take = min(left, s)
        spent, left = spent + take * p, left - take
    filled = size - left
    avg = round(spent / filled, 4)
    return win - (avg + round(fee * avg * (1 - avg), 4) + 0.01), filled


def test_profitable_size_against_a_loop(spark):
    levels = [(0.40, 100.0), (0.50, 200.0), (0.60, 500.0)]
    row = spark.createDataFrame([(1,)], "id int").select(F.array(*(F.struct(F.lit(str(p)).cast(PRICE).alias("price"), F.lit(int(s)).cast(SIZE).alias("size")) for p, s in levels)).alias("asks"), F.lit("kalshi").alias("platform"), F.lit("quadratic").alias("fee_type"), dec("0.07", RATE).alias("fee_rate"), dec("0.01", PRICE).alias("tick_size"), F.lit(1).alias("min_size"), at("2024-01-15").alias("resolves"), dec("0.50", "decimal(10,6)").alias("win"))
    size = float(cost.max_profitable_size(row, at("2024-01-15")).first().cap_size)
    best = max((x / 10 for x in range(10, 8000)), key=lambda x: _ev(levels, x, 0.50)[0] * x if _ev(levels, x, 0.50)[0] > 0 else -1)
    assert _ev(levels, size, 0.50)[0] > 0 and size <= 800
    assert size * _ev(levels, size, 0.50)[0] >= 0.5 * best * _ev(levels, best, 0.50)[0]


def test_multi_outcome_size_against_a_loop(spark):
    ladders = [[(0.30, 100), (0.90, 100)], [(0.40, 150), (0.95, 100)]]
    col = F.array(*(F.array(*(F.struct(F.lit(str(p)).cast(PRICE).alias("price"), F.lit(s).cast(SIZE).alias("size")) for p, s in lad)) for lad in ladders))
    got = float(one(spark, s=arbitrage.matched_size(col, F.lit(200).cast(SIZE))).s)

    def total(size):
        out = 0.0
        for lad in ladders:
            left, spent = size, 0.0
            for p, s in lad:
                take = min(left, s)
                spent, left = spent + take * p, left - take
            out += round(spent / size, 4)
        return out

    assert total(got) < 1 <= total(got + 0.5)


def test_payouts(spark):
    rows = spark.createDataFrame([("yes", "yes"), ("yes", "no"), ("void", "no"), ("fifty_fifty", "yes"), (None, "yes")], "result string, side string").withColumn("cost", dec("0.3", PRICE))
    got = [r.p for r in rows.select(backtest.payout(F.col("result"), F.col("side"), F.col("cost")).alias("p")).collect()]
    assert got == [1, 0, D("0.3"), D("0.5"), None]


@pytest.mark.parametrize(("when", "name", "n"), [("2024-01-16 00:00:00", "24h", 3), ("2024-01-16 00:00:01", "7d", 2), ("2024-02-14 00:00:00", "30d", 1), ("2024-01-14 23:59:59", None, 0), ("2025-01-01 00:00:00", None, 0)])
def test_horizons(spark, when, name, n):
    got = one(spark, h=horizon(at(when), at("2024-01-15")), hs=horizons(at(when), at("2024-01-15")))
    assert got.h == name and len(got.hs) == n


def test_moments(spark):
    got = one(spark, iso=F.unix_seconds(parse_moment(F.lit("2026-07-25T05:00:00Z"))), s=F.unix_seconds(parse_moment(F.lit("1700000000"))), ms=F.unix_seconds(parse_moment(F.lit("1700000000000"))), bad=parse_moment(F.lit("soon")))
    assert (got.iso, got.s, got.ms, got.bad) == (1784955600, 1700000000, 1700000000, None)
