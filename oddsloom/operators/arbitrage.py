"""Scans for arbitrage and for prices that no probability allows.

Scans are joins of ladders keyed by a market, pair or event, so they distribute by that key.  Labels
are tested from the last check to the first, since later checks overrule earlier ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import PRICE, SIZE, safe_div, usd
from . import books, cost, fees

#: Configuration.
MAX_QUOTE_AGE, MIN_NOTIONAL, MOST_SETS, EXECUTION_RISK = 300, 25, 10_000, "0.01"
MIN_VIOLATION, SUM_TOLERANCE, MIN_DIVERGENCE = "0.02", "0.03", "0.04"
#: Least edge across venues, by whether both legs have LIQUID_DEPTH behind them.
MIN_EDGE_LIQUID, MIN_EDGE_THIN, LIQUID_DEPTH = "0.04", "0.05", 2000
#: Label of a pair by the verdict on its equivalence.
VERDICT_LABELS = {
    "VERIFIED_EQUIVALENT_STRICT": "EXECUTABLE",
    "VERIFIED_EQUIVALENT_STANDARD": "RULE_MISMATCH_RISK",
    "PROBABLE_MATCH": "RULE_MISMATCH_RISK",
    "RELATED_NOT_EQUIVALENT": "NOT_GUARANTEED",
}
#: What a label means: opportunity class, and whether it may be acted on or called arbitrage.
TAXONOMY = {
    "EXECUTABLE": ("arbitrage", True, True),
    "RULE_MISMATCH_RISK": ("relative_value", True, False),
    "EXECUTION_RISK": ("arbitrage", False, False),
    "STALE_QUOTE": ("diagnostic", False, False),
    "INSUFFICIENT_LIQUIDITY": ("diagnostic", False, False),
    "NOT_GUARANTEED": ("diagnostic", False, False),
    "LOGICAL_MISPRICING": ("diagnostic", False, False),
}


def label(base: Column, age: Column, total: Column, accepting: Column | None = None) -> Column:
    """The label of a scan: not accepting orders, then too little money, then stale, then the base."""
    out = F.when(~accepting, "EXECUTION_RISK") if accepting is not None else F.when(F.lit(False), "")
    return out.when(total < MIN_NOTIONAL, "INSUFFICIENT_LIQUIDITY").when(age > MAX_QUOTE_AGE, "STALE_QUOTE").otherwise(base)


def _settled_costs(sets: Column, legs: Sequence[tuple[Column, Column, Column, Column, Column]], price: Column, resolves: Column | None, now: Column) -> Column:
    """Fees, slippage, transfers and capital of ``sets`` of legs (platform, average, rate, fee type, tick)."""
    total = F.lit(0).cast("decimal(20,8)")
    for platform, average, rate, fee_type, tick in legs:
        total = total + fees.taker_fee(platform, sets.cast(SIZE), average, rate, fee_type) + (tick * cost.SLIPPAGE_TICKS * sets).cast("decimal(20,8)") + (cost.transfer_cost(platform, sets) * sets).cast("decimal(20,8)")
    if resolves is not None:
        total = total + (cost.capital_cost(price, resolves, now) * sets).cast("decimal(20,8)")
    return total.cast("decimal(20,8)")


def _result(rows: DataFrame, gross: Column, extra: Column) -> DataFrame:
    """Adds what every scan reports, from sets, gross cost and other costs; keeps profits over 0."""
    out = rows.withColumn("gross", gross.cast("decimal(20,8)")).withColumn("total_cost", (F.col("gross") + extra).cast("decimal(20,8)"))
    out = out.withColumn("net", (F.col("sets") - F.col("total_cost")).cast("decimal(20,8)")).where("net > 0")
    each = safe_div(F.col("total_cost"), F.col("sets").cast("decimal(18,4)"))
    return out.withColumns(
        {
            "gross_edge": usd(1 - safe_div(F.col("gross"), F.col("sets").cast("decimal(18,4)"))),
            "cost_per_set": usd(each),
            "profit_per_set": usd(1 - each),
            "max_net_profit": usd(F.col("net")),
            "capital_required": usd(F.col("total_cost")),
            "net_roi": usd(safe_div(F.col("net"), F.col("total_cost"))),
        }
    )


def complete_set(levels: DataFrame, terms: DataFrame, key: str, now: Column) -> DataFrame:
    """YES and NO of one market for less than 1 together, after all costs.

    ``terms`` has key, platform, fee_rate, fee_type, tick_size, resolves, accepting and age (seconds).
    """
    yes, no = books.asks(levels, "yes"), books.asks(levels, "no")
    sets = books.matched_walk(yes, no, [key], F.lit(MOST_SETS))
    rows = sets.join(terms, key)
    quotes = []
    for name, ladder in (("yes", yes), ("no", no)):
        walked = books.walk(ladder.join(sets.select(key, "sets"), key), [key], F.col("sets"), ["sets"])
        quotes.append(walked.select(key, F.col("average").alias(f"{name}_average")))
    rows = rows.join(quotes[0], key).join(quotes[1], key)
    leg = lambda side: (F.col("platform"), F.col(f"{side}_average"), F.col("fee_rate"), F.col("fee_type"), F.col("tick_size"))
    both = F.col("yes_average") + F.col("no_average")
    out = _result(rows, F.col("cost"), _settled_costs(F.col("sets"), [leg("yes"), leg("no")], both, F.col("resolves"), now))
    return out.withColumn("label", label(F.lit("EXECUTABLE"), F.col("age"), F.col("total_cost"), F.col("accepting")))


def cross_platform(levels: DataFrame, pairs: DataFrame, terms: DataFrame, now: Column) -> DataFrame:
    """YES on one venue and NO on the other, in the better of both orientations.

    ``levels`` has book_id; ``pairs`` has pair_id, a, b, verdict and inverted; rejected pairs are left
    out.  ``terms`` has book_id and the columns of :func:`complete_set`.
    """
    oriented = pairs.where("verdict <> 'REJECTED'").withColumn("side_a", F.explode(F.array(F.lit("yes"), F.lit("no"))))
    other = F.when(F.col("side_a") == "yes", "no").otherwise("yes")
    oriented = oriented.withColumn("side_b", F.when(F.col("inverted"), F.col("side_a")).otherwise(other))
    rows = books.asks(levels)
    keys = ["pair_id", "side_a"]
    ladder = lambda x: oriented.select("pair_id", "side_a", F.col(x).alias("book_id"), F.col(f"side_{x}").alias("side")).join(rows, ["book_id", "side"]).select(*keys, "price", "size")
    left, right = ladder("a"), ladder("b")
    sets = books.matched_walk(left, right, keys, F.lit(MOST_SETS))
    out = sets.join(oriented, keys)
    for name, ladder_ in (("a", left), ("b", right)):
        walked = books.walk(ladder_.join(sets.select(*keys, "sets"), keys), keys, F.col("sets"), ["sets"])
        depth = ladder_.groupBy(*keys).agg(F.sum(F.col("price") * F.col("size")).alias(f"depth_{name}"))
        t = terms.select(*(F.col(c).alias(f"{c}_{name}") for c in terms.columns))
        out = out.join(walked.select(*keys, F.col("average").alias(f"average_{name}"), usd(F.col("notional")).alias(f"notional_{name}")), keys).join(depth, keys).join(t, out[name] == t[f"book_id_{name}"])
    leg = lambda x: (F.col(f"platform_{x}"), F.col(f"average_{x}"), F.col(f"fee_rate_{x}"), F.col(f"fee_type_{x}"), F.col(f"tick_size_{x}"))
    later = F.greatest("resolves_a", "resolves_b")
    extra = _settled_costs(F.col("sets"), [leg("a"), leg("b")], F.col("average_a") + F.col("average_b"), later, now) + (F.lit(EXECUTION_RISK).cast(PRICE) * F.col("sets")).cast("decimal(20,8)")
    out = _result(out, usd(F.col("notional_a") + F.col("notional_b")), extra)
    needed = F.when(F.least("depth_a", "depth_b") >= LIQUID_DEPTH, F.lit(MIN_EDGE_LIQUID)).otherwise(F.lit(MIN_EDGE_THIN)).cast(PRICE)
    out = out.where(safe_div(F.col("net"), F.col("total_cost")) >= needed)
    base = F.lit(None).cast("string")
    for verdict, name in VERDICT_LABELS.items():
        base = F.when(F.col("verdict") == verdict, name).otherwise(base)
    found = label(base, F.greatest("age_a", "age_b"), F.col("total_cost"), F.col("accepting_a") & F.col("accepting_b"))
    apart = F.abs(F.unix_seconds("resolves_a") - F.unix_seconds("resolves_b")) > 86400
    out = out.withColumn("label", F.when(apart & (found == "EXECUTABLE"), "EXECUTION_RISK").otherwise(found))
    best = Window.partitionBy("pair_id").orderBy(F.desc("profit_per_set"), F.desc("side_a"))
    return out.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def _total_average(ladders: Column, size: Column) -> Column:
    """Sum of the legs' average prices at a size; null if a leg cannot fill it."""
    each = F.transform(ladders, lambda l: F.element_at(F.transform(F.array(books.filled_at(l, size)), lambda f: F.when(f["filled"] >= size, usd(safe_div(f["notional"], f["filled"])).cast("decimal(10,4)"))), 1))
    return F.when(F.exists(each, lambda x: x.isNull()), F.lit(None)).otherwise(F.aggregate(each, F.lit(0).cast("decimal(12,4)"), lambda s, x: (s + x).cast("decimal(12,4)")))


def matched_size(ladders: Column, capacity: Column, steps: int = 24) -> Column:
    """The largest equal size at which the legs' averages sum to less than 1, by bisection; two places, half even."""
    high = F.least(capacity, F.lit(MOST_SETS)).cast("decimal(18,6)")
    cheap = lambda size: F.coalesce(_total_average(ladders, size) < 1, F.lit(False))
    start = F.struct(F.lit(0).cast("decimal(18,6)").alias("lo"), high.alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("decimal(18,6)")
        return F.element_at(F.transform(F.array(F.struct(mid.alias("mid"), cheap(mid).alias("ok"))), lambda m: F.struct(F.when(m["ok"], m["mid"]).otherwise(s["lo"]).alias("lo"), F.when(m["ok"], s["hi"]).otherwise(m["mid"]).alias("hi"))), 1)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lo"]
    return F.when(cheap(high), high.cast("decimal(18,2)")).otherwise(F.bround(end, 2).cast("decimal(18,2)"))


def multi_outcome(levels: DataFrame, legs: DataFrame, events: DataFrame) -> DataFrame:
    """YES on every outcome of an event for less than 1 together.

    ``legs`` has event_id, book_id, platform, fee_rate, fee_type, tick_size and age; ``events`` has
    event_id, outcome_count, mutually_exclusive, exhaustive and negative_risk.  An event with a leg that
    is missing or cannot be bought is left out.  Events whose best prices sum to 1 or more are left out
    before the bisection.  A ladder has at most 97 levels and an event one row for each outcome.
    """
    yes = books.asks(levels, "yes").join(legs, "book_id")
    ladder = F.transform(F.array_sort(F.collect_list(F.struct("price", "size"))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
    sides = yes.groupBy("event_id", "book_id", "platform", "fee_rate", "fee_type", "tick_size", "age").agg(ladder.alias("ladder"), F.min("price").alias("top"), F.sum("size").alias("capacity"))
    leg = F.struct("book_id", "platform", "fee_rate", "fee_type", "tick_size", "ladder")
    rows = sides.groupBy("event_id").agg(F.count("*").alias("n_legs"), F.sum("top").alias("tops"), F.min("capacity").alias("capacity"), F.max("age").alias("age"), F.array_sort(F.collect_list(leg)).alias("legs"))
    rows = rows.join(events, "event_id").where((F.col("n_legs") >= 2) & (F.col("n_legs") >= F.coalesce("outcome_count", F.lit(0))) & (F.col("tops") < 1))
    # A generator, so that the filter on the size does not run the bisection once more.
    rows = rows.withColumn("sets", F.explode(F.array(matched_size(F.transform("legs", lambda l: l["ladder"]), F.col("capacity"))))).where("sets > 0")
    each = rows.select("event_id", "n_legs", "age", "mutually_exclusive", "exhaustive", "negative_risk", "sets", F.explode("legs").alias("l"))
    each = each.withColumn("f", books.filled_at(F.col("l.ladder"), F.col("sets").cast("decimal(18,6)"))).withColumn("average", usd(F.col("f.notional") / F.col("f.filled")).cast(PRICE))
    costs = _settled_costs(F.col("sets"), [(F.col("l.platform"), F.col("average"), F.col("l.fee_rate"), F.col("l.fee_type"), F.col("l.tick_size"))], F.col("average"), None, F.lit(None))
    whole = F.col("f.filled") >= F.col("sets")
    rows = each.groupBy("event_id", "n_legs", "age", "mutually_exclusive", "exhaustive", "negative_risk", "sets").agg(F.sum(F.col("average") * F.col("sets")).cast("decimal(20,8)").alias("spent"), F.sum(costs).cast("decimal(20,8)").alias("costs"), F.min(whole.cast("int")).alias("whole"))
    out = _result(rows.where("whole = 1"), F.col("spent"), F.col("costs"))
    base = F.when(F.col("negative_risk") | (F.col("mutually_exclusive") & F.col("exhaustive")), "EXECUTABLE").otherwise("NOT_GUARANTEED")
    return out.withColumn("label", label(base, F.col("age"), F.col("total_cost")))


def strike_families(markets: DataFrame) -> DataFrame:
    """Markets with a strike of the "greater" kind whose event has two of them: event_id, book_id, strike."""
    rows = markets.where(F.col("strike_type").startswith("greater")).withColumn("strike", F.coalesce("floor_strike", "cap_strike")).where("strike IS NOT NULL")
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy("event_id"))).where("__n >= 2").drop("__n")


def monotonicity(tops: DataFrame, least: str = MIN_VIOLATION) -> DataFrame:
    """Neighbouring strikes of a family where the higher one costs more than the lower by over ``least``.

    ``tops`` has event_id, book_id, strike and yes_ask.  Returns weaker, stronger and gap.
    """
    w = Window.partitionBy("event_id").orderBy("strike", "book_id")
    rows = tops.withColumn("weaker", F.lag("book_id").over(w)).withColumn("weaker_ask", F.lag("yes_ask").over(w)).withColumn("weaker_strike", F.lag("strike").over(w))
    gap = F.col("yes_ask") - F.col("weaker_ask")
    return rows.withColumn("gap", gap).where(gap > F.lit(least).cast(PRICE)).select("event_id", "weaker", F.col("book_id").alias("stronger"), "weaker_strike", F.col("strike").alias("stronger_strike"), "gap")


def exhaustive_sum(tops: DataFrame, tolerance: str = SUM_TOLERANCE) -> DataFrame:
    """Events with two priced outcomes or more whose prices sum to something other than 1."""
    g = tops.where("yes_ask IS NOT NULL").groupBy("event_id").agg(F.count("*").alias("n_legs"), F.sum("yes_ask").alias("total"))
    return g.withColumn("deviation", F.col("total") - 1).where((F.col("n_legs") >= 2) & (F.abs("deviation") > F.lit(tolerance).cast(PRICE)))


def stale_quotes(moves: DataFrame, pairs: DataFrame, least: str = MIN_DIVERGENCE) -> DataFrame:
    """A market that moved while its match did not follow by half, with prices apart: leader, laggard, side.

    ``moves`` has market_id, mid and previous (may be null); ``pairs`` has a and b.  Both directions of a
    pair are looked at.
    """
    from .latest import either_endpoint

    both = either_endpoint(pairs.select("a", "b"), "a", "b")
    side = lambda name: moves.select(F.col("market_id").alias(name), F.col("mid").alias(f"{name}_mid"), (F.col("mid") - F.col("previous")).alias(f"{name}_move"))
    rows = both.withColumnsRenamed({"node": "leader", "other": "laggard"}).join(side("leader"), "leader").join(side("laggard"), "laggard")
    apart = F.col("leader_mid") - F.col("laggard_mid")
    bar = F.lit(least).cast("decimal(10,6)")
    moved = (F.abs("leader_move") >= bar) & (F.col("laggard_move").isNull() | (F.abs("laggard_move") < F.abs("leader_move") / 2))
    return rows.where(moved & (F.abs(apart) >= bar)).withColumn("divergence", apart).withColumn("side", F.when(apart > 0, "yes").otherwise("no"))


def described(column: Column) -> Column:
    """A label's class and permissions, as a struct."""
    out = F.lit(None)
    for name, (kind, actionable, arbitrage) in TAXONOMY.items():
        out = F.when(column == name, F.struct(F.lit(kind).alias("kind"), F.lit(actionable).alias("actionable"), F.lit(arbitrage).alias("may_be_called_arbitrage"))).otherwise(out)
    return out
