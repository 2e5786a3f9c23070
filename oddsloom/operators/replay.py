"""Markets of the past: rewound records, samples of settled ones, and what was known at entry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a record knew from its beginning on; all else is cleared.
KEPT = ("market_id", "event_id", "platform", "title", "category", "rules", "opens", "closes", "resolves", "strike", "tick_size", "fee_rate", "provenance")
#: What tells how a market ended; never in a rewound record.
REVEALING = ("result", "settled_at")
#: Payouts that can be scored.
PAYOUTS = (0.0, 0.5, 1.0)


def rewound(markets: DataFrame, as_of: Column) -> DataFrame:
    """Records as they were at ``as_of``: kept columns, status open, and the names of what was cleared.

    ``refused`` says why a market cannot be asked about then: before_open, after_close, or null.
    """
    rest = [c for c in markets.columns if c not in KEPT and c != "status"]
    close = F.coalesce("closes", "resolves")
    refused = F.when(as_of < F.col("opens"), "before_open").when(as_of >= close, "after_close")
    cleared = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in sorted(rest)))) if rest else F.array().cast("array<string>")
    kept = [c for c in markets.columns if c in KEPT and c not in REVEALING]
    return markets.select(*kept, as_of.alias("as_of"), F.lit("open").alias("status"), cleared.alias("cleared"), refused.alias("refused"))


def outcome_value(payout: Column) -> Column:
    """A payout that can be scored: 0, a half or 1; null for any other."""
    return F.when(payout.isin(*PAYOUTS), payout)


def settled_sample(markets: DataFrame, categories: Sequence[str], now: Column, days: int = 60, least_volume: float = 1000, n: int = 200) -> DataFrame:
    """The newest ``n`` settled markets: live and undisputed, of the categories, with volume, a known end and a payout that can be scored."""
    ok = (F.col("provenance") == "live") & ~F.coalesce("disputed", F.lit(False)) & F.col("category").isin(*categories)
    recent = (F.col("settled_at") >= F.timestamp_add("DAY", F.lit(-days), now)) & (F.col("settled_at") <= now)
    rows = markets.withColumn("outcome", outcome_value(F.col("payout")))
    return rows.where(ok & recent & F.col("outcome").isNotNull() & (F.coalesce("volume", F.lit(0)) >= least_volume) & F.coalesce("resolves", "closes").isNotNull()).orderBy(F.desc("settled_at"), "market_id").limit(n)


def entry_probability(evidence: Column, side: Column, entry: Column) -> Column:
    """The market's probability of a side at entry, from frozen evidence (JSON with implied_yes), else the entry price."""
    yes = F.get_json_object(evidence, "$.implied_yes").try_cast("double")
    return F.coalesce(F.when(side == "yes", yes).otherwise(1 - yes), entry)


def no_side_probability(report: Column) -> Column:
    """The decision probability of the NO side from a stored report; never one less the other side's."""
    return F.get_json_object(report, "$.conservative_decision_probability_no").try_cast("double")


def changed_immutable(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows whose frozen fields were changed after publication: key and the names of the fields."""
    both = before.select(key, F.struct(*fields).alias("__b")).join(after.select(key, F.struct(*fields).alias("__a")), key)
    names = F.array_compact(F.array(*(F.when(~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), F.lit(f)) for f in fields)))
    return both.select(key, names.alias("changed")).where(F.size("changed") > 0)


def missing_economics(required: Sequence[str]) -> Column:
    """The names of required columns that are null."""
    return F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))
