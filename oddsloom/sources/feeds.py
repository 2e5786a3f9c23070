"""Events of venues, batches of books, and the feeds that models read: candles, charts, forecasts, games.

As in :mod:`.venues`, a payload is JSON text in a column, one response a row; text that is not valid
gives no rows or nulls, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..functions.timeops import parse_moment
from .venues import category, kalshi_book

KALSHI_EVENT = "event_ticker string, series_ticker string, title string, sub_title string, category string, strike_date string, mutually_exclusive boolean, markets array<struct<ticker:string>>"
POLYMARKET_EVENT = "id string, title string, endDate string, negRisk boolean, negRiskAugmented boolean, tags array<struct<slug:string>>, markets array<struct<id:string>>"
TEAM = "struct<homeAway:string,score:string,winner:boolean,team:struct<abbreviation:string>>"
GAMES = f"events array<struct<id:string,date:string,status:struct<type:struct<name:string>>,competitions:array<struct<competitors:array<{TEAM}>>>>>"


def kalshi_events(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """Events of pages with ``events``: exclusive where the venue says so, never known to be exhaustive."""
    e = payloads.select(F.explode(F.from_json(raw, f"events array<struct<{_inner(KALSHI_EVENT)}>>")["events"]).alias("e")).select("e.*").where(F.coalesce(F.col("event_ticker"), F.lit("")) != "")
    title = F.coalesce(F.nullif("title", F.lit("")), "sub_title", F.lit(""))
    return e.select(
        F.lit("kalshi").alias("platform"),
        F.col("event_ticker").alias("event_id"),
        F.coalesce(F.nullif("series_ticker", F.lit("")), F.split_part("event_ticker", F.lit("-"), F.lit(1))).alias("series_ticker"),
        title.alias("title"),
        normalize_title(title).alias("normalized_title"),
        category(F.col("category")).alias("category"),
        parse_moment(F.col("strike_date")).alias("close_time"),
        F.coalesce("mutually_exclusive", F.lit(False)).alias("mutually_exclusive"),
        F.lit(False).alias("exhaustive"),
        F.lit(False).alias("negative_risk"),
        F.size(F.coalesce("markets", F.array())).alias("outcome_count"),
    )


def polymarket_events(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """Events of pages that are arrays: with negative risk exactly one outcome pays, so they are exclusive and exhaustive."""
    e = payloads.select(F.explode(F.from_json(raw, f"array<struct<{_inner(POLYMARKET_EVENT)}>>")).alias("e")).select("e.*").where(F.coalesce(F.col("id"), F.lit("")) != "")
    risk = F.coalesce("negRisk", F.lit(False)) | F.coalesce("negRiskAugmented", F.lit(False))
    title = F.coalesce("title", F.lit(""))
    tags = F.array_join(F.transform(F.coalesce("tags", F.array()), lambda t: t["slug"]), " ")
    return e.select(
        F.lit("polymarket").alias("platform"),
        F.col("id").alias("event_id"),
        F.lit(None).cast("string").alias("series_ticker"),
        title.alias("title"),
        normalize_title(title).alias("normalized_title"),
        category(F.concat_ws(" ", tags, title)).alias("category"),
        parse_moment(F.col("endDate")).alias("close_time"),
        risk.alias("mutually_exclusive"),
        risk.alias("exhaustive"),
        risk.alias("negative_risk"),
        F.size(F.coalesce("markets", F.array())).alias("outcome_count"),
    )


def _inner(fields: str) -> str:
    """Fields of a table's schema as those of a struct."""
    return ", ".join(part.strip().replace(" ", ":", 1) for part in _split(fields))


def _split(fields: str) -> list[str]:
    """Cut at the commas that are not within brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(fields[start:i])
            start = i + 1
    return [*out, fields[start:]]


def kalshi_batch_books(payloads: DataFrame, asked: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Levels of responses with several books, and the tickers that have to be asked for one by one.

    ``payloads`` has batch and the response; ``asked`` has batch and ticker.  A batch that lacks one of the
    books it was asked for is refused as a whole.
    """
    book = "struct<ticker:string,orderbook_fp:struct<yes_dollars:array<array<string>>,no_dollars:array<array<string>>>>"
    books = payloads.select("batch", F.explode(F.from_json(raw, f"orderbooks array<{book}>")["orderbooks"]).alias("b")).select("batch", F.col("b.ticker").alias("ticker"), F.to_json("b").alias("book"))
    partial = asked.join(books.select("batch", "ticker"), ["batch", "ticker"], "left_anti").select("batch").distinct()
    whole = books.join(partial, "batch", "left_anti")
    return kalshi_book(whole.select(F.col("book").alias("raw"))), asked.join(partial, "batch", "left_semi").select("ticker")


def discovered(markets: DataFrame, events: DataFrame, series: list[str], mode: str) -> DataFrame:
    """Markets of one way of discovery: active, modellable (of named series), with_events, or historical."""
    if mode == "active":
        return markets.where("status = 'open'")
    if mode == "modellable":
        return markets.where((F.col("status") == "open") & F.col("series_ticker").isin(*series))
    if mode == "with_events":
        return markets.join(events.select("event_id").distinct(), "event_id", "left_semi")
    if mode == "historical":
        return markets.where("status = 'settled'")
    raise ValueError(f"no way of discovery is named {mode}")


def coinbase_candles(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """product, at, low, high, open, close and volume; ``payloads`` has product and an array of arrays in any order."""
    rows = payloads.select("product", F.explode(F.from_json(raw, "array<array<double>>")).alias("c")).where(F.size("c") >= 6)
    return rows.select("product", F.timestamp_seconds(F.col("c")[0].cast("long")).alias("at"), *(F.col("c")[i].alias(name) for i, name in enumerate(("low", "high", "open", "close", "volume"), 1))).dropDuplicates(["product", "at"])


def yahoo_chart(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """symbol, at and close of a chart; closes that are missing are left out."""
    schema = "chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>"
    r = payloads.select(F.explode(F.from_json(raw, schema)["chart"]["result"]).alias("r"))
    bars = r.select(F.col("r.meta.symbol").alias("symbol"), F.explode(F.arrays_zip(F.col("r.timestamp").alias("t"), F.try_element_at("r.indicators.quote", F.lit(1))["close"].alias("close"))).alias("b"))
    return bars.select("symbol", F.timestamp_seconds("b.t").alias("at"), F.col("b.close").alias("close")).where("close IS NOT NULL")


def nws_forecasts(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """station, day, high: the forecast temperature of each daytime period, in degrees Fahrenheit."""
    schema = "properties struct<periods:array<struct<startTime:string,isDaytime:boolean,temperature:double,temperatureUnit:string>>>"
    p = payloads.select("station", F.explode(F.from_json(raw, schema)["properties"]["periods"]).alias("p")).where("p.isDaytime")
    degrees = F.when(F.col("p.temperatureUnit") == "C", F.col("p.temperature") * 9 / 5 + 32).otherwise(F.col("p.temperature"))
    return p.select("station", F.to_date(F.substring("p.startTime", 1, 10)).alias("day"), degrees.alias("high")).groupBy("station", "day").agg(F.max("high").alias("high"))


def espn_games(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """game_id, at, final, home, away, home_won (null until the game is final)."""
    g = payloads.select(F.explode(F.from_json(raw, GAMES)["events"]).alias("g"))
    teams = F.try_element_at("g.competitions", F.lit(1))["competitors"]
    side = lambda name: F.try_element_at(F.filter(teams, lambda t: t["homeAway"] == name), F.lit(1))
    final = F.coalesce(F.col("g.status.type.name") == "STATUS_FINAL", F.lit(False))
    return g.select(F.col("g.id").alias("game_id"), parse_moment(F.col("g.date")).alias("at"), final.alias("final"), side("home")["team"]["abbreviation"].alias("home"), side("away")["team"]["abbreviation"].alias("away"), F.when(final, side("home")["winner"]).alias("home_won")).dropDuplicates(["game_id"])


def team_records(games: DataFrame, before: Column) -> DataFrame:
    """team, wins and losses from final games strictly before a moment."""
    played = games.where(F.col("final") & (F.col("at") < before) & F.col("home_won").isNotNull())
    sides = played.select(F.col("home").alias("team"), F.col("home_won").alias("won")).unionByName(played.select(F.col("away").alias("team"), (~F.col("home_won")).alias("won")))
    return sides.groupBy("team").agg(F.count(F.when(F.col("won"), 1)).alias("wins"), F.count(F.when(~F.col("won"), 1)).alias("losses"))


def nearest_fixture(asked: DataFrame, games: DataFrame, hours: float = 6) -> DataFrame:
    """For each of ``asked`` (key, home, away, at), the game of these teams that is nearest, at most ``hours`` away; ties to the earlier."""
    g = games.select("home", "away", F.col("at").alias("game_at"), "game_id")
    far = F.abs(F.unix_micros("game_at") - F.unix_micros("at"))
    near = asked.join(g, ["home", "away"]).where(far <= int(hours * 3_600_000_000))
    return near.groupBy("key").agg(F.min_by("game_id", F.struct(far, F.col("game_at"), F.col("game_id"))).alias("game_id"))


def demo_history(spark: SparkSession, n_markets: int, n_days: int, seed: int = 7) -> DataFrame:
    """Synthetic price history, marked as a demo: a function of the seed, the market and the day alone."""
    rows = spark.range(n_markets * n_days).select(F.floor(F.col("id") / n_days).alias("market_id"), (F.col("id") % n_days).alias("day"))
    unit = lambda *parts: F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1_000_003)) / 1_000_003
    price = F.round(0.05 + 0.9 * unit(F.col("market_id")), 2)
    return rows.select("market_id", "day", F.round(F.least(F.greatest(price + (unit("market_id", "day") - 0.5) * 0.1, F.lit(0.01)), F.lit(0.99)), 2).alias("price"), F.lit("demo").alias("provenance"))


def purged(df: DataFrame, provenance: str = "demo") -> DataFrame:
    """Rows of other provenances; rows without one stay."""
    return df.where(~F.coalesce(F.col("provenance") == provenance, F.lit(False)))


def reachable(rows: DataFrame, key: str, references: list[DataFrame]) -> DataFrame:
    """Rows whose key one of ``references`` (a column each) names: the others can be deleted from a snapshot."""
    named = references[0].toDF(key)
    for other in references[1:]:
        named = named.unionByName(other.toDF(key))
    return rows.join(named.distinct(), key, "left_semi")
