"""Polled sources, keyed tables and keyed state: restarts, retries, late rows and failures."""

import datetime
import hashlib
import json
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import latest
from oddsloom.sources import polled
from oddsloom.sources.keyed import ConcurrentMerge, KeyedTable
from oddsloom.streaming import state


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def page(root, venue, cursor, items, then):
    write(root / f"venue={venue}" / f"cursor={quote(cursor or polled.FIRST, safe='')}" / "part", {"items": [{"id": i} for i in items], "next": then})


def ids(rows):
    return sorted((r.venue, json.loads(r.raw)["id"]) for r in rows)


# ------------------------------------------------------------------------------------------ pages


def test_pages_by_cursor(spark, tmp_path):
    page(tmp_path, "k", "", [1, 2], "a/b")
    page(tmp_path, "k", "a/b", [3], "c")
    page(tmp_path, "k", "c", [4], "c")  # echoes its own cursor
    page(tmp_path, "p", "", [7], "")
    page(tmp_path, "p", "never", [9], "")
    write(tmp_path / "venue=q" / f"cursor={polled.FIRST}", "{no json")
    polled.register(spark)
    got = spark.read.format("venue_pages").option("path", f"file://{tmp_path}").load().collect()
    assert ids(got) == [("k", 1), ("k", 2), ("k", 3), ("k", 4), ("p", 7)]
    assert [(r.page, r.i) for r in sorted(got, key=lambda r: json.loads(r.raw)["id"])] == [(0, 0), (0, 1), (1, 0), (2, 0), (0, 0)]
    with pytest.raises(Exception, match="more than 2 pages"):
        spark.read.format("venue_pages").option("path", str(tmp_path)).option("max_pages", 2).load().collect()


def test_a_stream_of_pages_gives_each_item_once(spark, tmp_path):
    polled.register(spark)
    root, out, check = tmp_path / "venues", str(tmp_path / "out"), str(tmp_path / "check")

    def poll(batch=1):
        query = spark.readStream.format("venue_pages").option("path", str(root)).option("pages_per_batch", batch).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        query.processAllAvailable()
        query.stop()
        return ids(spark.read.schema(polled.ITEM).parquet(out).collect())

    page(root, "k", "", [1, 2], "a")
    page(root, "k", "a", [3], "b")
    page(root, "k", "b", [4], "c")
    page(root, "p", "", [7], "x")
    assert poll() == [("k", 1), ("k", 2), ("k", 3), ("k", 4), ("p", 7)]
    # A restart with nothing new, then pages that came between two runs, and a venue that is new.
    assert len(poll()) == 5
    page(root, "k", "c", [5], "")
    page(root, "p", "x", [8], "")
    page(root, "z", "", [0], "")
    assert poll() == [("k", 1), ("k", 2), ("k", 3), ("k", 4), ("k", 5), ("p", 7), ("p", 8), ("z", 0)]
    assert len(poll(100)) == 8


def test_books_in_batches_and_one_by_one(spark, tmp_path):
    tickers = [f"T{i:02d}" for i in range(45)]
    book = lambda t: {"ticker": t, "orderbook_fp": {"yes_dollars": [["0.40", "10"]], "no_dollars": []}}
    for t in tickers[:-1]:
        write(tmp_path / "orderbook" / t, {"orderbook_fp": {"yes_dollars": [["0.41", "1"]], "no_dollars": []}})
    first, second = tickers[:20], tickers[20:40]
    write(tmp_path / "orderbooks" / quote(",".join(first), safe=""), {"orderbooks": [book(t) for t in first]})
    write(tmp_path / "orderbooks" / quote(",".join(second), safe=""), {"orderbooks": [book(",".join(second))]})  # one empty book under the joined name
    polled.register(spark)
    got = spark.read.format("venue_books").option("path", str(tmp_path)).option("tickers", json.dumps(tickers)).load().collect()
    assert {r.ticker: r.asked for r in got} == {**dict.fromkeys(first, "batch"), **dict.fromkeys(tickers[20:44], "single")}
    assert all(json.loads(r.raw)["ticker"] == r.ticker for r in got)


# ------------------------------------------------------------------------------------- keyed table


SCHEMA = "k long, at long, v string, created long, volume long"


def keyed(spark, path, **how):
    return KeyedTable(spark, str(path), ["k"], ["at", "v"], buckets=8, first=["created"], known=["volume", "v"], **how)


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def test_a_keyed_table_merges_what_it_touches(spark, tmp_path):
    table = keyed(spark, tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.merge(spark.createDataFrame([(i, 1, f"a{i}", 1, 5) for i in range(40)], SCHEMA)) == 1
    before = table.manifest()
    assert table.merge(spark.createDataFrame([(3, 2, "b", 2, 0), (3, 0, "late", 0, 9), (99, 1, "new", 7, None)], SCHEMA)) == 2
    after = table.manifest()
    moved = {b for b in after["buckets"] if after["buckets"][b] != before["buckets"].get(b)}
    assert 1 <= len(moved) <= 2  # the buckets of two keys
    got = {r[0]: r for r in rows(table)}
    # The newest row counts, a zero erases nothing, and what was created first stays.
    assert got[3] == (3, 2, "b", 1, 5) and got[99] == (99, 1, "new", 7, None) and len(got) == 41
    assert rows(table, 1) == sorted((i, 1, f"a{i}", 1, 5) for i in range(40))
    table.vacuum(keep=1)
    assert table.manifest()["version"] == 2 and len(rows(table)) == 41 and table._folder.names("manifests") == ["000000000002.json"]


def test_a_failed_merge_leaves_the_old_version(spark, tmp_path):
    table = keyed(spark, tmp_path / "t")
    table.merge(spark.createDataFrame([(1, 1, "a", 1, 1)], SCHEMA))
    bad = spark.createDataFrame([(2, 1, "x", 1, 1), (3, 1, "boom", 1, 1)], SCHEMA).withColumn("v", F.when(F.col("v") == "boom", F.raise_error(F.lit("boom"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="boom"):
        table.merge(bad)
    assert rows(table) == [(1, 1, "a", 1, 1)] and table.manifest()["version"] == 1
    with pytest.raises(ValueError, match="null"):
        table.merge(spark.createDataFrame([(None, 1, "a", 1, 1)], SCHEMA))
    # Another writer was first.
    real, table.manifest = table.manifest, lambda version=None: real(1)
    real_table = keyed(spark, tmp_path / "t")
    real_table.merge(spark.createDataFrame([(5, 1, "c", 1, 1)], SCHEMA))
    with pytest.raises(ConcurrentMerge):
        table.merge(spark.createDataFrame([(6, 1, "d", 1, 1)], SCHEMA))
    assert [r[0] for r in rows(real_table)] == [1, 5]


def test_empty_batches_and_batches_that_come_again(spark, tmp_path):
    table = keyed(spark, tmp_path / "t")
    assert table.merge(spark.createDataFrame([], SCHEMA), "s", 0) == 1 and rows(table) == []
    batch = spark.createDataFrame([(1, 1, "a", 1, 1)], SCHEMA)
    sink = table.sink("s")
    sink(batch, 1)
    sink(batch.withColumn("v", F.lit("zz")), 1)  # the same batch again: it is there already
    assert rows(table) == [(1, 1, "a", 1, 1)]
    sink(batch.withColumn("at", F.lit(5).cast("long")), 2)
    assert rows(table) == [(1, 5, "a", 1, 1)]


# ------------------------------------------------------------------------------------- keyed state


BOOK = "market_id long, observed_at timestamp, seq long, body string"


@pytest.fixture
def rocks(spark):
    for k, v in state.ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k in state.ROCKSDB:
        spark.conf.unset(k)


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def arrive(spark, path, name, batch):
    spark.createDataFrame(batch, BOOK).coalesce(1).write.parquet(str(path / name))


def run(spark, tmp_path, source, table, **how):
    """One run of the query over what has arrived, its changes merged into a keyed table."""
    books = spark.readStream.schema(BOOK).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    query = state.latest_books(books, lateness="10 minutes", **how).writeStream.outputMode("update").foreachBatch(table.sink("books")).option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()


def test_a_stream_of_books_is_the_latest_of_its_rows(spark, rocks, tmp_path):
    source, table = tmp_path / "in", KeyedTable(spark, str(tmp_path / "t"), ["market_id"], ["observed_at", "seq", "expired"], buckets=4)
    first = [(1, at(0), 1, "a"), (1, at(5), 2, "b"), (2, at(3), 3, "c"), (2, at(3), 4, "d")]
    late = [(1, at(2), 5, "late"), (3, at(4), 6, "e"), (2, at(3), 4, "again"), (4, None, 7, "no time")]
    more = [(1, at(9), 8, "f"), (2, at(1), 9, "older")]
    arrive(spark, source, "1", first)
    arrive(spark, source, "2", late)
    run(spark, tmp_path, source, table)
    arrive(spark, source, "3", more)
    run(spark, tmp_path, source, table)  # a restart: what was held is held still
    everything = spark.createDataFrame([r for r in first + late + more if r[1] is not None], BOOK)
    want = sorted((r.market_id, r.observed_at, r.seq) for r in latest.latest(everything, ["market_id"], ["observed_at", "seq"]).collect())
    assert sorted((r.market_id, r.observed_at, r.seq) for r in table.read().collect()) == want
    batch = state.latest_books(everything)
    assert sorted((r.market_id, r.observed_at, r.seq) for r in batch.collect()) == want and batch.columns[-1] == "expired"
    run(spark, tmp_path, source, table)  # nothing new
    assert {r.body for r in table.read().collect()} == {"f", "d", "e"}


def test_books_expire_by_the_watermark(spark, rocks, tmp_path):
    source, table = tmp_path / "in", KeyedTable(spark, str(tmp_path / "t"), ["market_id"], ["observed_at", "seq", "expired"], buckets=4)
    arrive(spark, source, "1", [(1, at(0), 1, "a"), (2, at(0), 1, "b")])
    arrive(spark, source, "2", [(2, at(100), 2, "c")])
    arrive(spark, source, "3", [(2, at(101), 3, "d")])
    run(spark, tmp_path, source, table, expiry=1800.0)
    got = {r.market_id: (r.body, r.expired) for r in table.read().collect()}
    assert got == {1: ("a", True), 2: ("d", False)}


def test_versions_of_rules_on_a_stream(spark, rocks, tmp_path):
    source = tmp_path / "in"
    arrive(spark, source, "1", [(1, at(0), 0, "x"), (1, at(1), 0, "x"), (1, at(2), 0, "y"), (2, at(0), 0, None)])
    arrive(spark, source, "2", [(1, at(1), 0, "old"), (1, at(3), 0, "y"), (1, at(4), 0, "x")])
    rules = spark.readStream.schema(BOOK).option("maxFilesPerTrigger", 1).parquet(str(source / "*")).select("market_id", "observed_at", "body")
    query = state.rule_changes_of(rules, "market_id", "observed_at", "body").writeStream.format("memory").queryName("rule_changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((r.market_id, r.version, r.digest) for r in spark.table("rule_changes").collect()) == [(1, 1, sha("x")), (1, 2, sha("y")), (1, 3, sha("x")), (2, 1, sha(""))]
