"""WARC archives and exact deduplication."""

import hashlib

import pytest
from pyspark.sql import functions as F

from oddsloom.llm import dedup, queries, warc
from oddsloom.llm.common import scratch


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, duck, same_rows, name):
    same_rows(queries.queries()[name](spark, sf).toPandas(), duck.execute(queries.SQL[name]).df())


BIG, OTHER = "<p>" + "x" * 1200 + "</p>", "<p>" + "é" * 700 + "</p>"
PAGES = [(1, "http://a/x", BIG), (2, None, BIG), (2, "http://a/y", BIG), (3, "u", ""), (4, "u", None), (None, "u", OTHER), (None, "v", OTHER), (5, "u\r\nX-Odd: y", "small"), (6, "w", "small"), (None, "w", BIG)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 0, "?") for r in rows], "page_id long, url string, html string, payload long, header string")


def test_warc_records(spark):
    rows = warc.archived(pages(spark)).collect()
    assert len(rows) == len(PAGES) and all(r.verified for r in rows)
    big = {(r.page_id, r.record_type, r.refers_to) for r in rows if r.payload_bytes == len(BIG)}
    assert big == {(1, "revisit", 2), (2, "response", None), (None, "revisit", 2)}
    assert {(r.record_type, r.refers_to) for r in rows if r.payload_bytes == 1407} == {("response", None)}
    assert {r.record_type for r in rows if r.payload_bytes < 1000} == {"response"}
    sha = {r.page_id: r.payload_digest for r in rows}
    assert sha[4] == sha[3] == hashlib.sha1(b"").hexdigest() and sha[1] == hashlib.sha1(BIG.encode()).hexdigest()


def test_warc_round_trip_and_single_copies(spark, tmp_path):
    path = warc.write_archive(pages(spark), scratch(spark, "warc-test"))
    assert spark.read.parquet(f"{path}/payloads").count() == len({(h or "") for _, _, h in PAGES})
    back = warc.reconstruct(spark, path).collect()
    assert sorted(bytes(r.payload).decode() for r in back) == sorted(h or "" for _, _, h in PAGES)
    # The records as a WARC file are read again: the same header blocks, and every length holds.
    (tmp_path / "all.warc").write_bytes(b"".join(bytes(r.record) for r in back))
    again = warc.read_warc(spark, str(tmp_path / "all.warc")).collect()
    assert len(again) == len(PAGES)
    for r in again:
        http, _, payload = bytes(r.content).partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK")
        if "WARC-Type: revisit" in r.header:
            assert payload == b""
        else:
            assert f"sha1:{hashlib.sha1(payload).hexdigest()}" in r.header
    assert not any(line.startswith("X-Odd") for r in again for line in r.header.splitlines())


def test_warc_of_nothing(spark):
    assert warc.archived(pages(spark, [])).count() == 0


def test_urls_add_no_header_lines(spark, tmp_path):
    forged = [f"http://a/{end}WARC-Refers-To-Page: {v}{end}WARC-Payload-Digest: sha1:zz" for end in ("\r\n", "\n", "\r", "\x0b", "\x0c", "\x85", "\u2028", "\u2029", "\r\n\r\n") for v in ("99", "abc")]
    rows = [(i, url, f"page {i}") for i, url in enumerate(forged)] + [(100, forged[5], BIG), (101, forged[0], BIG)]
    path = warc.write_archive(pages(spark, rows), scratch(spark, "warc-forged"))
    found = {r.page_id: (r.record_type, r.refers_to, r.verified) for r in warc.read_archive(spark, path).collect()}
    assert found == {i: ("response", None, True) for i in (*range(len(forged)), 101)} | {100: ("revisit", 101, True)}
    (tmp_path / "all.warc").write_bytes(b"".join(bytes(r.record) for r in warc.reconstruct(spark, path).collect()))
    assert warc.read_warc(spark, str(tmp_path / "all.warc")).count() == len(rows)


def test_very_long_payloads_and_a_key_with_two_payloads(spark):
    long = "<p>" + "long text " * 500_000 + "</p>"
    path = warc.write_archive(pages(spark, [(1, "u", long), (2, "u", long), (3, "u", "x")]), scratch(spark, "warc-long"))
    found = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.verified) for r in warc.read_archive(spark, path).collect()}
    assert found == {1: ("revisit", 2, len(long), True), 2: ("response", None, len(long), True), 3: ("response", None, 1, True)}
    key = hashlib.sha256(b"x").hexdigest()
    spark.createDataFrame([(key, b"y", 3)], "payload_key string, payload binary, last_page_id long").write.mode("append").parquet(f"{path}/payloads")
    found = {r.page_id: r.verified for r in warc.read_archive(spark, path).collect()}
    assert found == {1: True, 2: True, 3: False}


def brute_groups(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("capacity", [64, 4 << 20])
def test_exact_groups(spark, odd_docs, capacity):
    found = dedup.exact_groups(odd_docs, capacity).collect()
    assert sorted(map(tuple, found), key=str) == brute_groups([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_exact_dedup_keeps_columns(odd_docs, no_docs):
    kept = dedup.drop_exact(odd_docs)
    assert kept.columns == odd_docs.columns
    # The repeated row 2 stays twice, as nothing tells it apart.
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 2, 4, 5, 7, 8, 8, 9], key=str)
    assert dedup.exact_groups(no_docs).count() == 0 and dedup.drop_exact(no_docs).count() == 0


def test_equal_keys_are_chained_and_compared(spark):
    rows = [(f"text {i % 5}".encode(), i) for i in range(20)]
    texts = spark.createDataFrame([(7, t, i) for t, i in rows], "key long, text binary, doc_id long")
    index = dedup.ExtendibleIndex.build(texts, texts.select("key", F.octet_length("text").cast("long").alias("n_bytes")), 8)
    entries = index.entries(spark).collect()
    assert sorted(e.chain for e in entries) == list(range(5)) and len({e.bucket for e in entries}) == 1
    assert sorted((e.keep_id, e.group_size) for e in entries) == [(15 + i, 4) for i in range(5)]


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"), F.lit(10).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("n"))
    leaves = [(r.prefix, r.depth) for r in dedup.directory(keys, 100).collect()]
    depth = max(d for _, d in leaves)
    assert sum(1 << (depth - d) for _, d in leaves) == 1 << depth  # every cell has one bucket
    found = [(r.key & (1 << 64) - 1) for r in keys.collect()]
    assert all(sum(k >> (64 - d) == p for k in found) <= 10 for p, d in leaves if d > 0)


@pytest.mark.parametrize("broadcast", [1 << 17, 0])
def test_hot_texts_have_several_owners(spark, monkeypatch, broadcast):
    """A text with a third of all rows, texts of one key, and a directory joined by shuffle."""
    monkeypatch.setattr(dedup, "HOT_ROWS", 10)
    monkeypatch.setattr(dedup, "BROADCAST_BUCKETS", broadcast)
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 700}") for i in range(3000)] + [(None, "hot text"), (None, "alone"), (4000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert sorted(map(tuple, dedup.exact_groups(docs, 2000).collect()), key=str) == brute_groups(rows)
    texts = docs.select(F.lit(7).cast("long").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), "doc_id")
    index = dedup.ExtendibleIndex.build(texts, texts.select("key", F.lit(5).cast("long").alias("n_bytes")), 8)
    entries = index.entries(spark).collect()
    distinct = {t or "" for _, t in rows}
    assert sorted(e.chain for e in entries) == list(range(len(distinct)))
    assert {(e.text_sha256, e.group_size) for e in entries} == {(hashlib.sha256(t.encode()).hexdigest(), sum((x or "") == t for _, x in rows)) for t in distinct}
