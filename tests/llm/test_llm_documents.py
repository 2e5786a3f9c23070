"""Mixing, licences, page texts and the quality classifier."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.llm import html, licenses, mixing, quality

WORD = re.compile("[^ \t-\r]+")


def water_level(size, most=3.0):
    """Targets by handing out what is left over, round by round."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > most * size[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = most * size[s]
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("fan", [3, mixing.FAN])
def test_mix_of_documents(spark, sf, fan):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = {r.doc_id: (len(WORD.findall(r.text or "")), r.source) for r in docs.collect()}
    size = {}
    for n, source in given.values():
        size[source] = size.get(source, 0) + n
    target = water_level(size)
    rows = mixing.mix(docs, fan=fan).collect()
    assert sorted(r.doc_id for r in rows) == sorted(given)
    taken = dict.fromkeys(size, 0)
    for r in rows:
        n, source = given[r.doc_id]
        assert (r["size"], r.source, r.source_size) == (n, source, size[source]) and math.isclose(r.target, target[source], rel_tol=1e-9)
        assert r.taken == r.copies * n <= 3 * n
        assert r.copies in (math.floor(target[source] / size[source] + 1e-12), math.floor(target[source] / size[source] + 1e-12) + 1) or n == 0
        taken[source] += r.taken
    largest = {s: max(n for n, x in given.values() if x == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in size)
    again = mixing.mix(docs.repartition(7), fan=fan).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)


def test_mixing_is_fair(spark):
    """Over many sources that are mixed alone, a document is taken as often as its probability says."""
    n, each = 300, 12
    units = spark.range(n * each).select((F.col("id") % n).cast("string").alias("source"), F.col("id").alias("doc_id"), (F.floor(F.col("id") / n) % 4 + 1).alias("size"), F.lit(0).alias("dup"), F.lit(0.25).alias("p"), F.lit(each).cast("long").alias("n_units"))
    rows = mixing.pivotal_round(units, 1).toPandas()
    assert abs(rows["take"].mean() - 0.25) < 0.03
    assert all(abs(rows["take"][rows["size"] == k].mean() - 0.25) < 0.06 for k in range(1, 5))
    words = (rows["take"] * rows["size"]).groupby(rows["source"]).sum()
    assert (abs(words - 0.25 * 30) < 4).all()  # a source's words keep to its target by less than its largest document


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.taken <= 3 * r["size"] for r in rows)
    copies = mixing.mixed(odd_docs)
    assert copies.columns == odd_docs.columns
    assert copies.count() == sum(r.copies for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def files(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, path string, text string, licence string, score int")


def test_licences_are_inherited_from_the_nearest_directory(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the MIT License"),
        (2, "a/b/COPYING.txt", "Some project.\nReleased under the Apache License, Version 2.0.\n" + "more words here " * 50),
        (3, "a/b/c/code.py", "print(1)"),
        (4, "a/other.py", None),
        (5, "a/own.py", "# Licensed under the GNU General Public License, version 3\nimport os\n" + "x = 1\n" * 50),
        (6, "z/none.py", ""),
        (7, None, "nothing"),
        (8, "ab/none.py", "a/ is no ancestor of ab/"),
        (3, "a/b/c/code.py", "print(1)"),
    ]
    got = sorted((r.doc_id, r.licence, r.origin, r.from_path) for r in licenses.scan(files(spark, rows)).collect())
    assert got == [
        (1, "MIT", "file", "a/LICENSE"),
        (2, "Apache-2.0", "header", "a/b/COPYING.txt"),
        (3, "Apache-2.0", "inherited", "a/b/COPYING.txt"),
        (3, "Apache-2.0", "inherited", "a/b/COPYING.txt"),
        (4, "MIT", "inherited", "a/LICENSE"),
        (5, "GPL-3.0", "header", "a/own.py"),
        (6, None, None, None),
        (7, None, None, None),
        (8, None, None, None),
    ]
    assert licenses.scan(files(spark, rows).limit(0)).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li><li>About</li></ul></nav><div class="cookie-banner">We use cookies</div>
<main><article><h1>{title}</h1><p>First &amp; <b>bold</b>   text {title}</p><p>Second&nbsp;caf&eacute;</p><aside>See also</aside></article>
<section class="comments"><p>A reader says hi</p></section></main><form><input value=x><button>Go</button></form><footer>Copyright</footer></body></html>"""


def test_page_texts(spark):
    rows = [(i, f"http://host{i % 2}.example/{i}", PAGE.format(title=f"Title {i}")) for i in range(6)]
    rows += [(6, None, None), (7, "nonsense", ""), (8, "http://bare.example/", "just text < 3 &amp; more"), (9, "http://deep.example/", "<div>" * 400 + "deep" + "</div>" * 400), (0, "http://host0.example/0", PAGE.format(title="Title 0"))]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, wrapper int")
    found = html.main_texts(pages).collect()
    assert len(found) == len(rows)
    text = {r.page_id: r.text for r in found}
    for i in range(6):
        assert text[i] == f"Title {i} First & bold text Title {i} Second café"
    assert text[6] == text[7] == "" and text[8] == "just text < 3 & more" and text[9] == "deep"
    assert all(r.n_chars == len(r.text) for r in found)
    assert html.main_texts(pages.limit(0)).count() == 0


def test_pages_of_great_depth(spark):
    rows = [(0, "http://h/", "<div>" * 20_000 + "deep"), (1, "http://h/", "<b>" * 5000 + "bold" + "<p>" * 3), (2, "http://h/", "<p>plain</p>"), (3, "http://h/", "<div>" * 3000 + "<nav>menu</nav>text" + "</div>" * 3000)]
    found = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {0: "deep", 1: "bold", 2: "plain", 3: "text"}


def test_text_of_one_page_is_no_template(spark):
    """On hosts without an article element, only what all pages hold goes; kinds of one page, a layout of one page and a page alone keep theirs."""
    rows = [(i, "http://a/", f"<body><h1>Shop</h1><div><p>text {i}</p></div><p>Call us</p></body>") for i in range(9)]
    rows += [(9, "http://a/", "<body><h1>Shop</h1><div id=content><p>another layout</p></div><p>Call us</p></body>")]
    rows += [(10, "http://a/", "<body><h1>Shop</h1><div><p>text 10</p><blockquote>a quotation</blockquote><pre>code</pre></div><p>Call us</p></body>")]
    rows += [(11, "http://b/", "<body><h3>Alone</h3><p>one</p><p>two</p></body>")]
    rows += [(12 + i, "http://c/", f"<body><p>first {i}</p><ul><li>item {i}</li></ul><p>All rights reserved</p></body>") for i in range(2)]
    found = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {i: f"text {i}" for i in range(9)} | {9: "another layout", 10: "text 10 a quotation code", 11: "Alone one two", 12: "first 0 item 0", 13: "first 1 item 1"}
    assert {r.page_id: r.text for r in found} == want


def test_wrappers_decide_within_articles(spark):
    """What all articles of a host share goes; class words of layouts and of articles lose no text."""
    rows = [(i, "http://a/", f"<body><article><h1>Title {i}</h1><p>text {i}</p><h4>Read on our site</h4></article></body>") for i in range(3)]
    rows += [(3 + i, "http://b/", f"<body class=no-sidebar><div class='has-sidebar with-header'><main><p>text {i}</p></main></div><div class=sidebar>links {i}</div></body>") for i in range(2)]
    rows += [(5, "http://c/", "<div class=social-feed><article><p>one</p></article></div>"), (6, "http://c/", "<article><p>two</p></article><div class=comments><article>reply</article></div>")]
    rows += [(7, "http://d/", "<article><div class=post-header>Head</div><p class=social-science>Study <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><div class=social-links>Share</div></article>")]
    rows += [(8, "http://e/", "<article><p>copy</p></article><p>1</p>"), (9, "http://e/", "<article><p>copy</p></article><p>2</p>")]
    found = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {i: f"Title {i} text {i}" for i in range(3)} | {3: "text 0", 4: "text 1", 5: "one", 6: "two", 7: "Head Study x=1", 8: "copy", 9: "copy"}
    assert {r.page_id: r.text for r in found} == want


def test_wrappers_are_union_free_expressions(spark):
    a = "<body><h1>Shop</h1><ul><li>one</li><li>two</li></ul><p>tail</p></body>"
    b = "<body><h1>Shop</h1><i class=new>hot</i><ul><li>three</li></ul></body>"
    wrapper = html.aligned(html.generalized(html.parse(a)), html.generalized(html.parse(b)))
    assert html.expression(wrapper.kids[0]) == '(<body>(<h1>"Shop"</h1>)(<i class=new>"hot"</i>)? (<ul>(<li>#</li>)+</ul>) (<p>"tail"</p>)?</body>)'.replace(")(", ") (")


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.judged(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id")).where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc >= 0.85


def test_a_score_does_not_depend_on_neighbours():
    net = quality.ByteConvNet()
    texts = [b"", b"\xff" * 56, b"some text", b"<" * 64, b"end " * 500, b"x"]
    alone = [net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    for order in (texts, texts[::-1], texts[2:] + texts[:2]):
        at = np.cumsum([0, *map(len, order)])
        assert np.allclose(net.score(np.frombuffer(b"".join(order), np.uint8), at), [alone[texts.index(t)] for t in order], atol=1e-6)


def test_quality_gradients():
    """Gradients agree with differences of the loss."""
    net = quality.ByteConvNet(e=3, f=5, h=4)
    texts = [b"some text here " * 9, b"x", b"", b"other words 123 " * 20]
    at = np.cumsum([0, *map(len, texts)])
    raw, label = np.frombuffer(b"".join(texts), np.uint8), np.array([1, 0, 1, 0])
    grad, _ = net.gradients(raw, at, label)
    for name in ("out", "ob", "hid", "hb", "filt"):
        flat, g = net.w[name].reshape(-1), np.asarray(grad[name]).reshape(-1)
        for i in np.argsort(-abs(g))[:2]:
            was = flat[i]
            loss = []
            for step in (1e-2, -1e-2):
                flat[i] = was + step
                loss.append(net.gradients(raw, at, label)[1])
            flat[i] = was
            assert abs((loss[0] - loss[1]) / 2e-2 - g[i]) < 0.02 + 0.2 * abs(g[i]), name


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 1), (9, None, 0), (None, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judged(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    kept = quality.drop_rejected(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.judged(no_docs, labels).count() == 0 and quality.judged(odd_docs, labels.limit(0)).count() == len(rows)
    # Labels of held-out rows change nothing.
    out = [r.doc_id for r in rows if r.held_out and r.doc_id is not None]
    more = labels.unionByName(spark.createDataFrame([(i, 1, 0) for i in out], labels.schema)) if out else labels
    assert sorted((str(r.doc_id), r.score) for r in quality.judged(odd_docs, more).collect()) == sorted((str(r.doc_id), r.score) for r in rows)


def test_pipeline_stages_follow_each_other(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, names = docs.columns, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "mix", "bpe"]
    seen, texts = [docs.count()], []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).collect()
        if name == "bpe":
            assert len(out) == seen[-1] and all(r.exact for r in out)
            break
        assert list(out[0].asDict()) == columns
        texts.append([r.text or "" for r in out])
        seen.append(len(out))
        docs = spark.createDataFrame(out, docs.schema)
    assert seen[0] > seen[1] > 0 and len(set(texts[1])) == len(texts[1]) and set(texts[1]) == set(texts[0])
    assert set(texts[2]) <= set(texts[1]) and set(texts[3]) <= set(texts[2])
    assert corpus_pipeline.run(spark, sf).count() == seen[-1]


STANDARD = {
    "# SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
    "GNU GENERAL PUBLIC LICENSE Version 3": "GPL-3.0",
    "Licensed under the GNU Affero General Public License, version 3": "AGPL-3.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "Permission to use, copy, modify, and/or distribute this software for any": "ISC",
    "Redistribution and use in source and binary forms, with or without": "BSD-2-Clause",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "Eclipse Public License - v 2.0": "EPL-2.0",
    "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.": "GPL-3.0",
    "This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU Lesser General Public License as published by\n// the Free Software Foundation, either version 2.1 of the License, or\n// (at your option) any later version.": "LGPL-2.1",
    "Licensed under a license of our own": None,
    "SPDX-License-Identifier: WTFPL": None,
    "Er kommt mit dem Zug; no general terms apply to this work": None,
}


def test_standard_headers_tags_and_openings(spark):
    rows = [(i, f"d{i}/x.py", f"import os\n\n{text}\n\nx = 1\n" + "some words of the file\n" * 40) for i, text in enumerate(STANDARD)]
    found = {r.doc_id: (r.licence, r.origin) for r in licenses.scan(files(spark, rows)).collect()}
    assert found == {i: (name, name and "header") for i, name in enumerate(STANDARD.values())}


def test_texts_of_licences_are_files_and_very_long_texts_are_read(spark):
    full = {name: max(texts, key=len) for name, texts in licenses.TEXTS.items() if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "0BSD")}
    rows = [(i, f"p{i}/LICENSE", "Copyright (c) 2020 A. Writer\n\n" + text) for i, text in enumerate(full.values())]
    rows += [(10 + i, f"p{i}/src/code.py", None) for i in range(len(full))]
    rows += [(20, "q/long.txt", "words without end " * 300_000 + "\nReleased under the MIT License.\n" + "more of them " * 300_000)]
    found = {r.doc_id: (r.licence, r.origin) for r in licenses.scan(files(spark, rows)).collect()}
    want = {i: (name, "file") for i, name in enumerate(full)} | {10 + i: (name, "inherited") for i, name in enumerate(full)}
    assert found == want | {20: ("MIT", "header")}


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    """Every stage takes nulls, empty and very long texts, repeated rows and clashing columns, and an empty table."""
    import corpus_pipeline
    from oddsloom.llm import quality as Q

    monkeypatch.setattr(Q, "PASS_SCORE", 0.0)  # nothing is rejected, so all rows reach the other stages
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {}
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found[name] = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
    assert found["none"] == []
    ids = {r.doc_id for r in found["odd"]}
    assert ids <= {r.doc_id for r in odd_docs.select("doc_id").collect()} and {7, 9} & ids and all(r.exact for r in found["odd"])


def naive_score(net, text):
    """The network's definition, window by window and chunk by chunk."""
    w, size = net.w, quality.BLOCK
    n_blocks = (len(text) + quality.WIDTH + 2 + size - 1) // size
    codes = list(text) + [quality.PAD] * (n_blocks * size + quality.WIDTH - len(text))
    tops = []
    for b in range(n_blocks):
        responses = []
        for i in range(b * size, (b + 1) * size, quality.STRIDE):
            if b == n_blocks - 1 and i + quality.WIDTH > n_blocks * size:
                responses.append(np.zeros(w["filt"].shape[1]))
            else:
                responses.append(np.concatenate([w["emb"][c] for c in codes[i : i + quality.WIDTH]]) @ w["filt"])
        tops.append(np.max(responses, 0))
    hidden = [np.maximum(np.maximum(np.maximum(tops[b], tops[min(b + 1, n_blocks - 1)]) + w["fb"], 0) @ w["hid"] + w["hb"], 0) for b in range(n_blocks)]
    return 1 / (1 + np.exp(-(np.max(hidden, 0) @ w["out"] + w["ob"][0])))


def test_scores_against_the_definition(monkeypatch):
    net = quality.ByteConvNet(seed=3)
    rng = np.random.default_rng(2)
    texts = [b"", b"a", b"words of a text " * 11, bytes(rng.integers(0, 256, 1000, dtype=np.uint8)), "naïve 漢字".encode() * 9]
    at = np.cumsum([0, *map(len, texts)])
    want = [naive_score(net, t) for t in texts]
    assert np.allclose(net.score(np.frombuffer(b"".join(texts), np.uint8), at), want, atol=1e-5)
    monkeypatch.setattr(quality, "PIECE", 128)  # long texts piece by piece
    for text, score in zip(texts, want, strict=True):
        assert np.allclose(net.score(np.frombuffer(text, np.uint8), np.array([0, len(text)])), [score], atol=1e-5)
