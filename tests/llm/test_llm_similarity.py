"""Near-duplicates and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.llm import ann, components, neardup


def counted(shingles):
    """The i-th occurrence of a shingle as an element of its own: weights by count."""
    seen = {}
    out = set()
    for x in shingles:
        seen[x] = seen.get(x, 0) + 1
        out.add((x, seen[x]))
    return out


def brute_classes(rows, collect=set):
    """(doc_id, class_id, class_size, kept) by comparing every pair."""
    sets = []
    for _, text in rows:
        words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in text or "").split(" ") if w]
        sets.append(collect(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    classes = {}
    for i, (doc_id, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = classes[find(i)]
        least = min((x for x in ids if x is not None), default=None)
        out.append((doc_id, least, len(ids), doc_id == least))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "class_id", "class_size", "kept").collect()), key=str)


def test_near_groups_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(neardup.near_groups(docs)) == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_weighted_near_groups_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    groups = neardup.near_groups(docs, weights="count").cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(groups) == brute_classes(rows, counted)
    # Each text that is not alone names one that it is linked with, at the similarity given.
    text = dict(rows)
    sets = {i: counted(zip(*[(t or "").split()[k:] for k in range(5)], strict=False)) for i, t in rows}
    pairs = groups.where("near_id is not null").collect()
    assert pairs and all(len(text[r.doc_id].split()) >= 5 for r in pairs)
    for r in pairs:
        a, b = sets[r.doc_id], sets[r.near_id]
        assert r.near_similarity >= 0.8 - 1e-6 and abs(len(a & b) / len(a | b) - r.near_similarity) < 1e-6


def test_weights_tell_repetition_apart(spark):
    """A text of one line many times is near to the line a few times as a set, but not by counts."""
    line = " ".join(f"w{i}" for i in range(30)) + "\n"
    docs = spark.createDataFrame([(1, line * 3), (2, line * 40), (3, line * 38)], "doc_id long, text string")
    classes = lambda weights: {r.doc_id: r.class_id for r in neardup.near_groups(docs, weights=weights).collect()}
    assert classes("set") == {1: 1, 2: 1, 3: 1} and classes("count") == {1: 1, 2: 2, 3: 2}


def test_blocks_by_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ITEMS", 1000)
    rows = crowd(150)
    ours = {i: c for i, c, *_ in found(neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), weights="count"))}
    theirs = {i: c for i, c, *_ in brute_classes(rows, counted)}
    assert sum(ours[i] == theirs[i] for i in ours) >= 149


def test_near_groups_of_odd_rows(odd_docs, no_docs):
    assert found(neardup.near_groups(odd_docs)) == brute_classes([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert neardup.near_groups(no_docs).count() == 0
    kept = neardup.drop_near(odd_docs)
    assert kept.columns == odd_docs.columns and neardup.drop_near(no_docs).count() == 0
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 8, 8, 9]


def test_rows_of_one_id_are_dropped_one_by_one(spark):
    """Null ids and an id on texts of two classes: only the near copies go."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, b), (5, a), (5, b + " end"), (6, a + " end"), (None, a), (None, c), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, neardup.drop_near(docs).collect()), key=str)
    assert got == sorted([(3, b), (5, a), (None, c)], key=str)


def crowd(n, seed=5):
    """Copies of one text, each with some words changed: chains of near texts that are far from the hub."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [8, 256])
def test_a_large_group_loses_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = crowd(150)
    ours = {i: c for i, c, *_ in found(neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")))}
    theirs = {i: c for i, c, *_ in brute_classes(rows)}
    # Pairs at the threshold meet with a probability of 0.9993; classes hang together by many pairs.
    assert sum(ours[i] == theirs[i] for i in ours) >= 149


def test_similarity_from_signatures():
    """The share of equal coordinates is the weighted Jaccard similarity, for any weights."""
    rng = np.random.default_rng(1)
    n = 400
    element = rng.integers(1, 1 << 62, n).astype(np.uint64)
    a, b = rng.uniform(0.2, 6, n), rng.uniform(0.2, 6, n)
    b[: n // 2] = a[: n // 2]
    order = np.argsort(element)
    doc = np.repeat([0, 1], n)
    signature = neardup.dart_minhash(doc, np.concatenate([element[order]] * 2), np.concatenate([a[order], b[order]]), 2, 2048)
    assert abs((signature[0] == signature[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("a"), F.lpad((F.col("id") + 1).cast("string"), 4, "0").alias("b"))
    found = components.components(links).collect()
    assert len(found) == 301 and {r.label for r in found} == {"0000"}


def brute_neighbours(rows, is_query, k):
    d = max((len(v) for _, v in rows if v), default=0)
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and len(v) == d and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, x = np.array(sorted(usable)), np.stack([usable[i] for i in sorted(usable)])
    out = {}
    for i in filter(is_query, ids):
        scores = x @ usable[i]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), scores[j]) for j in order]
    return out


def test_neighbours_of_embeddings(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute_neighbours([(r.vec_id, r.embedding) for r in vectors.collect()], lambda i: i % 20 == 0, 20)
    rows = ann.neighbours(vectors, F.col("vec_id") % 20 == 0).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    exact = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    for q, best in got.items():
        assert [(-s, v) for v, s in best] == sorted((-s, v) for v, s in best)
        assert all(abs(s - exact[q] @ exact[v]) < 1e-12 for v, s in best)


def test_neighbours_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, list int, score string, query_id int"
    good = [(i, [float(i % 3), 1.0, float(-i)]) for i in range(10)]
    odd = [(20, None), (40, [0.0, 0.0, 0.0]), (60, [1.0, None, 2.0]), (80, [float("nan"), 1.0, 1.0]), (100, [float("inf"), 1.0, 1.0]), (120, []), (140, [1.0]), (None, [1.0, 2.0, 3.0]), (5, [2.0, 1.0, -5.0])]
    rows = good + odd
    frame = spark.createDataFrame([(*r, None, None, None) for r in rows], schema)
    found = ann.neighbours(frame, F.col("vec_id") % 5 == 0, 20).collect()
    want = brute_neighbours(good, lambda i: i % 5 == 0, 20)
    got = {q: [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in want}
    assert got == want and len(found) == 2 * 9
    assert ann.neighbours(frame.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert ann.neighbours(frame, F.lit(False)).count() == 0
    one = ann.neighbours(spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>"), F.lit(True))
    assert one.count() == 0


def test_abandoned_candidates_are_rare():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(3000, 64)), rng.normal(size=(40, 64))
    scores = q @ x.T
    bound = np.sort(scores, axis=1)[:, -20]
    i, j, score = ann.scan(q, x, bound, np.zeros(scores.shape, bool), 20, ann.rotation(64))
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    true = {(a, b) for a in range(40) for b in np.flatnonzero(scores[a] >= bound[a])}
    assert len(true & kept) >= 0.98 * len(true) and len(kept) < 0.5 * scores.size
    assert np.allclose(score, scores[i, j])


def test_near_candidates_agree_in_all_blocks():
    """Neighbours of a high cosine, of a common direction and of few dimensions are kept, and far vectors are still left."""
    rng = np.random.default_rng(12)
    noise = lambda n: rng.normal(size=(n, 64))
    centres = noise(20)
    grouped = centres[np.arange(2000) % 20] + 0.2 * noise(2000)
    shifted = noise(2000) + 5 * np.eye(64)[0]
    flat = rng.normal(size=(2000, 4)) @ rng.normal(size=(4, 64)) + 0.01 * noise(2000)
    for x in (grouped, shifted, flat):
        q = x[:40]
        scores = q @ x.T
        bound = np.sort(scores, axis=1)[:, -20]
        i, j, score = ann.scan(q, x, bound, np.zeros(scores.shape, bool), 20, ann.rotation(64))
        kept = set(zip(i.tolist(), j.tolist(), strict=True))
        true = {(a, b) for a in range(40) for b in np.flatnonzero(scores[a] >= bound[a])}
        assert len(true & kept) >= 0.98 * len(true) and len(kept) < 0.5 * scores.size
        assert np.allclose(score, scores[i, j])


def test_lists_of_two_levels(monkeypatch):
    """Orders of lists are those of their centres, whatever share of them is asked for."""
    monkeypatch.setattr(ann, "COARSE", 50)
    rng = np.random.default_rng(4)
    sample = rng.normal(size=(600, 8))
    lists = ann.Lists(sample, 256 * 50 * 12)
    assert len(lists.coarse) == 50 and len(lists.fine) == 12
    centres = (lists.coarse[:, None] + lists.fine[None]).reshape(-1, 8)
    q = rng.normal(size=(5, 8))
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    for n in (1, 7, 100, 500, len(lists)):
        score = q @ centres.T
        assert np.allclose(np.take_along_axis(score, lists.best(q, n), 1), np.take_along_axis(score, order[:, :n], 1))
    assert [int(x) for x in lists.place(q, order[:, 321])] == [321] * 5
    assert (lists.of(centres[[3, 70]]) >= 0).all()


def test_neighbours_with_fine_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 8)
    monkeypatch.setattr(ann, "COARSE", 16)
    monkeypatch.setattr(ann, "BROADCAST_LISTS", 0)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 12))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    hits = [len(got[i] & set(np.argsort(-score[i])[:10].tolist())) for i in range(0, 1500, 20)]
    assert sum(hits) / (10 * len(hits)) >= 0.9 and all(len(v) == 10 for v in got.values())
