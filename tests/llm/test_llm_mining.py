"""Hard negatives, divergence of sources and the Jaccard join against brute force; words that share a polynomial hash."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oddsloom.llm import automaton, bpe, counting, dedup, divergence, negatives, neardup, partenum, quality, queries

VECTORS = "vec_id long, embedding array<float>, label int, cell string, shard string, norm string, d string"


# ---------------------------------------------------------------------------------------------- op13


def brute_components(rows, words=4, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def joined(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[at] = f"new{rng.random()}"
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"more{rng.random()}")
    return words


def test_jaccard_of_documents_and_odd_rows(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert joined(partenum.jaccard_components(docs)) == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert joined(partenum.jaccard_components(odd_docs)) == brute_components([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert partenum.jaccard_components(no_docs).count() == 0


def test_jaccard_around_the_threshold(spark):
    rng = random.Random(4)
    texts = []
    for size in (1, 3, 4, 5, 9, 10, 11, 13, 16, 25, 40, 70, 120, 300):
        for _ in range(6):
            words = [f"w{rng.randrange(10**9)}" for _ in range(size)]
            texts += [" ".join(words)] + [" ".join(edited(rng, words, rng.randrange(0, max(2, size // 25 + 2)))) for _ in range(4)]
    # Chains of neighbours: the ends are no link of their own; and texts that share a passage only.
    chain = [f"c{i}" for i in range(60)]
    for i in range(12):
        chain = [*chain[1:], f"d{i}"]
        texts.append(" ".join(chain).upper())
    passage = " ".join(f"p{i}" for i in range(80))
    texts += [f"{passage} " + " ".join(f"q{rng.random()}" for _ in range(20 + i % 3)) for i in range(40)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_components(rows)
    assert joined(partenum.jaccard_components(df)) == want
    assert len({c for _, _, c in want}) < len(want) - 60


def test_no_pair_at_the_threshold_lacks_a_shared_signature():
    rng, known = np.random.default_rng(3), partenum.bands(85)
    for n in (7, 8, 12, 13, 20, 33, 48, 100, 260, 900):
        for _ in range(20):
            r = int(rng.integers(0, n * 15 // 100 + 1))
            m = max((m for m in range(n) if 100 * (n - r) >= 85 * (n + m)), default=None)
            if m is None or r + m == 0:
                continue
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[r:], rng.integers(0, 1 << 63, m, dtype=np.uint64)])
            assert len(np.intersect1d(known.signatures(np.sort(a)), known.signatures(np.sort(b)))), (n, r, m)


def test_small_slots_and_held_signatures_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(partenum, "HELD", 500)
    monkeypatch.setattr(partenum, "SLOT", 100)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(6)))) for i in range(60)] + [(100 + i, " ".join(edited(rng, base[:45], rng.randrange(4)) + [f"z{i}"] * 5)) for i in range(40)]
    assert joined(partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute_components(rows)


# ---------------------------------------------------------------------------------------------- op12


def brute_audit(rows, least=3, ranks=200):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        mine = [x for x in terms if x[0] == lang]
        docs = Counter(t for _, _, w in mine for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= least)
        count = {s: Counter() for _, s, _ in mine}
        for _, s, w in mine:
            count[s].update(t for t in w if docs[t] >= least)
        whole = sum(count.values(), Counter())

        def p(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        q, of = p(whole), {s: p(c) for s, c in count.items()}
        for s in count:
            pairs = [(sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept), o) for o in count if o != s]
            found = [((of[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[s][t] and of[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", found, ranks)):
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(values[:most])]
    return sorted(out)


def audited(df, **how):
    return sorted(map(tuple, divergence.audit(df, **how).collect()))


def test_divergence_of_documents_and_odd_rows(spark, sf, odd_docs, no_docs, duck, same_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert audited(docs) == brute_audit([(r.text, r.lang, r.source) for r in docs.collect()])
    same_rows(queries.op12_divergence(spark, sf).toPandas(), duck.execute(queries.SQL["op12_divergence"]).df())
    assert audited(odd_docs) == brute_audit([(r.text, r.lang, r.source) for r in odd_docs.collect()])
    assert divergence.audit(no_docs).count() == 0


def test_divergence_stops_early_and_settles_ties(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROWTH", 2)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PIECE", 20)
    rng = random.Random(2)
    rows = []
    for i in range(120):
        words = [f"{'abcdefgh'[min(int(rng.expovariate(0.4)), 7)]}{'xyzé'[rng.randrange(4)]}{'mnopqrst'[rng.randrange(8)]}" for _ in range(60)]
        rows.append((" ".join(words) + "-Ärger_İ\x00tail", ["en", "de", None][i % 3], f"s{min(int(rng.expovariate(0.7)), 4)}"))
    rows += [("only once here", "xx", "a"), (None, "xx", None), ("", "xx", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for ranks in (1, 3, 10):
        assert audited(df, ranks=ranks) == brute_audit(rows, ranks=ranks)


def test_probabilities_of_large_counts(spark):
    n, size = 8 * 10**13, 9 * 10**13
    got = spark.range(1).select(divergence.probability(F.lit(n).cast("long"), F.lit(size).cast("long")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // size


# ---------------------------------------------------------------------------------------------- op11


def brute_negatives(rows, step=100):
    seen = {}
    for i, v, lab, *_ in rows:
        if i is None or v is None or lab is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        if sum(x * x for x in whole) < 2**62:
            key = (lab, [float(np.float32(x)) for x in v])
            if i not in seen or key > seen[i][0]:
                seen[i] = key, lab, whole
    out = []
    for a, (_, lab, v) in seen.items():
        if a % step:
            continue
        score = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, (_, m, w) in seen.items() if i != a and len(w) == len(v)]
        score.sort()
        for s, p, _ in [x for x in score if x[2] == lab][:5]:
            hit = [(t, i) for t, i, m in score if m != lab and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(hit)]
    return sorted(out)


def mined(df, step=100):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % step == 0).collect()))


def vectors(rng, n, d=12, same=0):
    centre = rng.normal(size=(6, d))
    rows = []
    for i in range(n):
        c = int(rng.integers(6))
        v = np.ones(d) if i < same else centre[c] + rng.normal(size=d) * 0.5
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3)) if rng.random() < 0.3 else c % 3, *[None] * 4))
    return rows


def test_hard_negatives_of_embeddings(spark, sf, duck, same_rows):
    same_rows(queries.op11_hard_negatives(spark, sf).toPandas(), duck.execute(queries.SQL["op11_hard_negatives"]).df())


def test_hard_negatives_with_ties_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_ROWS", 60)
    monkeypatch.setattr(negatives, "CROWD_ROWS", 10)
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "SAMPLE", 100)
    rows = vectors(np.random.default_rng(1), 900, same=300)
    assert mined(spark.createDataFrame(rows, VECTORS), 20) == brute_negatives(rows, 20)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(np.random.default_rng(2), 60, d=3) + [(100, None, 1, *[None] * 4), (101, [1.0, nan, 0.0], 1, *[None] * 4), (102, [1.0, None, 0.0], 1, *[None] * 4), (103, [inf, 0.0, 0.0], 1, *[None] * 4), (104, [1.0, 1.0, 1.0], None, *[None] * 4), (None, [1.0, 1.0, 1.0], 1, *[None] * 4)]
    rows += [(0, [9.0, 9.0, 9.0], 0, *[None] * 4), (200, [0.0, 0.0, 0.0], 1, *[None] * 4), (300, [], 1, *[None] * 4), (301, [], 2, *[None] * 4), (302, [], 1, *[None] * 4), (400, [1e6, 2e6, 3e5], 0, *[None] * 4), (401, [1e6, 2e6, 3e5], 0, *[None] * 4), (402, [9e5, 2e6, 3e5], 2, *[None] * 4), (403, [3e38, 0.0, 0.0], 2, *[None] * 4), (500, [1.0, 2.0], 0, *[None] * 4)]
    assert mined(spark.createDataFrame(rows, VECTORS), 20) == brute_negatives(rows, 20)
    assert mined(spark.createDataFrame([], VECTORS)) == []
    assert mined(spark.createDataFrame(vectors(np.random.default_rng(3), 30)[1:], VECTORS)) == []


def test_brackets_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(8, 16))[rng.integers(8, size=2000)] + 0.1 * rng.normal(size=(2000, 16)))).astype(np.int64)
    most = float((x * x).sum(1).max())
    table = negatives.PivotTable(x[:500], most)
    d, a = table.distances(x), x[7]
    asked, norm, score = table.asked(x[7:8]), np.array([float(a @ a)]), x @ a
    upper, lower = table.upper(norm, asked, d, d)[0], table.lower(norm, asked, d)[0]
    assert (lower <= score).all() and (score <= upper).all()
    assert (upper < np.sort(score)[-5]).mean() > 0.5


# ------------------------------------------------------------------- words of one polynomial hash


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits[:n])


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_of_one_hash_are_told_apart(spark, n):
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer((word + other + word).encode(), np.uint8)
    start, end = np.arange(3) * n, np.arange(1, 4) * n
    assert automaton.distinct_spans(raw, start, end)[1].tolist()[0::2] == [0, 0] and automaton.distinct_spans(raw, start, end)[1][1] == 1
    texts = [f"{word} {other} {word}", f"{other} {word}", word, other]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [r.n_tokens for r in bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).orderBy("doc_id").collect()] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert all(r.exact for r in bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).collect())
    assert [r.n_tokens for r in counting.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).orderBy("doc_id").collect()] == [len(pieces.encode(t)) for t in texts]
    near = neardup.near_groups(spark.createDataFrame([(i, " ".join([w] * 7)) for i, w in enumerate((word, other))], "doc_id long, text string"))
    assert {r.class_size for r in near.collect()} == {1}


# ----------------------------------------------------------------------- bounds of earlier operators


def test_a_labelled_text_that_does_not_fit_is_passed_over(spark, sf, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 400_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    # The first of all by its hash, not held out.
    giant = spark.range(10**6, 10**6 + 20000).withColumnRenamed("id", "doc_id").where(~quality.held_out()).orderBy(F.xxhash64("doc_id")).first().doc_id
    more = spark.createDataFrame([(giant, "x" * 500_000)], "doc_id long, text string")
    plain = quality.train(docs, labels)
    other = quality.train(docs.unionByName(more), labels.unionByName(spark.createDataFrame([(giant, 1)], "doc_id long, quality int")))
    assert all(np.array_equal(plain.w[k], other.w[k]) for k in plain.w)
    assert not all(np.array_equal(plain.w[k], quality.ByteConvNet().w[k]) for k in plain.w)


def test_a_bucket_counts_the_ids_of_its_rows(spark):
    rows = [(i, f"t{i % 50}") for i in range(6000)]
    keys = spark.createDataFrame(rows, "doc_id long, t string").select(F.xxhash64("t").alias("key"), F.octet_length("t").cast("long").alias("n_bytes"))
    texts = spark.createDataFrame(rows, "doc_id long, t string").select(F.xxhash64("t").alias("key"), F.col("t").cast("binary").alias("text"), "doc_id")
    index = dedup.ExtendibleIndex.build(texts, keys, capacity=20_000)
    held = index.rows(spark).groupBy("bucket").agg(F.sum(F.size("ids")).alias("n"), F.count_distinct("key").alias("k")).collect()
    assert sum(r.n for r in held) == 6000 and all(r.k == 1 or r.n * dedup.ID_BYTES <= 20_000 for r in held) and len(held) > 5
