"""Cases of the findings of round 3."""

import duckdb

from oddsloom.plans import matching as plans


def made_pages(tmp_path, spark, titles, times=1):
    rows = [(i + j * len(titles), f"https://a/{i}", f'<html lang="en"><head><title>{t}</title></head></html>') for j in range(times) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    return con


def same_rows(spark, con, tmp_path, query, sql):
    ours = query(spark, str(tmp_path))
    names = sorted(ours.columns)
    got = sorted(tuple(str(r[c]) for c in names) for r in ours.collect())
    want = sorted(tuple(str(x) for x in r) for r in con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    assert got == want
    return got


def test_title_numbers_side_by_side(spark, tmp_path):
    """Numbers that share what parts them, and numbers that a double does not hold to two places, are as SQL gives them."""
    titles = ["call +1 (790) 555-2115 now", "cards 2353820953013749 4550997810720808 end", "4501042323994846", "at 0.125 or 2.675 or 0.375", "1/2 3,4 5-6 7 8 9", "$5k 12 m $3 million", "99999999999999999", "1 2 é3"]
    con = made_pages(tmp_path, spark, titles, 9)
    got = same_rows(spark, con, tmp_path, plans.title_numbers, plans.NUMBERS_SQL)
    assert any("4501042323994846.08" in r[0] for r in got) and len(got) == 72


def test_shared_words_of_copies(spark):
    """Copies of markets are joined as classes; results are those of all pairs, ties to the smaller market."""
    from oddsloom.operators import matching as M

    titles = [["alpha", "beta"], ["alpha", "gamma"], ["delta", "beta", "zeta"], ["omega", "sigma"]]
    made = lambda n, at: [(at + i, titles[i % len(titles)] + [f"word{i % 37}"]) for i in range(n)]
    rows_a, rows_b = made(30, 0), made(400, 1000)
    frame = lambda rows: spark.createDataFrame(rows, "market_id long, tokens array<string>")
    got = {}
    for r in M.most_shared(frame(rows_a), frame(rows_b), "a", "b").collect():
        got.setdefault(r.a, set()).add((r.b, r.shared))
    df = {}
    for _, words in rows_b:
        for w in words:
            df[w] = df.get(w, 0) + 1
    known = {w for w, n in df.items() if n <= max(20, int(400 * 0.08)) and len(w) >= 4}
    want = {}
    for a, words in rows_a:
        shared = [(-len(known & set(words) & set(other)), b) for b, other in rows_b]
        best = {(b, -n) for n, b in sorted(x for x in shared if x[0] < 0)[:40]}
        if best:
            want[a] = best
    assert want and got == want


def test_registered_models_join_nothing_of_their_own(spark, sf):
    """What each model looks up is a column of the markets; a join and a sort for each would add up in one task."""
    from oddsloom.plans import further

    out = further.registered_models(spark, sf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # The joins that are left are those of the pool: with declarations (three times), with means, and with distances.
    joins = [line.split("Join ")[1][:60] for line in plan.splitlines() if "Join " in line]
    assert "LeftSemi" not in plan and len(joins) == 5, joins
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({further.QUERIES['registered_models'][1]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())


def test_thin_books_in_bounded_parts(spark, sf, monkeypatch):
    """Books by order are dealt once, into parts whose number grows with the rows."""
    from oddsloom.plans import adapters, pricing

    monkeypatch.setattr(adapters, "THIN_ROWS", 500)
    out = pricing.top_of_book(spark, sf)
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(book_id") == 1 and f", {n // 500 + 1}), REPARTITION_BY_NUM" in plan


def test_ties_of_imbalance(spark):
    """An imbalance that ends in half of the last place is rounded as that of whole numbers."""
    from oddsloom.operators import books

    rows = spark.sql("SELECT CAST(b AS decimal(29,8)) AS b, CAST(a AS decimal(29,8)) AS a FROM VALUES ('0.425', '0.855'), ('42.5', '85.5'), ('0', '0'), (NULL, '0.07') AS t(b, a)")
    got = [r.x for r in rows.select(books.imbalance(rows.b, rows.a).alias("x")).collect()]
    assert got == [-43 / 128, -43 / 128, None, -1.0]


def test_jaccard_compares_a_pair_once(spark, monkeypatch):
    """A family of texts that are close and mostly unlinked: no pair of sets is compared in two turns, and links are those of all pairs."""
    from itertools import combinations

    from oddsloom.llm import partenum

    rows = []
    for i in range(12):
        words = [f"w{j}" for j in range(120)]
        for k in range(1 + i % 5):
            words[(k * 23 + 7 * i) % 120] = f"x{i}{k}"
        rows.append((i, " ".join(words)))
    seen, of = [], partenum._similar

    def counted(pairs, *rest):
        seen.extend((min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect())
        return of(pairs, *rest)

    monkeypatch.setattr(partenum, "_similar", counted)
    got = {r.doc_id: r.component_id for r in partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(117)} for i, t in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for a, b in combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    assert got == least and 1 < len(set(least.values())) < 12
    assert seen and len(seen) == len(set(seen))


def test_jaccard_deals_what_may_link(spark, monkeypatch):
    """A family of texts that are close and mostly unlinked: pairs that cannot link are not dealt, and links are those of all pairs."""
    import random
    from itertools import combinations

    from oddsloom.llm import partenum

    rng, rows = random.Random(5), []
    for i in range(40):
        words = [f"w{j}" for j in range(200)]
        for k in rng.sample(range(200), 8):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            words[rng.randrange(200)] = f"z{i}"
            rows.append((100 + i, " ".join(words)))
    written, of = {}, partenum.stored

    def counted(df, name, wide=False):
        out = of(df, name, wide)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(partenum, "stored", counted)
    got = {r.doc_id: r.component_id for r in partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(197)} for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    least = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least and 10 <= len(links) < 100
    # There are 1,225 pairs; nearly all share a signature.
    assert len(links) // 2 <= written["partenum-dealt"] <= 2 * len(links)


def test_jaccard_filters_lose_no_link(spark):
    """Sets that differ in just as many elements as the threshold allows, or in one less or more: sizes and sketches let all links through."""
    import numpy as np

    from oddsloom.llm import partenum

    rng, rows = np.random.default_rng(7), []
    for n in (1, 2, 7, 20, 100, 101, 640, 3000, 9000):
        base = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        for lost in range(n // 3 + 1) if n < 200 else (0, n // 30, int(n * 0.15) - 1, int(n * 0.15), n * 3 // 37, n * 3 // 37 + 1, n // 5, n):
            for gained in {0, lost, lost // 2}:
                a, b = base[:n], np.concatenate([base[lost:n], base[n : n + gained]])
                if len(b):
                    both = n - lost
                    x, y = partenum._sketch(a), partenum._sketch(b)
                    bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
                    assert len(x) * 64 == partenum.SKETCH and bits <= lost + gained
                    rows.append((100 * both >= 85 * (n + gained), n, len(b), x.tolist(), y.tolist()))
    df = spark.createDataFrame(rows, "link boolean, a_held long, b_held long, a_sketch array<long>, b_sketch array<long>")
    got = df.select("link", (partenum._sizes_allow("a_held", "b_held", 85) & partenum._sketches_allow(85)).alias("may")).collect()
    assert all(r.may for r in got if r.link) and sum(r.link for r in got) > 50
    assert sum(not r.may for r in got if not r.link) > 0.5 * sum(not r.link for r in got)


def test_jaccard_counts_equal_signatures_once(spark, monkeypatch):
    """Signatures that the same sets have are joined once, however many they are."""
    from oddsloom.llm import partenum

    rows = [(10 * i + j, " ".join(f"w{i}x{k}" if k != 50 * j else f"v{i}y{j}" for k in range(300))) for i in range(5) for j in range(3)]
    written, of = {}, partenum.stored

    def counted(df, name, wide=False):
        written[name] = out = of(df, name, wide)
        return out

    monkeypatch.setattr(partenum, "stored", counted)
    got = {r.doc_id: r.component_id for r in partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}
    # Three sets have at most four subsets of two or more.
    assert written["partenum-signatures"].count() <= 4 * 5 < written["partenum-members"].select("signature").distinct().count()
