"""Wrappers decide what the article of a page is: pages without telling tags or class words, any partitioning, long pages."""

import random

from oddsloom.llm import html

WORDS = "river stone winter market letter garden engine silver morning doctor travel window paper school music island".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def scrambled_site(n_hosts=20, n_pages=8, seed=3):
    """(page_id, url, html, the article's text) of hosts whose parts are divs in an order and with class names of their own."""
    rng = random.Random(seed)
    out = []
    for h in range(n_hosts):
        names = ["".join(rng.choice("bcdfgklmrstvz") for _ in range(6)) for _ in range(6)]
        order = [*rng.sample(["menu", "notice", "advert", "body", "links", "foot"], 6)]
        for i in range(n_pages):
            blocks = [prose(rng, 5)] + [prose(rng, rng.randint(20, 60)) for _ in range(rng.randint(3, 6))]
            items = [prose(rng, 8) for _ in range(rng.randint(0, 3))]
            article = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:]) + ("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if items else "")
            part = {
                "menu": "<ul>" + "".join(f"<li><a href=/{w}>{w}</a></li>" for w in rng.sample(WORDS, 6)) + "</ul>",
                "notice": f"<p>Host {h} keeps records of its visitors</p>",
                "advert": prose(rng, 4),
                "body": article,
                "links": "".join(f"<a href=/{w}>{prose(rng, 4)}</a><br>" for w in rng.sample(WORDS, 4)),
                "foot": f"Host {h}, printed {prose(rng, 3)}",
            }
            page = "<html><body>" + "".join(f"<div class={names[k]}>{part[name]}</div>" for k, name in enumerate(order)) + "</body></html>"
            out.append((1000 * h + i, f"http://h{h}.example/{i}", page, " ".join(blocks + items)))
    return out


def test_scrambled_pages_and_an_empty_wrapper(spark):
    rows = scrambled_site()
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html.main_texts(pages).collect()}
    assert found == {r[0]: r[3] for r in rows}
    empty = html.Wrapper(html.Node("#page"))
    assert all(empty.read(page) != text for _, _, page, text in rows)


def test_texts_do_not_depend_on_partitioning(spark):
    rows = scrambled_site(4, 30, 9)
    rng = random.Random(1)
    for i in range(40):  # shapes of many kinds on one host
        kinds = [rng.choice(["p", "h2", "ul", "pre", "div class=" + rng.choice(WORDS)]) for _ in range(rng.randint(2, 12))]
        rows.append((9000 + i, "http://odd.example/", "<body>" + "".join(f"<{k}>{prose(rng, rng.randint(1, 20))}</{k.split()[0]}>" for k in kinds) + "</body>", ""))
    frames = []
    for n in (1, 3, 7):
        rng.shuffle(rows)
        pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(n)
        frames.append(({(r.host, r.wrapper) for r in html.infer_wrappers(pages, 100_000).collect()}, {(r.page_id, r.text) for r in html.main_texts(pages).collect()}))
    assert frames[0] == frames[1] == frames[2]


def test_common_subsequences_against_brute_force():
    rng = random.Random(5)

    def longest(x, y):
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(400):
        x, y = ([rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = html.common(x, y)
        assert len(pairs) == longest(x, y)
        assert all(x[i] == y[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_pages_of_thousands_of_unlike_children(spark):
    def page(step):
        return "<body><main>" + "".join(f"<p class={'abcdefghij'[i * step % 10]}{'klmnopqrst'[i * step // 10 % 10]}>t{i}</p>" for i in range(20_000)) + "</main></body>"

    rows = [(i, "http://long/", page(step)) for i, step in enumerate((1, 3, 7))] + [(3, "http://long/", "<main><p>" + "word " * 400_000 + "</p></main>")]
    found = {r.page_id: r.n_chars for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    size = sum(len(f"t{i}") for i in range(20_000)) + 19_999
    assert found == {0: size, 1: size, 2: size, 3: 5 * 400_000 - 1}


def test_sequences_of_kinds_that_repeat_are_groups():
    wrapper = html.wrapper_of("<body>" + "".join(f"<h2>part {i}</h2><p>text {i}</p>" for i in range(4)) + "</body>")
    assert html.expression(wrapper.kids[0]) == "(<body>((<h2>#</h2>) (<p>#</p>))+</body>)"


def test_hidden_text_reader_comments_and_headings(spark):
    talk = "<div class=discussion>" + "".join(f"<div><b>Ann</b><p>I agree {i}</p></div>" for i in range(3)) + "</div>"
    rows = [
        (0, "http://a/", f"<article><h1>Title</h1><p>Some text.</p><p style='display:none'>unseen</p><section class=discussion><h2>Discussion</h2><p>Results.</p></section></article>{talk}"),
        (1, "http://b/", f"<body><div class='article-header'><h1>Title</h1></div><div class=stuff><p>A text of several words, so that it is the body of the page.</p></div>{talk}</body>"),
        (2, "http://c/", f"<main><p>Text.</p>{talk}</main>"),
    ]
    found = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {0: "Title Some text. Discussion Results.", 1: "Title A text of several words, so that it is the body of the page.", 2: "Text."}
