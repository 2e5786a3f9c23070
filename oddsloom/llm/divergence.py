"""Source divergence audit: which terms set a source apart from its language, and how far sources are from each other.

Counts of terms are kept as postings (language, source, term, count).  With p = 1 + floor(10^9 (count + 1) / (N + V)), the
divergence of a term is f = floor((p - q)^2 / q) where p is a source's and q another distribution's.

* Terms: in a source, p depends on the count alone, so terms fall into buckets of equal count, and f falls as q
  grows towards p.  The least language probability of a bucket bounds f for all its terms.  Buckets are evaluated
  best bound first, in rounds of growing budgets; a source is done when every bucket that is left has a bound
  strictly below the k-th value found.
* Pairs: a term that neither source has gives the same f for all, and a term that one has gives an f that depends on
  its count, so those sums come from the sizes of buckets.  Only terms that both have are met, by a join of
  postings on the term.

Integers only: p is made in two steps that stay within 64 bits up to 9 * 10^13 words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidied

#: Documents of a language that have a term, at least; and ranks of terms.
LEAST_DOCS, RANKS = 3, 200
#: The budget of terms of a source grows by this factor in each round.
GROWTH = 8
#: Distinct entries that a task holds before it hands them on, and bytes of a text that are cut at once.
HELD, PIECE = 400_000, 1 << 20
_POSTING = "lang string, source string, term string, n long, docs long"
#: Bytes of terms in lower case; all others become blanks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: bytes) -> Counter:
    """The terms of a text with their counts, cut in pieces so that a very long text is never a list of words as a whole."""
    text = text.translate(_TERMS)
    if len(text) <= PIECE:
        return Counter(text.split())
    found, at = Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of a task, added up before they are shuffled."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def flush():
        rows = [(lang, source, term.decode("utf-8", "replace"), n, docs[term]) for (lang, source), (counts, docs) in groups.items() for term, n in counts.items()]
        groups.clear()
        for a in range(0, len(rows), 50_000):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 50_000], strict=True), kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in tidied(batches):
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(counts)
            found = _terms(text)
            counts.update(found)
            docs.update(dict.fromkeys(found, 1))
            held += len(counts)
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def postings(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: how often the documents of a source have a term, and how many do."""
    plain = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(_counted, _POSTING).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, size: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / size), in two steps of 10^5 and 10^4."""
    first = (n + 1) * 100_000
    high = F.call_function("div", first, size)
    return 1 + high * 10_000 + F.call_function("div", (first - high * size) * 10_000, size)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _best_terms(kept: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """lang, source, item, value of at least the ``ranks`` first terms of each source, best-first over buckets of counts.

    ``kept`` has lang, source, term, p and q.
    """
    key = ["lang", "source"]
    buckets = kept.groupBy(*key, "p").agg(F.count("*").alias("n"), F.min("q").alias("least"))
    buckets = stored(buckets.where("p > least").select(*key, "p", "n", divergence(F.col("p"), F.col("least")).alias("bound")), "divergence-buckets")
    first = Window.partitionBy(*key).orderBy(F.desc("bound"), "p").rowsBetween(Window.unboundedPreceding, -1)
    # Terms in buckets that come before a bucket; one row for each distinct count of a source.
    ordered = stored(buckets.withColumn("before", F.coalesce(F.sum("n").over(first), F.lit(0))), "divergence-order")
    found, done, budget = None, 0, ranks
    kth = groups.select(*key).withColumn("kth", F.lit(-1).cast("long"))
    while True:
        open_ = ordered.join(kth, key).where((F.col("before") >= done) & (F.col("bound") >= F.col("kth")))
        now = stored(open_.where(F.col("before") < budget).select(*key, "p"), "divergence-round")
        rest = open_.where(F.col("before") >= budget)
        values = kept.join(now, [*key, "p"]).where("p > q").select(*key, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        values = values.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "item"))).where(F.col("r") <= ranks).drop("r")
        values = stored(values, "divergence-values")
        found = values if found is None else found.unionByName(values)
        if rest.isEmpty():
            return found
        ranked = found.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "item"))).where(F.col("r") <= ranks)
        counted = ranked.groupBy(*key).agg(F.count("*").alias("n"), F.min("value").alias("least"))
        known = counted.select(*key, F.when(F.col("n") == ranks, F.col("least")).otherwise(-1).cast("long").alias("kth"))
        kth = stored(groups.select(*key).join(known, key, "left").select(*key, F.coalesce("kth", F.lit(-1).cast("long")).alias("kth")), "divergence-kth")
        done, budget = budget, budget * GROWTH


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the divergence of every source from every other one of its language."""
    zero = probability(F.lit(0).cast("long"), F.col("size"))
    side = groups.select("lang", "source", "v", F.when(F.col("v") > 0, zero).alias("zero"))
    of = lambda x, df, *c: df.select("lang", *(F.col(y).alias(f"{x}_{y}") for y in ("source", *c)))
    both = of("a", side, "v", "zero").join(of("b", side, "zero"), "lang").where("a_source <> b_source")
    both = stored(both, "divergence-groups")
    # Terms of one source against the other's probability of an unseen term; a bucket's terms share their f.
    sizes = stored(kept.groupBy("lang", "source", "p").agg(F.count("*").alias("n")), "divergence-sizes")
    neither = divergence(F.col("a_zero"), F.col("b_zero"))
    ours = of("a", sizes, "p", "n").join(both, ["lang", "a_source"]).groupBy("lang", "a_source", "b_source").agg(F.sum(F.col("a_n") * (divergence(F.col("a_p"), F.col("b_zero")) - neither)).alias("ours"))
    theirs = of("b", sizes, "p", "n").join(both, ["lang", "b_source"]).groupBy("lang", "a_source", "b_source").agg(F.sum(F.col("b_n") * (divergence(F.col("a_zero"), F.col("b_p")) - neither)).alias("theirs"))
    # Terms that both have, less what the sums above say of them.
    rows = kept.select("lang", "source", "term", "p", "zero")
    term = lambda x: rows.select("lang", "term", *(F.col(y).alias(f"{x}_{y}") for y in ("source", "p", "zero")))
    met = term("a").join(term("b"), ["lang", "term"]).where("a_source <> b_source")
    more = divergence(F.col("a_p"), F.col("b_p")) - divergence(F.col("a_p"), F.col("b_zero")) - divergence(F.col("a_zero"), F.col("b_p")) + neither
    shared = met.groupBy("lang", "a_source", "b_source").agg(F.sum(more).alias("shared"))
    keys = ["lang", "a_source", "b_source"]
    out = both.join(ours, keys, "left").join(theirs, keys, "left").join(shared, keys, "left")
    none = F.lit(0).cast("long")
    value = F.coalesce(F.col("a_v") * neither + F.coalesce("ours", none) + F.coalesce("theirs", none) + F.coalesce("shared", none), none)
    return out.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), value.alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """How the sources of ``docs`` (text, lang, source) differ: lang, source, part, item, value and rank.

    Terms are runs of ASCII letters, in lower case, and of characters beyond ASCII; a language keeps those that at
    least ``least_docs`` of its documents have.  Part "pair" has a row for each other source of the language, part
    "term" the first ``ranks`` terms that the source has more often than its language, by their divergence; ranks
    go by value, ties by the bytes of the item.

    Null texts, languages and sources count as empty ones.  A source without kept terms still has its pairs; in a
    language without kept terms their value is 0.  Very long texts are counted in pieces, and whole.  Repeated
    rows count as often as they are there.  An empty table gives an empty result; columns besides these three are
    ignored.
    """
    everything = stored(postings(docs), "divergence-postings")
    lang_terms = everything.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    lang_terms = stored(lang_terms, "divergence-terms")
    counts = stored(everything.drop("docs").join(lang_terms, ["lang", "term"]), "divergence-kept")
    names = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = lang_terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_n"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    none = F.lit(0).cast("long")
    groups = names.join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("v", none).alias("v"), (F.coalesce("n", none) + F.coalesce("v", none)).alias("size"), (F.coalesce("lang_n", none) + F.coalesce("v", none)).alias("lang_size"))
    groups = stored(groups, "divergence-sources")
    kept = counts.join(groups.drop("v"), ["lang", "source"])
    kept = kept.select("lang", "source", "term", probability(F.col("n"), F.col("size")).alias("p"), probability(F.col("lang_n"), F.col("lang_size")).alias("q"), probability(F.lit(0).cast("long"), F.col("size")).alias("zero"))
    kept = stored(kept, "divergence-postings-kept")

    parts = _pairs(kept, groups).withColumn("part", F.lit("pair")), _best_terms(kept, groups, ranks).withColumn("part", F.lit("term"))
    ranked = [x.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")) for x in parts]
    out = ranked[0].unionByName(ranked[1].where(F.col("rank") <= ranks))
    return out.select("lang", "source", "part", "item", "value", "rank")



_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, {_ASCII}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    lt AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
    v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM lt GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN lt USING (lang, term) GROUP BY ALL),
    gn AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (SELECT g.lang, g.source, lt.term, coalesce(c.n, 0) AS n,
                 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + v.v)::HUGEINT AS p,
                 1 + (1000000000::HUGEINT * (lt.n + 1)) // (v.n + v.v)::HUGEINT AS q
          FROM g JOIN gn USING (lang, source) JOIN v USING (lang) JOIN lt USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = lt.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    allpairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
    terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM allpairs
    UNION ALL
    SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= 200"""
