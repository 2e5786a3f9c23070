"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, bpe, counting, dedup, divergence, html, licenses, mixing, neardup, negatives, partenum, quality, warc
from .common import table


def op1_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


def op2_neighbours(spark, sf_dir):
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_exact_dedup(spark, sf_dir):
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_licenses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs.select("doc_id", licenses.document_path().alias("path"), "text"))


def op5_mixing(spark, sf_dir):
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source", "copies")


def op6_near_dedup(spark, sf_dir):
    return neardup.near_groups(table(spark, sf_dir, "documents"), weights="count")


def op7_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_html_text(spark, sf_dir):
    return html.main_texts(table(spark, sf_dir, "pages"))


def op9_quality(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark, sf_dir):
    return counting.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", negatives.relabelled()), F.col("vec_id") % 100 == 0)


def op12_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_jaccard(spark, sf_dir):
    return partenum.jaccard_components(table(spark, sf_dir, "documents"))


def queries():
    first = (op1_warc, op2_neighbours, op3_exact_dedup, op4_licenses, op5_mixing, op6_near_dedup, op7_bpe, op8_html_text, op9_quality, op10_token_counts)
    return {f.__name__: f for f in (*first, op11_hard_negatives, op12_divergence, op13_jaccard)}


SQL = {
    "op12_divergence": divergence.SQL,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, list_inner_product(a.x, o.x)::BIGINT AS score
            FROM v a JOIN v o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id AND len(a.x) = len(o.x)
        ), p AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
        QUALIFY row_number() OVER w <= 5""",
    "op13_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS x FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
        ), l AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
        ), r AS (
            SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a) m USING (doc_id)""",
    "op4_licenses": licenses.oracle_sql(),
    "op1_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS t FROM pages
        ), d AS (
            SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS payload_digest, max(page_id) OVER (PARTITION BY t) AS last FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to,
               '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS record_id,
               true AS verified
        FROM (SELECT *, md5('page:' || page_id) AS h FROM d)""",
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)""",
}
