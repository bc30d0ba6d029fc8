"""One query for each operator, over its whole table with production settings, and the SQL where SQL can say the same."""

from pyspark.sql import functions as F

from sentilake.llm import alignment, bpe, byte_cnn, decontamination, html_text, jaccard_join, lattice_dedup, packing, pii, quality_rules, quality_rules_sql, suffix_dedup, warc, whitening
from sentilake.llm.common import table

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_suffix_dedup(spark, d):
    """Repeated strings of 400 bytes; beside them the bytes of repeated passages of over 50 words, many of which are shorter."""
    return suffix_dedup.kept_texts(table(spark, d, "documents"), with_text=False, words=51, cut_words=False)


@query
def op2_best_fit_packing(spark, d):
    return packing.pack(table(spark, d, "documents"))


@query
def op9_bpe_codec(spark, d):
    return bpe.digests(bpe.encode(table(spark, d, "documents")))


@query
def op8_jaccard_join(spark, d):
    return jaccard_join.link_sets(table(spark, d, "documents"))


@query
def op4_quality_rules(spark, d):
    return quality_rules.assess(table(spark, d, "documents"))


ORACLES["op4_quality_rules"] = quality_rules_sql.ORACLE


@query
def op10_pii(spark, d):
    return pii.find(table(spark, d, "documents"))


@query
def op6_warc_archive(spark, d):
    return warc.archived(table(spark, d, "pages")).drop("payload", "url")


ORACLES["op6_warc_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, strlen(h)::BIGINT AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@query
def op3_html_text(spark, d):
    return html_text.main_text(table(spark, d, "pages"))


@query
def op5_lattice_dedup(spark, d):
    return lattice_dedup.link_vectors(table(spark, d, "embeddings"))


@query
def op7_byte_cnn(spark, d):
    return byte_cnn.classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op13_whitening(spark, d):
    white = whitening.whiten(table(spark, d, "embeddings"))
    return white.withColumn("deviation", white["deviation"].try_cast("long"))


@query
def op11_decontamination(spark, d):
    return decontamination.report(decontamination.passages(table(spark, d, "documents"), table(spark, d, "benchmark")))


WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op11_decontamination"] = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (SELECT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM
  (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM
  (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, m, item_id FROM grams JOIN windows USING (m, g)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.list, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op12_token_alignment(spark, d):
    aligned = alignment.align(table(spark, d, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return aligned.withColumn("groups_sha256", digest).drop("groups")
