"""Registered queries of the corpus operators, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import alignment, bestfit, html, licenses, mixing, negatives, packing, pii, quality, simhash, tokens, toxicity, vectors
from loomwright.plans.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
    "op2_mix_sources": lambda s, d: mixing.mix_report(table(s, d, "documents")),
    "op3_nearest_vectors": lambda s, d: vectors.nearest(table(s, d, "embeddings"), F.col("vec_id") % 20 == 0),
    "op4_license_scan": lambda s, d: licenses.scan(table(s, d, "documents")),
    "op5_personal_data": lambda s, d: pii.personal_data(table(s, d, "documents")),
    "op6_quality_cascade": lambda s, d: quality.report(table(s, d, "documents")),
    "op7_pack_sequences": lambda s, d: packing.pieces(table(s, d, "documents")),
    "op8_main_text": lambda s, d: html.main_text(table(s, d, "pages")),
    "op9_toxicity": lambda s, d: toxicity.toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op10_token_counts": lambda s, d: tokens.counts(table(s, d, "documents")),
    "op11_best_fit_packing": lambda s, d: bestfit.pieces(table(s, d, "documents")),
    "op12_hard_negatives": lambda s, d: negatives.mined(table(s, d, "embeddings")),
    "op13_token_alignment": lambda s, d: alignment.alignment(table(s, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
w AS (SELECT *, (CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM o),
p AS (SELECT *, coalesce(sum(cap) OVER b, 0::DOUBLE) AS cut, sum(w) OVER () - coalesce(sum(w) OVER b, 0::DOUBLE) AS w_left, sum(source_size) OVER ()::DOUBLE AS total
  FROM w WINDOW b AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - cut) / w_left AS level FROM p),
f AS (SELECT level AS level0 FROM l WHERE level * w <= cap ORDER BY cap / w, i LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN level * w > cap THEN cap ELSE (SELECT level0 FROM f) * w END AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '?')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""",
    "op3_nearest_vectors": r"""
WITH v AS (SELECT vec_id, max(embedding::DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op6_quality_cascade": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 5)),
p AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM p) GROUP BY rid),
m AS (SELECT w.rid, doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c ON w.rid = c.rid),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  10 * n_symbols > 3 * n_words OR (n_dup_lines > 0 AND 2 * n_dup_lines >= len(string_split(t, chr(10)))) OR word_chars > 25 * n_words OR word_chars < 2 * n_words
  OR 2 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < word_chars OR 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > word_chars AS more FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT more AS kept FROM v
""",
    "op12_hard_negatives": r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END DESC, embedding DESC) = 1),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)::INTEGER AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score QUALIFY rank <= 5
""",
}
