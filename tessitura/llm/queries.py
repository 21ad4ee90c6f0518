"""The registered queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, language_id, mixing, quality, sharding, simhash, substring, warc

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), sharding.PRODUCTION)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out(docs)))
    found = language_id.identify(docs, model, with_spans=False)
    return found.select("doc_id", language_id.held_out(found).alias("held_out"), "lang_pred", "score")


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), with_ids=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    f.__name__: f
    for f in (op1_hash_tree_shards, op2_language_id, op3_simhash_golay, op4_warc_round_trip, op5_byte_bpe, op6_substring_dedup, op7_exact_dedup, op8_kneser_ney_quality, op9_embedding_dedup, op10_entropy_mixing)
}

_WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages
), o AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h, n) ELSE page_id END AS first FROM p
)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM o
"""

_SUBSTRING = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), least_doc AS (
  SELECT s, min(doc_id) AS m FROM win GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM win JOIN least_doc USING (s) WHERE doc_id > m)
), word AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_EMBEDDING = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), root AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM root LEFT JOIN n USING (vec_id)
"""


def _mixing_sql() -> str:
    """SQL of op10: the rates are target over words, which is where Newton's steps end."""
    parts = [
        r"""
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS tie FROM documents
), s0 AS (
  SELECT source, sum(size)::DOUBLE AS total FROM d GROUP BY source
), s1 AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0 * total AS lim FROM s0
), s2 AS (
  SELECT *, lim / weight AS ratio, 1.5 * sum(total) OVER () - coalesce(sum(lim) OVER up, 0) AS o, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS r
  FROM s1 WINDOW up AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s AS (
  SELECT source, total::BIGINT AS source_size, least(lim, coalesce(max(CASE WHEN o / r <= ratio THEN o / r END) OVER () * weight, lim)) AS target FROM s2
), got0 AS (
  SELECT NULL::VARCHAR AS source, 0::BIGINT AS got WHERE false
)""".replace(" COLLATE C", "")
    ]
    below = None
    for k, least in enumerate(mixing.CLASSES, 1):
        upper = "true" if below is None else f"size < {below}"
        parts.append(f"""
p{k} AS (
  SELECT s.source, greatest(0, least(2, (target - coalesce(g.got, 0)) / w.words)) AS rate
  FROM s JOIN (SELECT source, sum(size)::DOUBLE AS words FROM d WHERE size >= 1 AND {upper} GROUP BY source) w ON s.source IS NOT DISTINCT FROM w.source
  LEFT JOIN (SELECT source, sum(got) AS got FROM got{k - 1} GROUP BY source) g ON s.source IS NOT DISTINCT FROM g.source
), c{k} AS (
  SELECT doc_id, size, d.source, rate, row_number() OVER (PARTITION BY d.source
    ORDER BY length(bin(size)) DESC, size >> greatest(length(bin(size)) - 5, 0) DESC, ('0x' || tie[1:4])::INT % 64, size DESC, tie) - 1 AS k
  FROM d JOIN p{k} ON d.source IS NOT DISTINCT FROM p{k}.source WHERE size >= {max(least, 1)} AND {upper}
), t{k} AS (
  SELECT doc_id, size, source, (floor(rate * (k + 1) + {mixing.PHASE}) - floor(rate * k + {mixing.PHASE}))::BIGINT * size AS taken FROM c{k}
), got{k} AS (
  SELECT * FROM got{k - 1} UNION ALL SELECT source, sum(taken)::BIGINT FROM t{k} GROUP BY source
)""")
        below = least
    every = " UNION ALL ".join([f"SELECT * FROM t{k}" for k in range(1, len(mixing.CLASSES) + 1)] + ["SELECT doc_id, size, source, 0 FROM d WHERE size = 0"])
    return "WITH " + ",".join(parts) + f" SELECT doc_id, size, source_size, target, taken FROM ({every}) t JOIN s ON s.source IS NOT DISTINCT FROM t.source"


ORACLES = {
    "op4_warc_round_trip": _WARC,
    "op6_substring_dedup": _SUBSTRING,
    "op7_exact_dedup": _EXACT,
    "op9_embedding_dedup": _EMBEDDING,
    "op10_entropy_mixing": _mixing_sql(),
}
