"""The registered queries of this subpackage: thin digests over the operators, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from genoloom.llm import ann, bpe, embed_dedup, license_scan, ngram_join, packing, ranked_search, secret_scan, sharding, spelling, suffix_dedup, token_file, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_dup_embeddings(_table(spark, sf_dir, "embeddings"))


def op2_small_world_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.nearest(rows.filter("vec_id % 20 = 0"), rows)


def op3_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.left_texts(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True
    )


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_file.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_file.read_tokens(files, digest=True).withColumnRenamed("id", "doc_id")


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op9_factor_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.learn_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op11_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shuffle(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cover_tree_dedup, op2_small_world_search, op3_length_packing, op4_suffix_dedup, op5_byte_bpe,
        op6_token_file, op7_license_rules, op8_ngram_join, op9_factor_toxicity, op10_secret_forest,
        op11_bag_search, op12_spelling_variants, op13_hypergeometric_shards,
    )
}

#: The vectors' labels are equal or not linked, so the SQL compares within labels only.
_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach(src, dst) AS (
  SELECT src, dst FROM links UNION SELECT r.src, l.dst FROM reach r JOIN links l ON r.dst = l.src
)
SELECT v.vec_id, coalesce(n.c, 0) AS n_links, least(v.vec_id, coalesce(r.m, v.vec_id)) AS component_id,
  v.vec_id <= coalesce(r.m, v.vec_id) AS kept
FROM v LEFT JOIN (SELECT src, count(*) AS c FROM links GROUP BY src) n ON n.src = v.vec_id
LEFT JOIN (SELECT src, min(dst) AS m FROM reach GROUP BY src) r ON r.src = v.vec_id
"""

#: All pairs that share a shingle, counted; exact, for tables of modest size.
_OP8 = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM t WHERE len(w) > 0) x
), n AS (
  SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT src, dst, k = x.c AND k = y.c AS same FROM p JOIN n x ON x.doc_id = src JOIN n y ON y.doc_id = dst
  WHERE CAST(k AS DOUBLE) / (x.c + y.c - k) >= 0.8
), comp AS (
  SELECT src, min(dst) AS m FROM (
    WITH RECURSIVE reach(src, dst) AS (
      SELECT src, dst FROM links UNION SELECT r.src, l.dst FROM reach r JOIN links l ON r.dst = l.src)
    SELECT * FROM reach) z GROUP BY src
)
SELECT t.doc_id, least(t.doc_id, coalesce(l.c, t.doc_id)) AS class_id, coalesce(l.n, 0) AS n_links,
  least(t.doc_id, coalesce(comp.m, t.doc_id)) AS component_id, t.doc_id <= coalesce(comp.m, t.doc_id) AS kept
FROM t LEFT JOIN (SELECT src, count(*) AS n, min(dst) FILTER (same) AS c FROM links GROUP BY src) l ON l.src = t.doc_id
LEFT JOIN comp ON comp.src = t.doc_id
"""

ORACLES: dict[str, str] = {
    "op1_cover_tree_dedup": _OP1, "op7_license_rules": license_scan.scan_sql(), "op8_ngram_join": _OP8,
    "op11_bag_search": ranked_search.SEARCH_SQL, "op12_spelling_variants": spelling.VARIANTS_SQL,
}
