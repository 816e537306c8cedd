"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embed_dedup, katz, langid, mixing, ngram_join, packing, quality, suffix_dedup, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_read(spark, sf_dir, "documents"))


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(_read(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


#: Shares of the mixture; leaves without one keep their natural share of what their parent gets.
TARGETS = {("web",): 0.5, ("books",): 0.3, ("forums",): 0.2, ("web", "en"): 0.5, ("books", "en"): 0.6, ("forums", "en"): 0.6}


def op10_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_read(spark, sf_dir, "documents"), mixing.Mix(TARGETS, budget_fraction=0.8, max_epochs=2))
    return out.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("copies"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_graph_search": op1_graph_search,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_embedding_near_dedup": op3_embedding_near_dedup,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_katz_scores": op5_katz_scores,
        "op7_language_id": op7_language_id,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op10_hierarchical_mix": op10_hierarchical_mix,
    }


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
    both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT count(*) FROM both_ways WHERE both_ways.x = d.doc_id)::BIGINT AS n_links, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)"""

_OP3 = """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM v WHERE list_dot_product(v, v) > 0),
    e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
    reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
    c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
    SELECT vec_id, (SELECT count(*) FROM e WHERE e.x = c.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c"""

_OP4 = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
    w AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(1, n - 98)) AS i FROM d WHERE n >= 100)),
    m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
    g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM m),
    r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
    x AS (SELECT doc_id, min(i) AS lo, max(i) + 99 AS hi FROM r GROUP BY doc_id, run),
    cuts AS (SELECT doc_id, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi, sum(hi - lo + 1)::BIGINT AS removed, count(*)::BIGINT AS spans FROM x GROUP BY doc_id),
    kept AS (SELECT d.doc_id, n, coalesce(removed, 0) AS removed, coalesce(spans, 0) AS spans, CASE WHEN lo IS NULL THEN h
        ELSE array_to_string(list_transform(range(1, len(lo) + 2), lambda j: substr(h, CASE WHEN j = 1 THEN 1 ELSE 2 * hi[j - 1] + 1 END, CASE WHEN j > len(lo) THEN 2 * n ELSE 2 * (lo[j] - 1) END - CASE WHEN j = 1 THEN 0 ELSE 2 * hi[j - 1] END)), '') END AS rest FROM d LEFT JOIN cuts USING (doc_id))
    SELECT doc_id, n AS n_bytes, removed::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": _OP2, "op3_embedding_near_dedup": _OP3, "op4_suffix_dedup": _OP4}
