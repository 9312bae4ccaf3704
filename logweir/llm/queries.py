"""Queries opN_<name>: each operator over its whole table, with its production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import best_fit, packing, secrets
from .common import table
from .decontam import Decontaminator
from .embed_dup import EmbeddingNeighbours
from .licenses import notices
from .near_dup import NearDuplicates
from .quality import quality
from .token_count import token_counts
from .toxicity import toxicity


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from preferences between labelled ones."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_qgram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    return Decontaminator().find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id rows of all documents, best fit decreasing."""
    return best_fit.digest(best_fit.pack_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op4_paragraph_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    return notices(table(spark, sf_dir, "documents"))


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups over 3-word shingles at a similarity of 0.85 or more."""
    return NearDuplicates(k=3, percent=85).groups(table(spark, sf_dir, "documents"))


def op6_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, in order."""
    return packing.pieces(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op7_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_zstd_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by noisy-or over its sentences."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings of a label at a cosine of 0.93 or more."""
    return EmbeddingNeighbours().links(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_bradley_terry, op2_qgram, op3_best_fit, op4_paragraph_classifier, op5_superminhash, op6_dp_packing, op7_resync, op8_zstd_novelty, op9_noisy_or, op10_nn_descent)}


COMPONENTS = """e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
 r(node, reach) AS (SELECT id, id FROM ids UNION SELECT r.node, e.j FROM r JOIN e ON e.i = r.reach),
 c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)"""

SHINGLES_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d),
 x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
 p AS (SELECT a.doc_id AS i, b.doc_id AS j, a.n AS na, b.n AS nb, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT i, j FROM p WHERE 100 * common >= 85 * (na + nb - common)), ids AS (SELECT doc_id AS id FROM documents), {COMPONENTS}
 SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept FROM s JOIN c ON node = doc_id"""

COSINE_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 n AS (SELECT *, sqrt(list_dot_product(x, x)) AS len FROM v WHERE label IS NOT NULL AND x IS NOT NULL),
 l AS (SELECT a.id AS i, b.id AS j FROM n a JOIN n b ON a.label = b.label AND a.id < b.id AND a.len > 0 AND b.len > 0
 AND list_dot_product(a.x, b.x) / (a.len * b.len) >= 0.93), ids AS (SELECT id FROM v), {COMPONENTS},
 k AS (SELECT i, count(*) AS n_links FROM e GROUP BY i)
 SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = id AS kept FROM v JOIN c ON node = id LEFT JOIN k ON i = id"""


def oracle_sql() -> dict[str, str]:
    return {"op5_superminhash": SHINGLES_SQL, "op10_nn_descent": COSINE_SQL}
