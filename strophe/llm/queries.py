"""The operators bound to the tables they are meant for, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import ann, bayes, boosting, decontam, negatives, ordinal, packing, pii, repeats, secrets, simhash, spelling, vbyte
from strophe.llm.common import table

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_collision_counting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return boosting.score(docs, boosting.train(docs, table(spark, sf_dir, "labels")))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_VOCABULARY)
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), path, "words", end_id=1))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, max_distance=4)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.score(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"), length=400)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_VOCABULARY)
    files = vbyte.write(table(spark, sf_dir, "documents"), path, "bytes", end_id=0)
    return vbyte.digest(vbyte.read(spark, files))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted(table(spark, sf_dir, "documents"), least=7, often=2, every=31), ratio=10)


def op12_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.near_duplicates(table(spark, sf_dir, "documents"), words=2, similarity=0.8)


def op13_pivot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), negatives.whole(F.col("embedding")).alias("vector"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, k=5, low=80, high=100)


OPERATORS = (
    op1_collision_counting_ann, op2_quality_classifier, op3_template_decontamination, op4_best_fit_packing, op5_simhash_near_dedup, op6_toxicity, op7_secret_scan, op8_suffix_array_dedup,
    op9_token_files, op10_personal_data, op11_spelling_variants, op12_bayesian_minhash, op13_pivot_hard_negatives,
)
QUERIES = {f.__name__: f for f in OPERATORS}

#: One set a text, links by the shared runs of its pairs, components by following links.
NEAR_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
sets AS (SELECT min(doc_id) AS node, list_sort(s) AS s FROM s GROUP BY 2 HAVING len(list_sort(s)) > 0),
each AS (SELECT node, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.node AS u, b.node AS v, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m FROM each a JOIN each b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT u, v FROM shared WHERE 100 * common >= 80 * (n + m - common)),
ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(node, root) AS (SELECT u, u FROM ways UNION SELECT reach.node, ways.v FROM reach JOIN ways ON reach.root = ways.u),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(roots.root, sets.node, s.doc_id) AS component_id, s.doc_id = coalesce(roots.root, sets.node, s.doc_id) AS kept
FROM s LEFT JOIN sets ON list_sort(s.s) = sets.s LEFT JOIN roots ON roots.node = sets.node"""

NEGATIVES_SQL = """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""

ORACLE_SQL: dict[str, str] = {"op12_bayesian_minhash": NEAR_SQL, "op13_pivot_hard_negatives": NEGATIVES_SQL}
