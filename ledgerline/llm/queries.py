"""The ten registered queries, each applied to its whole table, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, exact_topk, html_crf, langid, packing, permutation_index, quality, secrets, simhash, toxicity
from ledgerline.llm.common import fold, table

TOXIC = 0.3


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(secrets.digest("base").cast("binary"), 256).alias("base_sha256"), secrets.digest("spans").alias("spans"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.filter(fold("doc_id", 4) != 2))
    scored = toxicity.score(docs, lexicon, id_cols=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def ratings(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 poor, 1 good but toxic, 2 good and clean; a null quality has no grade."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2 - F.coalesce(F.col("toxic"), F.lit(0)))
    return labels.select("doc_id", grade.cast("int").alias("grade"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, ratings(labels.filter(fold("doc_id", 4) != 1)))
    graded = quality.grade(docs, model, id_cols=["doc_id"])
    tail = F.coalesce(F.get("tails", F.lit(0)), (F.col("expected_grade") >= 1).cast("double"))
    return graded.select("doc_id", (fold("doc_id", 4) == 1).alias("held_out"), "expected_grade", tail.alias("p_good"), (tail >= 0.5).alias("selected"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.exact_topk(vectors, vectors.filter("vec_id % 20 = 0"), k=20, scale=64.0)


OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
), x AS (
  SELECT rid, vec_id, len(embedding) AS d, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM v
), ok AS (
  SELECT rid FROM x GROUP BY rid HAVING count(x) = max(d) AND bool_and(isfinite(coalesce(x, 0)))
), n AS (
  SELECT rid, vec_id, d, i, floor(64 * x) AS x FROM x WHERE rid IN (SELECT rid FROM ok)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, c.rid, q.rid AS qid, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM n q JOIN n c ON q.i = c.i AND q.d = c.d AND q.vec_id <> c.vec_id WHERE q.rid IN (SELECT min(rid) FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id, embedding) GROUP BY ALL
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(fold("doc_id", 5) != 0))
    named = langid.identify(docs, model, id_cols=["doc_id"])
    return named.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"), id_cols=["page_id", "url"])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_50k.json"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN, id_cols=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_secret_scan, op2_simhash, op3_toxicity, op4_quality, op5_exact_topk, op6_permutation_index, op7_language_id, op8_html_extraction, op9_packing, op10_byte_bpe)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_topk": OP5_SQL}
