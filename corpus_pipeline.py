"""Corpus pipeline over ``documents``: drop toxic texts, drop texts of no language, keep one of each
group of near duplicates, redact secrets, pack into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return
the columns of ``documents``. The near-duplicate stage groups rows by their texts alone, whether ids
repeat or are null, and keeps one row of each group: that of the smallest id, null ids last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import langid, packing, secrets, simhash, toxicity
from ledgerline.llm.common import cut, fold, fresh, merged, table

#: A text whose best language scores below this is rejected, and so is one without letters.
LEAST_LANGUAGE_SCORE = 0.2


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    score = fresh(docs, "score")
    scored = toxicity.score(docs, toxicity.learn(docs, labels), id_cols=docs.columns, score_col=score)
    return scored.filter(F.col(score) < 0.3).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs.filter(fold("doc_id", 5) != 0))
    named, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = langid.identify(docs, model, id_cols=docs.columns, lang_col=named, score_col=score)
    return found.filter((F.col(named) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The key settles the row by its values alone, so it is the same in every scan; rows of one key are exact copies.
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text").isNull().alias("empty"), F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c"))
    own, kept = fresh(docs, "_key"), fresh(docs, "_keep")
    keyed = docs.withColumn(own, key)
    groups = simhash.near_duplicates(keyed.select(F.col(own).alias("_key"), "text"), id_col="_key")
    keep = groups.filter(F.col("_key") == F.col("component_id")).select(F.col("_key").alias(kept)).distinct()
    return keyed.join(merged(keep), F.col(own) == F.col(kept), "left_semi").dropDuplicates([own]).select(docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, chars_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, path=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Learned scores, XXH64 and tokenisers have no SQL form; tests/llm holds each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
