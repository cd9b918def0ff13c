"""File sources and sinks: documents, export rows, corrections, calibration truth and models, summaries, reports, artifacts.

All go through Spark's readers and writers, so every store Spark can open works. Writers replace the target folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import path_key
from ledgerline.operators.routing import artifact_type

TRUE_WORDS = ("true", "1", "yes", "y")
CORRECTION = "invoice_id string, supplier_name string, original_total double, corrected_total double, original_confidence double, corrected_confidence double, raw_confidence double, candidate_index int, timestamp string, correction_type string"
POINTS = "supplier string, field string, x double, y double, weight bigint"
#: Columns an export must have to be read as invoices.
REQUIRED = ("invoice_id", "invoice_number", "supplier_name", "total_amount")


def keeper(folder: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a frame as a table of its own below ``folder`` (one that all executors share) and gives it back read."""
    numbers = itertools.count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/{next(numbers):04}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return keep


def scan_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modified, size of every matching file below ``folder``; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def index_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), kind, size and sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # Paths come back qualified by the store; the folder is qualified alike and cut off as a whole.
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")
    relative = F.substring("path", F.lit(len(root) + 2), F.length("path"))
    return files.select(relative.alias("path"), artifact_type(relative).alias("kind"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def merge_manifests(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of ``first`` and what ``second`` adds by path."""
    return first.unionByName(second.join(first.select("path"), "path", "left_anti"))


def cell_safe(df: DataFrame) -> DataFrame:
    """Time-zone-aware times as text, so that any sheet or CSV can hold them."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, t in df.dtypes if t == "timestamp"})


def write_export(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = (cell_safe(rows) if kind == "csv" else rows).write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.format(kind).save(path)


def read_export(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Export rows; a missing required column is an error that names it."""
    reader = spark.read.format(kind).option("header", "true")
    rows = (reader.schema(schema) if schema else reader).load(path)
    if missing := [c for c in REQUIRED if c not in rows.columns]:
        raise ValueError(f"export lacks {', '.join(missing)}")
    return rows


def write_batch_summary(batch: DataFrame, path: str) -> None:
    """One CSV of a batch's files, failures first, then by status and name."""
    rank = F.when(F.col("status") == "FAILED", 0).when(F.col("status") == "REVIEW", 1).when(F.col("status") == "PARTIAL", 2).otherwise(3)
    # One file by contract; a range of one partition sorts it where it is written, after the work above ran in parallel.
    batch.repartition(1).sortWithinPartitions(rank, "filename").write.mode("overwrite").option("header", "true").csv(path)


def write_reports(invoices: DataFrame, path: str) -> None:
    """One JSON object a row."""
    invoices.select(F.to_json(F.struct(*invoices.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Corrections from JSON lists; ``arrival`` follows the files' names, then the order within a file.

    Each file is read as one text, so the order does not depend on how files fall into partitions."""
    texts = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    listed = texts.select("file", F.posexplode(F.from_json("value", f"array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split() for c in CORRECTION.split(', ')))}>>")).alias("place", "c"))
    ranks = texts.select("file").distinct().agg(F.array_sort(F.collect_list("file")).alias("files"))
    numbered = listed.join(F.broadcast(ranks))  # one row: the files' names
    return numbered.select("c.*", (F.array_position("files", F.col("file")) * F.lit(2**32) + F.col("place")).alias("arrival"))


def truth_rows(raw: DataFrame, *, strict: bool) -> DataFrame:
    """raw_confidence and actual_correct from untyped columns. ``strict`` fails on a value outside 0..1; else such
    and unreadable rows are left out. Truth words are true, 1, yes and y; any other word is false."""
    value, word = F.col("raw_confidence").try_cast("double"), F.lower(F.trim(F.col("actual_correct").cast("string")))
    good = F.coalesce(value.between(0, 1), F.lit(False))
    more = [c for c in ("supplier", "field") if c in raw.columns]
    rows = raw.select(value.alias("raw_confidence"), word.isin(*TRUE_WORDS).alias("actual_correct"), *more, good.alias("_good"))
    if strict:
        return rows.select(F.when(F.col("_good"), F.col("raw_confidence")).otherwise(F.raise_error(F.lit("raw_confidence must lie between 0 and 1")).cast("double")).alias("raw_confidence"), "actual_correct", *more)
    return rows.filter("_good and actual_correct is not null").drop("_good")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Calibration truth from JSON lists (strict) or CSV with a header (bad rows are skipped)."""
    if path.rstrip("/").endswith(".json"):
        return truth_rows(spark.read.schema("raw_confidence double, actual_correct boolean, supplier string, field string").option("multiLine", "true").json(path), strict=True)
    if path.rstrip("/").endswith(".csv"):
        raw = spark.read.option("header", "true").csv(path)
        if not {"raw_confidence", "actual_correct"} <= set(raw.columns):
            raise ValueError("truth needs raw_confidence and actual_correct")
        return truth_rows(raw, strict=False)
    raise ValueError("truth must be .json or .csv")


def save_models(points: DataFrame, path: str) -> None:
    """Calibration points, a folder for each supplier and field."""
    keyed = points.withColumns({f"{c}_key": path_key(F.coalesce(c, F.lit("_"))) for c in ("supplier", "field")})
    keyed.write.mode("overwrite").partitionBy("supplier_key", "field_key").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{POINTS}, supplier_key string, field_key string").parquet(path).drop("supplier_key", "field_key")
