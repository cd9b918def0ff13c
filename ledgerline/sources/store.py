"""Stores of invoices, corrections and patterns as frames: appending, reading in order, importing, maintaining.

A store is a Parquet folder. Writers put the new rows beside the old ones or replace the folder by way of a second one, so
a reader never sees half a store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import learning
from ledgerline.sources import files

PATTERN = (
    "pattern_id long, supplier_name string, layout_hash string, position_x double, position_y double, position_width double, position_height double, correct_total double, "
    "confidence_boost double, usage_count int, last_used timestamp, created_at timestamp"
)
#: Columns of a pattern that an update may set.
UPDATABLE = ("usage_count", "last_used", "confidence_boost", "position_x", "position_y", "position_width", "position_height")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def append(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store with the rows added; columns that one side lacks are NULL there."""
    return store.unionByName(rows, allowMissingColumns=True)


def clear(store: DataFrame) -> DataFrame:
    return store.limit(0)


def create(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The store at ``path``, made empty where there is none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        empty(spark, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def add(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """Write beside the store, then put the new folder in its place."""
    spark = rows.sparkSession
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{path}.new could not take the place of {path}")


def load_invoices(rows: DataFrame) -> DataFrame:
    """Export rows as invoices: invoice_id (else the number), attributes of the first line, lines in order. A row needs ``invoice_id``,
    ``invoice_number`` and ``line_number``; rows with neither key are one invoice without a key each number."""
    key = F.coalesce(F.nullif(F.col("invoice_id").cast("string"), F.lit("")), F.col("invoice_number"))
    facts = [c for c in rows.columns if c not in ("invoice_id", "line_number", "description", "quantity", "unit", "unit_price", "discount", "line_total")]
    lines = [c for c in ("line_number", "description", "quantity", "unit", "unit_price", "discount", "line_total") if c in rows.columns]
    first = F.min_by(F.struct(*facts), "line_number")
    out = rows.groupBy(key.alias("invoice_key")).agg(first.alias("_f"), F.array_sort(F.collect_list(F.struct(*lines))).alias("lines"))
    return out.select("invoice_key", "_f.*", "lines", F.size("lines").alias("n_lines"))


def corrections_of(corrections: DataFrame, supplier: str | None = None) -> DataFrame:
    """Corrections, of one supplier where given, newest first; equal times by invoice."""
    kept = corrections if supplier is None else corrections.filter(F.col("supplier_name") == supplier)
    return kept.orderBy(F.desc("timestamp"), "invoice_id")


def patterns_of(patterns: DataFrame, supplier: str | None = None) -> DataFrame:
    """Patterns, of one supplier where given, by use, then by last use; equal ones by id."""
    kept = patterns if supplier is None else patterns.filter(F.col("supplier_name") == supplier)
    return kept.orderBy(F.desc("usage_count"), F.desc("last_used"), "pattern_id")


def new_patterns(patterns: DataFrame, store: DataFrame, now: Column) -> DataFrame:
    """Rows ready to be added to ``store``: ids that follow its largest, boost 0.1, one use, now as times where they lack. A pattern
    without supplier or total is an error."""
    for c in ("supplier_name", "correct_total"):
        if c not in patterns.columns:
            raise ValueError(f"missing required field: {c}")
    defaults = {"confidence_boost": F.lit(0.1), "usage_count": F.lit(1), "last_used": now, "created_at": now}
    filled = patterns.withColumns({c: F.coalesce(F.col(c), v) if c in patterns.columns else v for c, v in defaults.items()})
    # Ids grow with the partition and the row in it: unique without a shuffle, with gaps.
    last = store.agg(F.coalesce(F.max("pattern_id"), F.lit(0)).alias("_last"))
    numbered = filled.withColumn("_n", F.monotonically_increasing_id()).join(F.broadcast(last))  # one row
    return empty(patterns.sparkSession, PATTERN).unionByName(numbered.withColumn("pattern_id", F.col("_last") + F.col("_n") + 1).drop("_n", "_last"), allowMissingColumns=True).select(*[f.split()[0] for f in PATTERN.split(", ")])


def update_patterns(patterns: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """The patterns with ``changes`` where ``condition`` holds; columns that may not be set are passed over."""
    return learning.update_where(patterns, condition, {c: v for c, v in changes.items() if c in UPDATABLE})


def correction(invoices: DataFrame, choices: DataFrame, now: Column) -> DataFrame:
    """Corrections from a reader's choices (invoice_id, candidate_index from 0, raw_confidence) among the invoices' ``candidates``
    (array of struct(amount, score)). An index beyond them is no correction; an invoice without supplier has 'Unknown'."""
    picked = F.get("candidates", F.col("candidate_index"))
    joined = invoices.join(choices, "invoice_id").withColumn("_p", picked).filter("_p is not null")
    supplier = F.coalesce(F.nullif(F.col("supplier_name"), F.lit("")), F.lit("Unknown"))
    return joined.select(
        F.col("invoice_id").cast("string").alias("invoice_id"), supplier.alias("supplier_name"), F.col("total_amount").cast("double").alias("original_total"), F.col("_p.amount").cast("double").alias("corrected_total"),
        F.col("total_confidence").cast("double").alias("original_confidence"), F.coalesce(F.col("_p.score"), F.lit(0.0)).alias("corrected_confidence"), "raw_confidence", "candidate_index", now.cast("string").alias("timestamp"), F.lit("total_amount").alias("correction_type"),
    )


def import_corrections(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """All records of a JSON list, repeated ones too, with defaults for what lacks; records that are no objects are passed over."""
    read = files.read_corrections(spark, path).filter(F.coalesce(*[F.col(c).isNotNull() for c in ("invoice_id",)], F.lit(False)) | F.col("corrected_total").isNotNull() | F.col("supplier_name").isNotNull())
    return read.fillna({"invoice_id": "", "supplier_name": "Unknown", "correction_type": "total_amount"}).withColumn("timestamp", F.coalesce("timestamp", now.cast("string")))


def learn(corrections: DataFrame, patterns: DataFrame, now: Column) -> DataFrame:
    """The pattern store with the patterns of ``corrections`` added."""
    found = learning.extract_patterns(corrections).withColumnRenamed("corrected_total", "correct_total")
    return patterns.unionByName(new_patterns(found, patterns, now))


def maintain(patterns: DataFrame, now: Column, *, consolidate: bool = True, clean: bool = True, max_age_days: int = 90, min_usage: int = 1) -> DataFrame:
    """The store after upkeep: patterns that lie together merged into their leader, old and unused ones out, conflicts always out."""
    kept = patterns
    if consolidate:
        merged = learning.consolidate(kept).select("pattern_id", F.col("usage_count").alias("_u"), F.col("last_used").alias("_t"))
        kept = kept.join(merged, "pattern_id").withColumns({"usage_count": F.col("_u").cast("int"), "last_used": F.col("_t")}).drop("_u", "_t")
    if clean:
        kept = learning.clean_up(kept, now, max_age_days=max_age_days, min_usage=min_usage).filter("kept").drop("kept")
    return learning.without_conflicts(kept)
