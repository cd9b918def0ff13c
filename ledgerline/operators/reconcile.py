"""Reconciliation of invoice headers with their lines, line checks, status and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import discount_amount, discount_kind

GATE = 0.95


def line_sums(headers: DataFrame, lines: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Headers with lines_sum, n_lines, avg_rows, max_rows; lines are summed before the join, and headers without lines stay."""
    rows = F.col("n_rows") if "n_rows" in lines.columns else F.lit(1)
    sums = lines.groupBy(key).agg(F.sum(F.coalesce("line_total", F.lit(0).cast("decimal(18,2)"))).cast("decimal(28,2)").alias("lines_sum"), F.count(F.lit(1)).alias("n_lines"), F.sum(rows).alias("n_rows_all"), F.max(rows).alias("max_rows"))
    return headers.join(sums, key, "left").withColumns({"lines_sum": F.coalesce("lines_sum", F.lit(0)).cast("decimal(28,2)"), "n_lines": F.coalesce("n_lines", F.lit(0))})


def difference() -> Column:
    return (F.col("header_total") - F.col("lines_sum")).cast("decimal(28,2)")


def flat_pass(diff: Column, tolerance: float = 1.0) -> Column:
    """Within a flat tolerance; false without a total."""
    return F.coalesce(F.abs(diff) <= F.lit(tolerance).cast("decimal(18,2)"), F.lit(False))


def scaled_pass(total: Column, diff: Column) -> Column:
    """Within 1.00, or 0.5 % of a total above 1000."""
    bound = F.when(total > 1000, F.greatest(F.lit(1).cast("decimal(28,4)"), (total * F.lit(0.005).cast("decimal(4,3)")).cast("decimal(28,4)"))).otherwise(F.lit(1).cast("decimal(28,4)"))
    return F.coalesce(F.abs(diff) <= bound, F.lit(False))


def hard_gate(number_confidence: Column, total_confidence: Column) -> Column:
    return F.coalesce((number_confidence >= GATE) & (total_confidence >= GATE), F.lit(False))


def status(gate: Column, total: Column, n_lines: Column, passed: Column) -> Column:
    return F.when(~gate | total.isNull() | (n_lines == 0), "REVIEW").when(passed, "OK").otherwise("PARTIAL")


def check_line(line: DataFrame) -> DataFrame:
    """Discount kind and amount, expected total and whether quantity x price less discount meets it within 0.01."""
    base = (F.col("quantity") * F.col("unit_price")).cast("decimal(18,4)")
    taken = discount_amount(F.col("discount"), base)
    expected = (base - taken).cast("decimal(18,2)")
    return line.withColumns({"discount_kind": discount_kind(F.col("discount"), base), "discount_amount": taken, "expected_total": expected, "line_ok": F.abs(expected - F.col("line_total")) <= F.lit(0.01).cast("decimal(18,2)")})


def missing_penalty(required: list[Column], optional: list[Column]) -> Column:
    absent = lambda c: c.isNull().cast("int")
    return F.least(sum((absent(c) for c in required), F.lit(0)) * 10.0 + sum((absent(c) for c in optional), F.lit(0)) * 2.0, F.lit(30.0))


def difference_penalty(diff: Column) -> Column:
    d = F.abs(diff).cast("double")
    return F.when(d.isNull(), 20.0).when(d <= 0.01, 0.0).when(d <= 1.0, d * 2.0).when(d <= 10.0, (d - 1.0) * 1.5 + 2.0).otherwise(F.least((d - 10.0) * 0.5, F.lit(4.5)) + 15.5)


def wrap_penalty(avg_rows: Column, max_rows: Column) -> Column:
    return F.least(F.greatest(avg_rows - 1.0, F.lit(0.0)) * 2.0 + F.greatest(max_rows.cast("double") - 2.0, F.lit(0.0)) * 3.0, F.lit(20.0))


def quality(invoices: DataFrame) -> DataFrame:
    """Adds ``score`` in 0..100 and its four penalties."""
    by_status = F.when(F.col("status") == "REVIEW", 40.0).when(F.col("status") == "PARTIAL", 15.0).otherwise(0.0)
    avg_rows = F.when(F.col("n_lines") > 0, F.col("n_rows_all").cast("double") / F.col("n_lines")).otherwise(0.0)
    parts = {
        "status_penalty": by_status, "missing_penalty": missing_penalty([F.col("invoice_number"), F.col("invoice_date"), F.col("header_total")], [F.col("supplier_name"), F.col("customer_name")]),
        "difference_penalty": difference_penalty(F.col("diff")), "wrap_penalty": wrap_penalty(avg_rows, F.coalesce("max_rows", F.lit(0))),
    }
    return invoices.withColumns(parts).withColumn("score", F.greatest(F.lit(0.0), F.lit(100.0) - F.col("status_penalty") - F.col("missing_penalty") - F.col("difference_penalty") - F.col("wrap_penalty")))


def roll_up(invoices: DataFrame, file_col: str) -> DataFrame:
    """Per file: worst status, least score and counts per status."""
    rank = F.when(F.col("status") == "OK", 0).when(F.col("status") == "PARTIAL", 1).when(F.col("status") == "REVIEW", 2).otherwise(3)
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("OK", "PARTIAL", "REVIEW", "FAILED")]
    out = invoices.groupBy(file_col).agg(F.max(rank).alias("rank"), F.min("score").alias("least_score"), *counts)
    return out.withColumn("worst_status", F.element_at(F.array(*[F.lit(s) for s in ("OK", "PARTIAL", "REVIEW", "FAILED")]), F.col("rank") + 1)).drop("rank")


def choose_best(pairs: DataFrame) -> DataFrame:
    """The better of two extractions a_* and b_*: validation, then total confidence, then number confidence; ties go to a."""
    score = lambda p: F.struct(F.coalesce(F.col(f"{p}_ok") & (F.col(f"{p}_status") != "FAILED"), F.lit(False)), *(F.when(F.col(f"{p}_status") == "FAILED", 0.0).otherwise(F.coalesce(F.col(f"{p}_{c}"), F.lit(0.0))) for c in ("total_confidence", "number_confidence")))
    return pairs.withColumn("chosen", F.when(score("b") > score("a"), "b").otherwise("a"))
