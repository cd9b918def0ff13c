"""Checks of invoice lines: expected total, confidence, kind of discount, suggested values, warnings; errors and warnings of invoices.

Lines have invoice_id, line_number, quantity, unit_price, discount, line_total. The line's total is taken as right; the other
fields are held against it. A null field is one that could not be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import reconcile

D = "decimal(28,8)"


def _d(value: str) -> Column:
    return F.lit(value).cast(D)


def shown(value: Column) -> Column:
    """Two decimals, half to even."""
    return F.bround(value, 2).cast("decimal(28,2)").cast("string")


def check_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``expected_total``, ``discount_type``, ``confidence`` (0..1), ``fields_ok``, ``suggested`` (struct of unit_price,
    quantity, discount, discount_type) and ``warnings`` (array of strings, in their order)."""
    q, p, d, total = (F.col(c).cast(D) for c in ("quantity", "unit_price", "discount", "line_total"))
    has_q, has_p, has_d = (F.coalesce(c, F.lit(False)) for c in (q > 0, p > 0, d.isNotNull()))
    sound = F.coalesce(total > 0, F.lit(False))
    out = lines.withColumn("_base", F.when(has_q & has_p, (q * p).cast(D)))
    base = F.col("_base")
    # A share up to 1, an amount up to twice the base, beyond that hundredths.
    hundredths = has_d & (d > 1) & (d > base * 2)
    kind = F.when(base.isNotNull() & has_d, F.when(((d >= 0) & (d <= 1)) | hundredths, "percent").otherwise("amount"))
    off = F.when(~has_d, _d("0")).when((d >= 0) & (d <= 1), (base * d).cast(D)).when(hundredths, (base * d / 100).cast(D)).otherwise(F.abs(d))
    out = out.withColumn("discount_type", kind).withColumn("_expected", (base - off).cast(D))
    expected = F.col("_expected")
    gap = F.abs(expected - total)
    out = out.withColumn("_gap", gap)
    gap, wide = F.col("_gap"), F.coalesce(F.col("_gap") > 1, F.lit(False))
    whole = lambda x: F.when(F.abs(x - F.bround(x, 0)) < _d("0.01"), F.bround(x, 0).cast(D))
    by_quantity = F.when(has_q, F.try_divide(total, q).cast(D))
    by_price = F.when(has_p, F.try_divide(total, p).cast(D))
    share = (_d("1") - F.try_divide(total, base)).cast(D)
    no_discount = wide & ~has_d
    suggested = F.struct(
        F.when(no_discount | (has_q & ~has_p), by_quantity).alias("unit_price"), F.when(no_discount, whole(by_price)).when(has_p & ~has_q, F.coalesce(whole(by_price), by_price)).alias("quantity"),
        F.when(wide & (kind == "percent") & share.between(0, 1), share).when(wide & (kind == "amount") & (base - total >= 0), base - total).alias("discount"),
        F.when(wide & (((kind == "percent") & share.between(0, 1)) | ((kind == "amount") & (base - total >= 0))), kind).alias("discount_type"),
    )
    score = (
        F.lit(0.40) + F.when(gap <= _d("0.01"), 0.30).when(gap <= 1, 0.20).when(has_q != has_p, 0.15).otherwise(0.0)
        + F.when(has_q & q.between(_d("0.001"), _d("1000000")), 0.10).otherwise(0.0) + F.when(has_p & p.between(_d("0.01"), _d("10000000")), 0.10).otherwise(0.0) + F.when(has_d & (d >= 0), 0.10).otherwise(0.0)
    )
    compared = lambda name: F.concat(F.lit(f"{name}: förväntat "), shown(expected), F.lit(", faktiskt "), shown(total), F.lit(" (diff: "), shown(gap), F.lit(" SEK)"))
    says = F.array(
        F.when(~sound, F.lit("total_amount <= 0 (invalid line)")),
        F.when(sound & (gap > _d("0.01")) & (gap <= 1), compared("Liten avvikelse")),
        F.when(sound & wide & has_d, compared("Stor avvikelse")),
        F.when(sound & no_discount, F.concat(F.lit("Avvikelse: antal × a-pris ("), shown(base), F.lit(") ≠ summa ("), shown(total), F.lit(")"))),
        F.when(sound & has_q & ~has_p, F.concat(F.lit("A-pris saknas, beräknat: "), shown(by_quantity), F.lit(" SEK"))),
        F.when(sound & has_p & ~has_q, F.concat(F.lit("Antal saknas, beräknat: "), F.coalesce(whole(by_price).cast("decimal(28,0)").cast("string"), by_price.cast("decimal(28,4)").cast("string")))),
        F.when(sound & ~has_q & ~has_p, F.lit("Antal och a-pris saknas - kan inte validera mot summa")),
        F.when(sound & has_q & ~q.between(_d("0.001"), _d("1000000")), F.concat(F.lit("Antal verkar orimligt: "), F.col("quantity").cast("string"))),
        F.when(sound & has_p & ~p.between(_d("0.01"), _d("10000000")), F.concat(F.lit("A-pris verkar orimligt: "), shown(p))),
        F.when(sound & has_d & (d < 0), F.concat(F.lit("Rabatt är negativ: "), F.col("discount").cast("string"))),
    )
    nothing = F.struct(F.lit(None).cast(D).alias("unit_price"), F.lit(None).cast(D).alias("quantity"), F.lit(None).cast(D).alias("discount"), F.lit(None).cast("string").alias("discount_type"))
    out = out.withColumns({
        "expected_total": F.when(sound, expected), "discount_type": F.when(sound, F.col("discount_type")), "confidence": F.when(sound, F.least(F.lit(1.0), score)).otherwise(0.0),
        "fields_ok": F.coalesce(sound & (gap <= 1), F.lit(False)), "suggested": F.when(sound, suggested).otherwise(nothing), "warnings": F.array_compact(says),
    })
    return out.drop("_base", "_expected", "_gap")


def line_warnings(checked: DataFrame) -> DataFrame:
    """Checked lines with ``messages``: their warnings, kind of discount and suggestions, each with the line's number."""
    number = F.concat(F.lit("Rad "), F.col("line_number").cast("string"), F.lit(": "))
    d, s = F.col("discount").cast(D), F.col("suggested")
    kind = F.when(F.col("discount_type") == "percent", F.concat(F.lit("Rabatt identifierad som procent ("), F.bround(d * 100, 1).cast("decimal(28,1)").cast("string"), F.lit("%)"))).when(F.col("discount_type") == "amount", F.concat(F.lit("Rabatt identifierad som belopp ("), shown(d), F.lit(" SEK)")))
    offers = F.array_compact(F.array(
        F.concat(F.lit("Föreslaget a-pris: "), shown(s["unit_price"]), F.lit(" SEK")), F.concat(F.lit("Föreslaget antal: "), F.coalesce(F.when(s["quantity"] == F.bround(s["quantity"], 0), s["quantity"].cast("decimal(28,0)").cast("string")), s["quantity"].cast("decimal(28,4)").cast("string"))),
        F.when(s["discount_type"] == "percent", F.concat(F.lit("Föreslaget rabatt: "), F.bround(s["discount"] * 100, 1).cast("decimal(28,1)").cast("string"), F.lit("%"))).when(s["discount_type"] == "amount", F.concat(F.lit("Föreslaget rabatt: "), shown(s["discount"]), F.lit(" SEK"))),
    ))
    values = F.when(F.size(offers) > 0, F.concat(F.lit("Beräknade värden - "), F.array_join(offers, ", ")))
    return checked.withColumn("messages", F.transform(F.concat("warnings", F.array_compact(F.array(kind, values))), lambda m: F.concat(number, m)))


def invoice_messages(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers (invoice_id, header_total, number_confidence, total_confidence) with lines_sum, diff, status, ``errors`` and
    ``warnings``: the lines' messages in order, and the sums' mismatch."""
    said = line_warnings(check_lines(lines)).groupBy("invoice_id").agg(
        F.sum(F.coalesce("line_total", F.lit(0))).cast("decimal(28,2)").alias("_sum"), F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("line_number", "messages"))).alias("_said")
    )
    joined = headers.join(said, "invoice_id", "left").withColumns({"lines_sum": F.coalesce("_sum", F.lit(0)).cast("decimal(28,2)"), "n_lines": F.coalesce("n_lines", F.lit(0))})
    joined = joined.withColumn("diff", reconcile.difference())
    gate, agrees = reconcile.hard_gate(F.col("number_confidence"), F.col("total_confidence")), reconcile.scaled_pass(F.col("header_total"), F.col("diff"))
    status = reconcile.status(gate, F.col("header_total"), F.col("n_lines"), agrees)
    two = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    error = F.when(~gate, F.concat(F.lit("Hard gate failed: invoice_number_confidence="), two("number_confidence"), F.lit(", total_confidence="), two("total_confidence"))).when(F.col("header_total").isNull(), "Total amount not extracted (confidence < 0.95)").when(F.col("n_lines") == 0, "No invoice lines extracted (cannot validate)")
    mismatch = F.when(status == "PARTIAL", F.concat(F.lit("Sum mismatch: diff="), shown(F.col("diff")), F.lit(" SEK (tolerance: ±1.0 SEK)")))
    told = F.coalesce(F.flatten(F.transform("_said", lambda x: x["messages"])), F.array().cast("array<string>"))
    return joined.withColumns({"status": status, "errors": F.array_compact(F.array(error)), "warnings": F.concat(told, F.array_compact(F.array(mismatch)))}).drop("_sum", "_said")


def net_check(sums: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Lines' sums (``lines_sum``) against the stated net: net_diff, net_ok."""
    diff = (F.col("stated_net") - F.col("lines_sum")).cast("decimal(28,2)")
    return sums.withColumns({"net_diff": diff, "net_ok": reconcile.flat_pass(diff, tolerance)})


def gross_check(sums: DataFrame, tolerance: float = 0.5, rate: str = "0.25") -> DataFrame:
    """Lines' sums with VAT against the stated gross total: vat, gross_diff, gross_ok."""
    vat = F.round(F.col("lines_sum") * F.lit(rate).cast("decimal(4,2)"), 2).cast("decimal(28,2)")
    diff = (F.col("stated_gross") - (F.col("lines_sum") + vat)).cast("decimal(28,2)")
    return sums.withColumns({"vat": vat, "gross_diff": diff, "gross_ok": reconcile.flat_pass(diff, tolerance)})
