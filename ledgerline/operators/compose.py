"""From tokens to checked invoices: rows, segments, boundaries, fields, lines, totals, status.

Tokens have doc_id, page_number, token_idx, text, x, y, width, height, page_width, page_height. A batch of any number of documents
goes through a few plans; what lies between them is kept by the caller's ``keep`` (``sources.files.keeper`` writes tables).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import rows as R
from ledgerline.functions.text import page_counter
from ledgerline.operators import extraction, headers, layout, linecheck, mapped_lines, reconcile, totals

PAGE = ("doc_id", "page_number")


def page_rows(grouped: DataFrame) -> DataFrame:
    """Rows of grouped tokens with their segment and page width."""
    widths = grouped.groupBy(*PAGE).agg(F.max("page_width").alias("page_width"))
    return layout.bands(layout.row_table(grouped)).join(widths, list(PAGE))


def boundaries(rows: DataFrame) -> DataFrame:
    """doc_id, page_start, page_end, virtual_invoice_index (from 1) from the pages' numbers and counters. A document whose pages say
    nothing is one invoice."""
    keyed = rows.withColumn("invoice_id", F.struct("doc_id", "page_number"))
    numbers = headers.page_numbers(keyed).select("invoice_id.doc_id", "invoice_id.page_number", F.col("candidate").alias("invoice_no"))
    counter = F.min_by(page_counter(F.col("text")), F.when(page_counter(F.col("text")).isNotNull(), F.col("row_idx")))
    pages = rows.groupBy(*PAGE).agg(counter.alias("counter")).join(numbers, list(PAGE), "left")
    spans = layout.invoice_boundaries(pages)
    return spans.withColumn("virtual_invoice_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_start")))


def invoices_of(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with invoice_id ('doc__index') and row_idx counted over the invoice's pages."""
    s = spans.select(F.col("doc_id").alias("_doc"), "page_start", "page_end", "virtual_invoice_index")
    joined = rows.join(s, (F.col("doc_id") == F.col("_doc")) & F.col("page_number").between(F.col("page_start"), F.col("page_end")))
    named = joined.withColumn("invoice_id", F.concat_ws("__", F.col("doc_id").cast("string"), F.col("virtual_invoice_index").cast("string"))).withColumn("page_row", F.col("row_idx"))
    return named.withColumn("row_idx", (F.row_number().over(Window.partitionBy("invoice_id").orderBy("page_number", "page_row")) - 1).cast("int")).drop("_doc")


def process(tokens: DataFrame, *, keep: Callable[[DataFrame], DataFrame], mode: str = "auto", retry: bool = True) -> dict[str, DataFrame]:
    """``rows``, ``lines`` and ``invoices``: one row an invoice with its fields, total, sums, status, errors and warnings.

    ``keep`` writes a frame and gives it back read: tokens by row, rows by invoice, stated sums, lines, header fields and totals are
    kept, so that no step is planned or run twice.

    Header rows are those of the first page, footer rows those of the last. Line numbers run over an invoice's pages."""
    grouped = keep(layout.group_rows(tokens))
    rows = keep(page_rows(grouped))
    named = keep(invoices_of(rows, keep(boundaries(rows))))
    kind = lambda k: named.filter(F.col("segment_type") == k)
    head = kind("header").filter(F.col("page_number") == F.col("page_start"))
    foot = kind("footer").filter(F.col("page_number") == F.col("page_end"))
    # A page of footer rows only has its items there.
    only = Window.partitionBy("invoice_id", "page_number")
    items = named.withColumn("_only", F.min((F.col("segment_type") == "footer").cast("int")).over(only) == 1).filter((F.col("segment_type") == "items") | F.col("_only")).drop("_only")
    words = grouped.withColumnRenamed("row_idx", "page_row").join(items.select(*PAGE, "page_row", "invoice_id", "row_idx"), [*PAGE, "page_row"])
    stated = named.select("invoice_id").distinct()
    for words_of, name in ((extraction.NET, "stated_net"), (extraction.GROSS, "stated_gross")):
        stated = stated.join(extraction.footer_total(foot, words_of, name), "invoice_id", "left")
    lines = keep(mapped_lines.read_lines(items, keep(words), keep(stated), mode=mode, keep=keep).withColumnRenamed("amount", "line_total"))
    sums = lines.groupBy("invoice_id").agg(F.sum("line_total").cast("decimal(18,2)").alias("lines_sum"))
    above = items.filter(F.col("page_number") == F.col("page_end"))
    total = keep(totals.retried_totals(foot, sums, above=above) if retry else totals.final_totals(foot, sums, above=above))
    fields = named.select("invoice_id", "doc_id", "page_start", "page_end", "virtual_invoice_index").distinct()
    fields = fields.join(keep(headers.header_fields(head)), "invoice_id", "left").join(total.select("invoice_id", F.col("total_amount").cast("decimal(28,2)").alias("header_total"), "total_confidence", "keyword_type"), "invoice_id", "left")
    fields = fields.fillna({"number_confidence": 0.0, "total_confidence": 0.0})
    return {"rows": named, "lines": lines, "invoices": linecheck.invoice_messages(fields, lines)}


def by_route(text_tokens: DataFrame, scanned_tokens: DataFrame, routes: DataFrame, page: tuple[str, ...] = PAGE) -> DataFrame:
    """One frame of tokens: pages that ``routes`` (page, use_text_layer) sends to the text layer, and the others' scans."""
    keyed = routes.select(*page, "use_text_layer")
    text = text_tokens.join(keyed.filter("use_text_layer"), list(page), "left_semi")
    return text.unionByName(scanned_tokens.join(keyed.filter("not use_text_layer"), list(page), "left_semi"))


def better_of(first: DataFrame, second: DataFrame) -> DataFrame:
    """invoice_id and ``chosen`` ('a' or 'b') of two readings of the same invoices; one that only a reading has is that reading's."""
    parts = []
    for p, df in (("a", first), ("b", second)):
        ok = reconcile.scaled_pass(F.col("header_total"), F.col("diff"))
        parts.append(df.select("invoice_id", ok.alias(f"{p}_ok"), F.col("status").alias(f"{p}_status"), F.col("total_confidence").alias(f"{p}_total_confidence"), F.col("number_confidence").alias(f"{p}_number_confidence")))
    return reconcile.choose_best(parts[0].join(parts[1], "invoice_id", "full")).select("invoice_id", F.when(F.col("a_status").isNull(), "b").when(F.col("b_status").isNull(), "a").otherwise(F.col("chosen")).alias("chosen"))


def enrichment_diff(before: DataFrame, after: DataFrame, before_lines: DataFrame, after_lines: DataFrame, fields: tuple[str, ...] = ("invoice_number", "supplier_name", "invoice_date", "header_total")) -> DataFrame:
    """invoice_id, place ('header' or the line's number), field, original, enriched: what differs between two readings. Lines are held
    against each other by their place; those that only one reading has are left out."""
    sides = lambda names: F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("original"), F.col(f"b.{f}").cast("string").alias("enriched")) for f in names]), lambda d: ~d["original"].eqNullSafe(d["enriched"]))
    head = before.alias("a").join(after.alias("b"), "invoice_id").select("invoice_id", F.lit("header").alias("place"), F.inline(sides(fields)))
    line_fields = tuple(c for c in ("description", "quantity", "unit", "unit_price", "discount", "line_total") if c in before_lines.columns and c in after_lines.columns)
    lines = before_lines.alias("a").join(after_lines.alias("b"), ["invoice_id", "line_number"]).select("invoice_id", F.col("line_number").cast("string").alias("place"), F.inline(sides(line_fields)))
    return head.unionByName(lines)


def starts(rows: DataFrame) -> DataFrame:
    """Rows with ``starts``: whether a row begins an item, by an amount or by its first word."""
    return rows.withColumn("starts", R.has_amount(F.col("text")) | R.starts_item(F.col("text")))
