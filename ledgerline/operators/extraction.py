"""Header and footer fields from text rows: supplier, reference, invoice number, net and gross totals, scored totals.

Rows have ``invoice_id``, ``row_idx``, ``y``, ``page_height`` and ``text``. Windows are over one invoice's segment, which pages
bound. Null texts count as empty; an invoice with no fitting row has no result row (numbers and suppliers) or NULL (totals).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import rows as R
from ledgerline.functions.numbers import parse_number
from ledgerline.functions.text import garbled, label_text

#: Rows about other things than the company's name.
NOT_A_NAME = (
    "faktura", "invoice", "datum", "date", "fakturanummer", "invoice number", "sida", "page", "nr:", "betaling", "betalningsreferens", "betalnings referens", "lagerplats", "referens", "reference", "sek", "kr",
)
#: Forms of rows that hold no name.
NOT_A_NAME_FORMS = (r"sida\s+\d+/\d+", r"nr:\s*\d+", r"\d{2}-\d{2}-\d{2}", r"\d{4}-\d{2}-\d{2}", r"\d+\s+\d+\s+\(\d+\)", r"\d{5}\s*[A-ZÅÄÖ]+", r"\d+\s+\d+[.,]\d{2}\s+sek")
NOT_A_NAME_FORM = "(?iu)" + "|".join(NOT_A_NAME_FORMS)
COMPANY = ("AB", "Ltd", "Inc", "Aktiebolag")
#: Labels of an invoice number in a row's plain form, and number words that raise its score.
NUMBER_LABELS = (r"fakturanummer", r"faktura\s*nr", r"faktura\s*-\s*nr", r"fakt\.\s*nr", r"faktnr", r"fakt\s*nr", r"fakt\s*-\s*nr", r"faktura\s+\d", r"invoice\s*number", r"invoice\s*no", r"inv\s*no")
NUMBER_LABEL = "|".join(NUMBER_LABELS)
NUMBER_WORD = r"(?i)fakturanummer|faktura\s*nr|faktnr|fakt\.nr|invoice\s*number|invoice\s*no|inv\s*no|no\.|nr|number"
#: Words of net and gross totals.
NET = r"(?i)netto(?:beloppet|belopp)?|(?:exkl\.?|exklusive|utan)\s*moms|delsumma|subtotal|momsfri\s+summa|momsfritt\s+belopp"
GROSS = r"(?i)att\s+betala|attbetala|fakturabelopp|betalningsbelopp|inkl\.?\s*moms"
#: Keyword weights of a total's row, strongest first.
TOTAL_WORDS = (
    (("att betala", "attbetala", "betalningsbelopp", "inkl. moms", "inklusive moms", "inkl moms", "med moms", "moms inkluderad", "betalas"), 0.32),
    (("totalt", "total", "summa", "belopp"), 0.28),
    (("exkl. moms", "exklusive moms", "exkl moms", "utan moms", "delsumma", "subtotal", "netto exkl. moms"), 0.18),
)
RETRY = (None, "aggressive", "conservative", "extended_patterns", "broader_search")


def _ordered() -> Window:
    return Window.partitionBy("invoice_id").orderBy("row_idx")


def pick_supplier(header: DataFrame, first_rows: int = 5) -> DataFrame:
    """invoice_id and supplier_name: of the first rows that are no metadata, one with a company form, else the first."""
    t = F.trim(F.coalesce("text", F.lit("")))
    odd = F.length(F.regexp_replace(t, r"(?U)[\p{L}\s]", "")) / F.length(t)
    fits = ~R.any_of(F.lower(t), NOT_A_NAME) & ~t.rlike(NOT_A_NAME_FORM) & (F.length(t) >= 3) & (odd <= 0.7)
    kept = header.withColumn("_n", F.row_number().over(_ordered())).filter((F.col("_n") <= first_rows) & fits)
    return kept.groupBy("invoice_id").agg(F.min_by(F.substring(t, 1, 100), F.struct(~R.any_of(t, COMPANY), "_n")).alias("supplier_name"))


def pick_reference(header: DataFrame) -> DataFrame:
    return header.withColumn("_r", R.reference(F.col("text"))).filter("_r is not null").groupBy("invoice_id").agg(F.min_by("_r", "row_idx").alias("reference"))


def _number(text: Column) -> Column:
    found = F.regexp_extract(text, r"\b([A-Z]{1,3}\d{4,12}[A-Z0-9]{0,3}|\d{5,12})\b", 1)
    broad = F.regexp_extract(text, r"\b([A-Z0-9\-]{4,20})\b", 1)
    return F.when(found != "", found).when(broad != "", broad)


def number_score(candidate: Column, confidence: Column) -> Column:
    """0..1 by place on the page, number word on or above the row (``_above``), form, uniqueness among ``_all`` texts and
    the tokens' confidence."""
    y, h = F.col("y"), F.col("page_height")
    place = F.when(y < h * 0.25, 0.30).when(y < h * 0.35, 0.20).otherwise(0.0)
    word = F.when(F.col("text").rlike(NUMBER_WORD), 0.35).when(F.col("_above"), 0.28).when(F.col("text").rlike(r"(?i)faktura\s+\d"), 0.30).otherwise(0.0)
    once = F.size(F.filter("_all", lambda t: t.contains(candidate))) == 1
    return F.least(F.lit(1.0), place + word + F.when(R.number_shape(candidate), 0.20).otherwise(0.0) + F.when(once, 0.10).otherwise(0.0) + confidence * 0.05)


def number_candidates(header: DataFrame, *, confidence: Column | None = None, scan_share: float = 0.25) -> DataFrame:
    """invoice_id, candidate, row_idx, priority, score: numbers after a label (priority 1) or in one of the two rows below it (3, 4);
    without any, plain numbers of the page's top (10). At most the first 20 are scored."""
    w, whole = _ordered(), Window.partitionBy("invoice_id")
    plain = label_text(F.coalesce("text", F.lit("")))
    facts = header.withColumn("_plain", plain).withColumn("_all", F.collect_list("text").over(whole))
    above = F.coalesce(F.lag("text").over(w).rlike(NUMBER_WORD), F.lit(False))
    facts = facts.withColumn("_after", F.regexp_extract("_plain", f"(?:{NUMBER_LABEL})(.*)", 1)).withColumn("_labelled", F.col("_plain").rlike(NUMBER_LABEL)).withColumn("_above", above)
    facts = facts.withColumn("_own", _number(F.col("_plain"))).withColumn("_l1", F.lag("_labelled", 1, False).over(w)).withColumn("_l2", F.lag("_labelled", 2, False).over(w)).withColumn("_label_row", F.col("row_idx"))
    offer = lambda ok, value, priority, base: F.when(ok & value.isNotNull(), F.struct(value.alias("candidate"), F.lit(priority).alias("priority"), (F.col("row_idx") - base).alias("label_row")))
    found = F.filter(
        F.array(offer(F.col("_labelled"), _number(F.col("_after")), 1, 0), offer(F.col("_l1"), F.col("_own"), 3, 1), offer(F.col("_l2"), F.col("_own"), 4, 2)), lambda c: c.isNotNull(),
    )
    scan = F.transform(F.filter(F.regexp_extract_all("_plain", F.lit(r"\b([A-Z0-9\-]{4,20})\b"), F.lit(1)), lambda c: R.number_likely(c, F.col("text"))), lambda c: F.struct(c.alias("candidate"), F.lit(10).alias("priority"), F.col("row_idx").alias("label_row")))
    facts = facts.withColumn("_found", found).withColumn("_any", F.max(F.size("_found")).over(whole) > 0)
    offers = F.when(F.col("_any"), F.col("_found")).when(F.col("y") < F.col("page_height") * scan_share, scan)
    listed = facts.withColumn("_c", F.explode(offers)).select("*", "_c.candidate", "_c.priority", "_c.label_row")
    listed = listed.withColumn("_k", F.row_number().over(Window.partitionBy("invoice_id").orderBy("label_row", "priority"))).filter("_k <= 20")
    score = number_score(F.col("candidate"), F.lit(1.0) if confidence is None else confidence)
    boost = F.when(F.col("priority") == 1, 0.10).when(F.col("priority") == 3, 0.02).otherwise(0.0)
    return listed.select("invoice_id", "candidate", "row_idx", "priority", F.col("_k").alias("position"), F.least(F.lit(1.0), score + boost).alias("score"))


def pick_number(header: DataFrame, **options) -> DataFrame:
    """invoice_id, invoice_number, score: the best candidate, widened to the first longer all-digit word that holds it."""
    best = number_candidates(header, **options).groupBy("invoice_id").agg(F.min_by(F.struct("candidate", "score"), F.struct(-F.round("score", 9), "priority", "position")).alias("b")).select("invoice_id", "b.candidate", "b.score")
    words = header.select("invoice_id", "row_idx", F.posexplode(F.split("text", r"\s+")).alias("_p", "_w")).filter(F.col("_w").rlike(r"^\d{5,12}$"))
    wider = best.join(words, "invoice_id").filter(F.col("_w").contains(F.col("candidate")) & (F.length("_w") > F.length("candidate"))).groupBy("invoice_id").agg(F.min_by("_w", F.struct("row_idx", "_p")).alias("_w"))
    # Ten digits with a year's or check ending are an eight-digit number and its ending.
    cut = F.when((F.length("_w") == 10) & F.substring("_w", 9, 2).isin("06", "24", "25", "26"), F.substring("_w", 1, 8)).otherwise(F.col("_w"))
    return best.join(wider, "invoice_id", "left").select("invoice_id", F.coalesce(cut, "candidate").alias("invoice_number"), "score")


def footer_total(footer: DataFrame, words: str, name: str) -> DataFrame:
    """invoice_id and the first positive amount of the first row with ``words``; a row without any number takes the next row's."""
    w = _ordered()
    marks = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({R.SUM_AMOUNT})"), F.lit(1)))
    first = F.get(R.positive_in(F.col("text"), R.SUM_AMOUNT), F.lit(0))
    value = footer.withColumn("_first", first).withColumn("_marks", marks).withColumn("_next", F.lead("_first").over(w))
    value = value.withColumn("_v", F.when(F.col("text").rlike(words), F.when(F.col("_marks") > 0, F.col("_first")).otherwise(F.col("_next"))))
    return value.groupBy("invoice_id").agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("row_idx"))).alias(name))


def score_totals(footer: DataFrame, sums: DataFrame, offers: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """invoice_id, row_idx, amount, score for every positive amount of a footer, by keyword, place, agreement with ``sums``
    (invoice_id, lines_sum), size, VAT rows nearby, currency, spacing, and font where ``font_size`` is a column. Amounts of a
    row that repeat are scored once. ``offers``, where given, is the row's array of struct(amount, ...) to score instead; its
    other fields and the columns in ``keep`` stay."""
    w, whole = _ordered(), Window.partitionBy("invoice_id")
    low = F.lower("text")
    vat = low.contains("moms") | low.contains("vat") | low.contains("mervärdesskatt")
    gap = lambda a, b: F.coalesce(a - b - 12.0 > 18.0, F.lit(False)).cast("double") * 0.02
    facts = footer.withColumn("_amounts", R.positive_in(F.col("text"))).withColumn("_vat", vat).withColumn("_largest", F.max(F.array_max("_amounts")).over(whole))
    close = lambda k: F.coalesce(F.lag("_vat", k).over(w), F.lit(False)) | F.coalesce(F.lead("_vat", k).over(w), F.lit(False))
    # The nearest row before comes first, at two rows' distance before one.
    near = F.when(F.lag("_vat", 2, False).over(w), 0.03).when(close(1), 0.05).when(F.lead("_vat", 2, False).over(w), 0.03).otherwise(0.0)
    facts = facts.withColumn("_near", near).withColumn("_alone", gap(F.col("y"), F.lag("y").over(w)) + gap(F.lead("y").over(w), F.col("y")))
    font = F.lit(0.0)
    if "font_size" in footer.columns:  # the row's mean size against that of the footer's ``font_tokens``
        weight = F.when(F.col("font_size").isNotNull(), F.col("font_tokens") if "font_tokens" in footer.columns else F.lit(1))
        facts = facts.withColumn("_font", F.col("font_size") / (F.sum(F.col("font_size") * weight).over(whole) / F.sum(weight).over(whole)))
        font = F.when(F.col("_font") > 1.1, 0.05).when(F.col("_font") > 0.95, 0.02).otherwise(0.0)
    offered = F.transform(F.array_distinct("_amounts"), lambda v: F.struct(v.alias("amount"))) if offers is None else offers
    listed = facts.join(sums.select("invoice_id", "lines_sum"), "invoice_id", "left").withColumn("_offer", F.explode(offered)).withColumn("amount", F.col("_offer.amount"))
    word = F.lit(0.0)
    for words, weight in reversed(TOTAL_WORDS):
        word = F.when(R.any_of(low, words), weight).otherwise(word)
    y, h, a = F.col("y"), F.col("page_height"), F.col("amount")
    place = F.when(y > h * 0.7, 0.18).when(y > h * 0.6, 0.13).otherwise(0.0)
    off = F.abs(a - F.col("lines_sum"))
    share = off / a * 100
    steps = lambda x, *at: [F.when(x <= limit, v) for limit, v in at]
    large = F.coalesce(*steps(share, (0.5, 0.30), (1, 0.26), (2, 0.20), (5, 0.14), (10, 0.07)), F.lit(0.03))
    small = F.coalesce(*steps(off, (2, 0.28), (5, 0.23), (20, 0.16), (50, 0.09)), F.lit(0.05))
    agrees = off <= F.when(a > 1000, F.greatest(F.lit(1).cast("decimal(18,4)"), a * F.lit("0.005").cast("decimal(4,3)"))).otherwise(F.lit(1))
    maths = F.when(F.col("lines_sum").isNull(), 0.0).when(agrees, 0.32).when(a > 1000, large).otherwise(small)
    size = F.when(a >= F.col("_largest") * F.lit("0.98").cast("decimal(3,2)"), 0.08).when(a >= F.col("_largest") * F.lit("0.90").cast("decimal(3,2)"), 0.05).otherwise(0.0)
    money = F.when(R.any_of(low, R.CURRENCY), 0.03).otherwise(0.0)
    score = F.least(F.lit(1.0), word + place + maths + size + font + F.col("_near") + money + F.col("_alone")).alias("score")
    more = [] if offers is None else ["_offer", *keep]
    return listed.select("invoice_id", "row_idx", "amount", (a >= F.col("_largest")).alias("largest"), score, *more)


def shown_candidates(scored: DataFrame, footer: DataFrame, most: int = 10) -> DataFrame:
    """A report's top candidates: gross rows first, then by score; equal amounts once."""
    kind = footer.select("invoice_id", "row_idx", F.col("text").rlike(GROSS).alias("_gross"))
    order = [F.desc("_gross"), F.desc(F.round("score", 9)), "row_idx", "amount"]
    one = scored.join(kind, ["invoice_id", "row_idx"]).withColumn("_cents", F.round("amount", 2)).withColumn("_n", F.row_number().over(Window.partitionBy("invoice_id", "_cents").orderBy(*order))).filter("_n = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("invoice_id").orderBy(*order))).filter(F.col("rank") <= most).select("invoice_id", "rank", "amount", "score", "row_idx")


def retry(attempts: DataFrame, target: float, most: int = 5) -> DataFrame:
    """invoice_id, strategy, confidence, reached from (invoice_id, attempt, strategy, confidence): the first attempt that
    reaches the target, else the first of the most confident."""
    hit = F.col("confidence") >= target
    order = F.struct(~hit, F.when(hit, 0.0).otherwise(-F.coalesce("confidence", F.lit(0.0))), "attempt")
    return attempts.filter(F.col("attempt") <= most).groupBy("invoice_id").agg(F.min_by(F.struct("strategy", "confidence", hit.alias("reached")), order).alias("b")).select("invoice_id", "b.*")


def page_context(rows: DataFrame) -> DataFrame:
    """invoice_id and the page's readable rows under a heading per segment, segments by their top."""
    kept = rows.withColumn("_top", F.min("y").over(Window.partitionBy("invoice_id", "segment_type")))
    parts = kept.groupBy("invoice_id", "segment_type", "_top").agg(F.array_sort(F.collect_list(F.when(~garbled(F.col("text")), F.struct("row_idx", "text")))).alias("r"))
    lines = F.concat(F.array(F.concat(F.lit("--- "), F.upper("segment_type"), F.lit(" ---"))), F.transform("r", lambda r: r["text"]))
    joined = parts.groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct("_top", "segment_type", lines.alias("lines")))).alias("s"))
    return joined.select("invoice_id", F.array_join(F.flatten(F.transform("s", lambda s: s["lines"])), "\n").alias("context"))


def item_lines(items: DataFrame) -> DataFrame:
    """Line items of text rows: invoice_id, row_idx, line_number, description, quantity, unit, unit_price,
    amount, discount, vat_rate.

    Rows between a table header and the net total belong to the table (all rows, where no header is found); in a table, only
    amounts after the VAT mark count. A row with an amount that is no summation row starts a line; rows without an
    amount or item start are appended to the line above, whose description then is the texts of all its rows."""
    w, whole = _ordered(), Window.partitionBy("invoice_id")
    header = F.when(R.is_table_header(F.col("text")), F.col("row_idx"))
    facts = items.withColumn("_from", F.min(header).over(whole))
    facts = facts.withColumn("_to", F.min(F.when((F.col("row_idx") > F.col("_from")) & F.col("text").rlike(r"(?i)nettobelopp\s+exkl\.?\s*moms"), F.col("row_idx"))).over(whole))
    inside = (F.col("_from").isNull() | (F.col("row_idx") > F.col("_from"))) & (F.col("_to").isNull() | (F.col("row_idx") < F.col("_to")))
    block = facts.filter(inside).withColumn("_a", R.anchored_amount(F.col("text"), F.col("_from").isNotNull())).filter(~R.is_footer_row(F.col("text"))).withColumn("_line", F.sum(F.col("_a").isNotNull().cast("int")).over(w))
    named = F.when(F.col("_a").isNotNull(), R.before_mark(F.col("text"), F.col("_a.mark"))).otherwise(F.col("text"))
    # A quantity with a unit closes the description; numbers after it are prices and discounts.
    measured = rf"(?iu)^(.*?)(?:^|\s)(-?\d+(?:[.,]\d+)?)\s+({'|'.join(re.escape(u) for u in sorted(R.UNITS, key=len, reverse=True))})(?=\s|$)(.*)$"
    block = block.withColumn("_named", named).withColumn("_has", F.col("_a").isNotNull() & F.col("_named").rlike(measured))
    part = lambda i: F.when(F.col("_has"), F.regexp_extract("_named", measured, i))
    block = block.withColumn("_quantity", parse_number(part(2))).withColumn("_unit", F.lower(part(3))).withColumn("_price", F.get(R.positive_in(part(4)), F.lit(0)))
    words = F.trim(F.coalesce(part(1), F.regexp_replace("_named", r"(?:(?<=\s)[-\d.,%]+\s*)+$", "")))
    described = F.when(F.col("_a").isNotNull(), F.regexp_replace(words, r"^\d{5,}\s+", "")).otherwise(F.trim("text"))
    grouped = block.filter((F.col("_line") > 0) & (F.col("_a").isNotNull() | ~R.starts_item(F.col("text")))).withColumn("_d", described)
    texts = F.array_sort(F.collect_list(F.struct("row_idx", F.trim("text").alias("t"))))
    one = F.max(F.when(F.col("_a").isNotNull(), F.col("_d")))
    lines = grouped.groupBy("invoice_id", "_line").agg(
        F.min("row_idx").alias("row_idx"), F.when(F.count(F.lit(1)) == 1, one).otherwise(F.array_join(F.transform(texts, lambda r: r["t"]), " ")).alias("description"), F.max("_quantity").alias("quantity"), F.max("_unit").alias("unit"), F.max("_price").alias("unit_price"),
        F.max("_a.amount").alias("amount"), F.max("_a.discount").alias("discount"), F.max(R.vat_rate(F.col("text"))).alias("vat_rate"),
    )
    return lines.select("invoice_id", "row_idx", F.col("_line").cast("int").alias("line_number"), "description", "quantity", "unit", "unit_price", "amount", "discount", "vat_rate")
