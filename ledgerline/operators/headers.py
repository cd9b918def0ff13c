"""Header fields: the invoice date, a page's invoice number, and all fields of an invoice in one frame.

Rows have ``invoice_id``, ``row_idx``, ``y``, ``page_height`` and ``text``; null texts match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import extraction

#: Forms of a date in the order they are tried, with the order of their parts. Two-digit years are of this century, and
#: three numbers are read day, month, year unless the first has four digits.
DATE_FORMS = (
    (r"(\d{4})-(\d{2})-(\d{2})", "ymd"), (r"(\d{4})\.(\d{2})\.(\d{2})", "ymd"), (r"(\d{1,2})/(\d{1,2})/(\d{4})", "dmy"), (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", "dmy"),
    (r"(\d{1,2})-(\d{1,2})-(\d{4})", "dmy"), (r"(\d{2})-(\d{2})-(\d{2})", "dmy"), (r"(\d{2})\.(\d{2})\.(\d{2})", "dmy"), (r"(\d{2})/(\d{2})/(\d{2})", "dmy"),
)
#: Labels of an invoice number at a boundary.
BOUNDARY_LABELS = (r"fakturanummer", r"fakturanr", r"faktura\s*nr", r"fakt\.?\s*nr", r"faktnr", r"invoice\s*number", r"invoice\s*no", r"inv\s*no", r"inv#")
_BOUNDARY_LABEL = f"(?iu)(?:{'|'.join(BOUNDARY_LABELS)})"
_BOUNDARY_NUMBER = r"(?i)\b([A-Z0-9][A-Z0-9\-]{3,19})\b"
#: Words of a row that holds a total.
TOTAL_WORDS = ("att betala", "totalt", "total", "summa att betala")
#: Confidence that an invoice number and a total are retried for.
NUMBER_TARGET, TOTAL_TARGET = 0.95, 0.90


def row_date(text: Column) -> Column:
    """The first valid date among the first match of each form, forms in their order; NULL if none."""

    def read(pattern: str, parts: str) -> Column:
        place = {p: F.regexp_extract(text, pattern, i + 1) for i, p in enumerate(parts)}
        year = F.when(F.length(place["y"]) == 2, F.concat(F.lit("20"), place["y"])).otherwise(place["y"])
        made = F.concat_ws("-", year, F.lpad(place["m"], 2, "0"), F.lpad(place["d"], 2, "0"))
        return F.when(place["y"].rlike(r"\d") & (year != "0000"), made.try_cast("date"))

    return F.coalesce(*[read(*form) for form in DATE_FORMS])


def pick_date(header: DataFrame) -> DataFrame:
    """invoice_id and invoice_date: the date of the first row that holds a valid one, whatever its words."""
    found = header.withColumn("_d", row_date(F.col("text"))).filter("_d is not null")
    return found.groupBy("invoice_id").agg(F.min_by("_d", "row_idx").alias("invoice_date"))


def boundary_number(candidate: Column) -> Column:
    """4 to 20 letters, digits and hyphens."""
    return F.coalesce(candidate.rlike(r"(?i)^[A-Z0-9\-]{4,20}$"), F.lit(False))


def page_numbers(rows: DataFrame, *, confidence: Column | None = None) -> DataFrame:
    """invoice_id, candidate, row_idx, score: a page's best labelled number (``invoice_id`` is the page's key), after the label or in the
    row below; header rows (``segment_type``) gain 0.10, the upper half of the page 0.05. Ties keep the first label."""
    w, whole = Window.partitionBy("invoice_id").orderBy("row_idx"), Window.partitionBy("invoice_id")
    facts = rows.withColumn("_above", F.coalesce(F.lag("text").over(w).rlike(extraction.NUMBER_WORD), F.lit(False))).withColumn("_all", F.collect_list("text").over(whole))
    number = lambda t: F.nullif(F.regexp_extract(t, _BOUNDARY_NUMBER, 1), F.lit(""))
    labelled = F.coalesce(F.col("text").rlike(_BOUNDARY_LABEL), F.lit(False))
    after = F.regexp_extract("text", f"{_BOUNDARY_LABEL}(.*)$", 1)
    facts = facts.withColumn("_own", F.when(labelled, number(after))).withColumn("_open", labelled & F.col("_own").isNull())
    below = F.when(F.lag("_open", 1, False).over(w), number(F.col("text")))
    offers = F.filter(F.array(F.struct(F.col("_own").alias("c"), F.col("row_idx").alias("at")), F.struct(below.alias("c"), (F.col("row_idx") - 1).alias("at"))), lambda o: boundary_number(o["c"]))
    listed = facts.withColumn("_offers", offers).withColumn("_o", F.explode("_offers")).withColumn("candidate", F.col("_o.c"))
    score = extraction.number_score(F.col("candidate"), F.lit(1.0) if confidence is None else confidence)
    score = F.least(F.lit(1.0), score + F.when(F.col("segment_type") == "header", 0.10).otherwise(0.0))
    score = F.least(F.lit(1.0), score + F.when(F.col("y") < F.col("page_height") * 0.5, 0.05).otherwise(0.0))
    best = listed.withColumn("score", score).groupBy("invoice_id").agg(F.min_by(F.struct("candidate", "row_idx", "score"), F.struct(-F.round("score", 9), F.col("_o.at"))).alias("b"))
    return best.select("invoice_id", "b.*")


def strong_header(header: DataFrame) -> DataFrame:
    """invoice_id and ``strong``: a number after a label that scores 0.95, or a row with the word and either a number that scores 0.6 or a
    date or amount of its own."""
    w, whole = Window.partitionBy("invoice_id").orderBy("row_idx"), Window.partitionBy("invoice_id")
    facts = header.withColumn("_above", F.coalesce(F.lag("text").over(w).rlike(extraction.NUMBER_WORD), F.lit(False))).withColumn("_all", F.collect_list("text").over(whole))
    found = F.regexp_extract_all("text", F.lit(r"(?i)(?:fakturanummer|invoice\s*number|no\.|nr|number)[\s:]*([A-Z0-9\-]+)"), F.lit(1))
    scored = facts.withColumn("_c", F.explode_outer(found)).withColumn("_s", F.coalesce(F.when(F.col("_c") != "", extraction.number_score(F.trim("_c"), F.lit(1.0))), F.lit(0.0)))
    word = F.coalesce(F.col("text").rlike(r"(?iu)faktura") & F.col("text").rlike(r"(?i)[A-Z0-9\-]{3,25}"), F.lit(False))
    backed = F.col("text").rlike(r"\d")  # any digits are an amount, and a date holds some
    out = scored.groupBy("invoice_id").agg(F.max("_s").alias("s"), F.bool_or(word).alias("w"), F.bool_or(word & backed).alias("b"))
    return out.select("invoice_id", ((F.col("s") >= 0.95) | (F.col("w") & (F.col("s") >= 0.6)) | F.col("b")).alias("strong"))


def has_total(footer: DataFrame) -> DataFrame:
    """invoice_id and ``has_total``: whether a row has a total's word and a number."""
    low = F.lower("text")
    word = F.exists(F.array(*[F.lit(t) for t in TOTAL_WORDS]), lambda t: F.contains(low, t))
    return footer.groupBy("invoice_id").agg(F.bool_or(F.coalesce(word & F.col("text").rlike(r"\d"), F.lit(False))).alias("has_total"))


def header_fields(header: DataFrame) -> DataFrame:
    """One row an invoice that has header rows: supplier_name, reference, invoice_date, invoice_number, its confidence and whether
    that reaches the target. Fields that no row gives are NULL, the confidence then 0."""
    every = header.select("invoice_id").distinct()
    for part in (extraction.pick_supplier(header), extraction.pick_reference(header), pick_date(header), extraction.pick_number(header)):
        every = every.join(part, "invoice_id", "left")
    number = F.coalesce("score", F.lit(0.0))
    return every.withColumn("number_confidence", number).withColumn("number_reached", number >= NUMBER_TARGET).drop("score")
