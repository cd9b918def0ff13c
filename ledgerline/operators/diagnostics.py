"""Diagnostic queries over exported lines: units that often go wrong, article numbers as quantities, prices that don't fit.

Rows have invoice_number, description, quantity, unit, unit_price, line_total, discount; null values raise no flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.routing import flags

#: Units that are looked into.
UNITS = ("ea", "ltr", "månad", "day", "xpa")
#: Reasons and categories, as reports name them.
ARTICLE, PRICE, LARGE = "Artikelnummer i antal", "Á-pris stämmer inte", "Antal för stort"
CATEGORIES = ("artikelnummer_i_antal", "unit_price_for_liten", "unit_price_stämmer_inte", "komplexa_rabatter", "tusen_separator_problem")


def unit_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.lower("unit").isin(*UNITS))


def article_quantity(least: int) -> Column:
    """A quantity of ``least`` or more that stands in the description's first word."""
    whole = F.col("quantity").try_cast("decimal(28,0)").cast("string")
    first = F.get(F.split(F.trim("description"), r"\s+"), F.lit(0))
    return F.coalesce((F.col("quantity") >= least) & F.contains(first, F.regexp_replace(F.floor("quantity").cast("string"), r"\..*$", "")) & whole.isNotNull(), F.lit(False))


def _fair() -> Column:
    """The price that quantity and total imply."""
    return F.when(F.col("quantity") > 0, F.try_divide(F.col("line_total").cast("double"), F.col("quantity").cast("double")))


def flagged_units(rows: DataFrame) -> DataFrame:
    """Unit rows with ``problems``: article number as quantity, price off by more than 0.01, quantity of 1,000 or more."""
    off = F.coalesce(F.abs(F.col("unit_price").cast("double") - _fair()) > 0.01, F.lit(False))
    return unit_rows(rows).withColumn("problems", flags((article_quantity(100000), ARTICLE), (off, PRICE), (F.coalesce(F.col("quantity") >= 1000, F.lit(False)), LARGE)))


def unit_summary(rows: DataFrame) -> DataFrame:
    """Flagged and sound unit rows: sound, n, percent."""
    counts = flagged_units(rows).agg(F.count_if(F.size("problems") > 0).alias("bad"), F.count_if(F.size("problems") == 0).alias("good"))
    both = counts.select(F.inline(F.array(F.struct(F.lit(False).alias("sound"), F.col("bad").alias("n"), (F.col("bad") + F.col("good")).alias("all")), F.struct(F.lit(True).alias("sound"), F.col("good").alias("n"), (F.col("bad") + F.col("good")).alias("all")))))
    return both.select("sound", "n", F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("all")), F.lit(0.0)).alias("percent"))


def underpriced(rows: DataFrame) -> DataFrame:
    """Unit rows whose price times quantity is below half of their total: ``expected`` and ``ratio`` (0 where nothing is expected)."""
    expected = F.col("unit_price").cast("double") * F.col("quantity").cast("double")
    kept = unit_rows(rows).withColumn("expected", expected).filter((F.col("quantity") > 0) & (F.col("expected") < F.col("line_total").cast("double") * 0.5))
    return kept.withColumn("ratio", F.when(F.col("expected") > 0, F.col("line_total").cast("double") / F.col("expected")).otherwise(0.0))


def spaced_quantities(rows: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Underpriced rows with ``quantities``: numbers with spaced thousands before the unit in the description that make the total."""
    unit = F.lower("unit")
    before = F.substring("description", F.lit(1), F.greatest(F.lit(0), F.instr(F.lower("description"), unit) - 1))
    spaced = F.transform(F.regexp_extract_all(before, F.lit(r"(\d{1,3}(?:\s+\d{3})+)"), F.lit(1)), lambda m: F.regexp_replace(m, r"\s", "").try_cast("bigint"))
    makes = lambda v: F.abs(v * F.col("unit_price").cast("double") - F.col("line_total").cast("double")) < tolerance
    return underpriced(rows).withColumn("quantities", F.filter(spaced, makes))


def remaining_problems(rows: DataFrame) -> DataFrame:
    """Unit rows with a problem: ``reasons`` and ``categories`` (a row may be in two)."""
    price, total, quantity = (F.col(c).cast("double") for c in ("unit_price", "line_total", "quantity"))
    expected = F.when(quantity > 0, price * quantity)
    off = F.coalesce((expected < total * 0.5) | ((F.abs(price - _fair()) > 1.0) & (expected < total * 0.9)), F.lit(False))
    article = article_quantity(1000)
    kept = unit_rows(rows).withColumn("reasons", flags((article, ARTICLE), (off, PRICE))).filter(F.size("reasons") > 0)
    is_article, is_price = F.array_contains("reasons", ARTICLE), F.array_contains("reasons", PRICE)
    tiny = F.coalesce((price < 10) & (total > 1000), F.lit(False))
    first = F.when(is_article, CATEGORIES[0]).when(tiny, CATEGORIES[1]).when(is_price & F.col("discount").isNotNull(), CATEGORIES[3]).when(is_price, CATEGORIES[2])
    spaced = F.when(F.coalesce((price < 100) & (total > 1000) & F.col("description").rlike(r"\d{1,3}(?:\s+\d{3})+(?:[.,]\d{2})?"), F.lit(False)), CATEGORIES[4])
    return kept.withColumn("categories", F.array_compact(F.array(first, spaced)))


def problem_counts(rows: DataFrame) -> DataFrame:
    """category and n over the rows that still have a problem."""
    return remaining_problems(rows).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def fix_check(rows: DataFrame) -> DataFrame:
    """Lines of any unit whose quantity of 100,000 or more is the article number of their description."""
    return rows.filter(article_quantity(100000))
