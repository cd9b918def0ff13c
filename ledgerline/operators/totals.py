"""The invoice total: candidates with the kind of their label, scores, boosts, calibration, and the choice.

Footer rows have ``invoice_id``, ``row_idx``, ``y``, ``page_height`` and ``text``. An invoice whose footer holds no positive amount
has no result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import rows as R
from ledgerline.operators import calibration, extraction, learning, reconcile

#: Labels of totals with VAT, without VAT and of either kind; entries that hold a shorter one are left out.
WITH_VAT = (r"att\s+betala", r"attbetala", r"fakturabelopp", r"betalningsbelopp", r"betalas", r"inkl\.?\s*moms", r"inklusive\s+moms", r"med\s+moms", r"totalt?\s+moms\s+inkluderad", r"slutsumma")
WITHOUT_VAT = (r"exkl\.?\s*moms", r"exklusive\s+moms", r"utan\s+moms", r"delsumma", r"subtotal", r"momsfri\s+summa", r"momsfritt\s+belopp", r"netto")
GENERIC = (r"total", r"summa", r"belopp")
#: Words that show a total with VAT in the amount's own row.
OWN_LABELS = ("att betala", "attbetala", "inkl. moms", "inklusive moms", "betalas", "slutsumma")
#: Boost of a total with VAT and penalty of one without, by strategy.
BOOSTS, PENALTIES, LABEL_ELSEWHERE = {"aggressive": 0.20, "conservative": 0.10, None: 0.15}, {"aggressive": 0.05, "conservative": 0.15, None: 0.10}, 0.32
#: Strategies of the second pass.
SECOND_PASS = ("aggressive", "extended_patterns", "broader_search")
_PRIORITY = {"with_vat": 3, "generic": 2, "without_vat": 1}


def label_kind(text: Column) -> Column:
    """'with_vat', 'without_vat', 'generic' or NULL, in that order."""
    hit = lambda words: F.coalesce(text.rlike(f"(?iuU)(?:{'|'.join(words)})"), F.lit(False))
    return F.when(hit(WITH_VAT), "with_vat").when(hit(WITHOUT_VAT), "without_vat").when(hit(GENERIC), "generic")


def candidates(footer: DataFrame, sums: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """invoice_id, row_idx, amount, kind, label_here, position, score of every positive amount of a footer.

    An amount takes the kind of its own row's label. A label row without any number gives its kind to the amounts of the row
    below, once more beside their own. Amounts of the first row without a label take the kind of the last labelled row
    ``above`` the footer (invoice_id, row_idx, text)."""
    w = Window.partitionBy("invoice_id").orderBy("row_idx")
    text = F.coalesce("text", F.lit(""))
    marked = footer.withColumn("text", text).withColumn("_kind", label_kind(F.col("text"))).withColumn("_sums", R.positive_in(F.col("text"), R.SUM_AMOUNT))
    marked = marked.withColumn("_open", F.col("_kind").isNotNull() & (F.size(F.regexp_extract_all("text", F.lit(f"({R.SUM_AMOUNT})"), F.lit(1))) == 0))
    marked = marked.withColumn("_passed", F.when(F.lag("_open", 1, False).over(w), F.lag("_kind").over(w))).withColumn("_first", F.row_number().over(w) == 1)
    own = F.col("_kind")
    if above is not None:
        kinds = above.withColumn("_k", label_kind(F.col("text"))).filter("_k is not null").groupBy("invoice_id").agg(F.max_by("_k", "row_idx").alias("_above"))
        marked = marked.join(kinds, "invoice_id", "left")
        own = F.coalesce(own, F.when(F.col("_first"), F.col("_above")))
    # The label's row comes before its own: positions keep the order in which rows are read.
    offer = lambda kind, row: F.transform("_sums", lambda a, i: F.struct(a.alias("amount"), kind.alias("kind"), F.struct(row.alias("row"), i.alias("place")).alias("position")))
    offers = F.concat(F.when(F.col("_passed").isNotNull(), offer(F.col("_passed"), F.col("row_idx") - 1)).otherwise(F.array()), offer(own, F.col("row_idx")))
    low = F.lower("text")
    here = F.exists(F.array(*[F.lit(x) for x in OWN_LABELS]), lambda x: F.contains(low, x))
    scored = extraction.score_totals(marked.withColumn("_here", here), sums, offers, ("_here",))
    return scored.select("invoice_id", "row_idx", "amount", F.col("_offer.kind").alias("kind"), F.col("_here").alias("label_here"), F.col("_offer.position").alias("position"), "score")


def adjusted(score: Column, kind: Column, label_here: Column, strategy: str | None) -> Column:
    """The score with the boost or penalty of its kind."""
    boost = F.when(~label_here, LABEL_ELSEWHERE).otherwise(BOOSTS.get(strategy, BOOSTS[None]))
    penalty = PENALTIES.get(strategy, PENALTIES[None])
    return F.when(kind == "with_vat", F.least(F.lit(1.0), score + boost)).when(kind == "without_vat", F.greatest(F.lit(0.0), score - penalty)).otherwise(score)


def kind_rank(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in _PRIORITY.items()], F.lit(0))


def choose(found: DataFrame, sums: DataFrame, by: tuple[str, ...] = ("invoice_id",)) -> DataFrame:
    """The chosen candidate: totals with VAT first, then those that agree with the lines, then by score, kind and position."""
    agrees = reconcile.scaled_pass(F.col("amount"), F.col("amount") - F.col("lines_sum"))
    checked = found.join(sums.select("invoice_id", "lines_sum"), "invoice_id", "left").withColumn("validated", agrees)
    order = F.struct(F.coalesce(F.col("kind") != "with_vat", F.lit(True)), ~F.col("validated"), -F.round("score", 9), -kind_rank(F.col("kind")), "position")
    best = checked.groupBy(*by).agg(F.min_by(F.struct(F.col("amount").alias("total_amount"), F.col("score").alias("total_confidence"), "row_idx", F.col("kind").alias("keyword_type"), "validated"), order).alias("b"))
    return best.select(*by, "b.*")


def boosted(found: DataFrame, matches: DataFrame, patterns: DataFrame) -> DataFrame:
    """Scores raised (at most to 1) by the boost of the invoice's most similar pattern. ``matches`` is of ``learning.match_patterns``."""
    top = matches.filter("rank = 1").select("invoice_id", "pattern_id").join(patterns.select("pattern_id", F.coalesce("confidence_boost", F.lit(0.1)).alias("_boost")), "pattern_id").select("invoice_id", "_boost")
    return found.join(top, "invoice_id", "left").withColumn("score", F.least(F.lit(1.0), F.col("score") + F.coalesce("_boost", F.lit(0.0)))).drop("_boost")


def used(patterns: DataFrame, matches: DataFrame, now: Column) -> DataFrame:
    """Patterns with the uses of a run added: one for each invoice whose most similar pattern they are."""
    uses = matches.filter("rank = 1").groupBy("pattern_id").agg(F.count(F.lit(1)).alias("_uses"))
    out = patterns.join(uses, "pattern_id", "left")
    return learning.update_where(out, F.col("_uses").isNotNull(), {"usage_count": (F.col("usage_count") + F.col("_uses")).cast(patterns.schema["usage_count"].dataType), "last_used": now}).drop("_uses")


def final_totals(footer: DataFrame, sums: DataFrame, *, above: DataFrame | None = None, strategy: str | None = None, matches: DataFrame | None = None, patterns: DataFrame | None = None, fit: DataFrame | None = None) -> DataFrame:
    """invoice_id, total_amount, total_confidence, row_idx, keyword_type, validated. Pattern boosts come before
    calibration, which sees the boosted score."""
    found = candidates(footer, sums, above)
    found = found.withColumn("score", adjusted(F.col("score"), F.col("kind"), F.col("label_here"), strategy))
    if matches is not None and patterns is not None:
        found = boosted(found, matches, patterns)
    if fit is not None:
        found = calibration.apply_fit(found, fit, "score").withColumn("score", F.col("calibrated")).drop("calibrated")
    return choose(found, sums)


def retried_totals(footer: DataFrame, sums: DataFrame, *, above: DataFrame | None = None, target: float = 0.90, second_pass: bool = True) -> DataFrame:
    """The first strategy whose total reaches ``target``, else the most confident one, with the strategy; a second pass over three
    strategies follows where the first does not reach it. Candidates are found and scored once for all strategies."""
    tried = [*extraction.RETRY, *(SECOND_PASS if second_pass else ())]
    found = candidates(footer, sums, above)
    offers = F.array(*[F.struct(F.lit(i).alias("attempt"), F.lit(s).cast("string").alias("strategy"), adjusted(F.col("score"), F.col("kind"), F.col("label_here"), s).alias("score")) for i, s in enumerate(tried)])
    each = found.withColumn("_o", F.explode(offers)).withColumn("score", F.col("_o.score")).withColumn("attempt", F.col("_o.attempt")).withColumn("strategy", F.coalesce("_o.strategy", F.lit("standard"))).drop("_o")
    chosen = choose(each, sums, ("invoice_id", "attempt", "strategy"))
    hit = F.col("total_confidence") >= target
    order = F.struct(~hit, F.when(hit, 0.0).otherwise(-F.round("total_confidence", 9)), "attempt")
    best = chosen.groupBy("invoice_id").agg(F.min_by(F.struct("strategy", "total_amount", "total_confidence", "row_idx", "keyword_type", "validated", hit.alias("reached")), order).alias("b"))
    return best.select("invoice_id", "b.*")


def evidence(chosen: DataFrame, footer: DataFrame) -> DataFrame:
    """Chosen totals with ``excerpt``, the first 120 characters of their row."""
    return chosen.join(footer.select("invoice_id", "row_idx", F.substring("text", 1, 120).alias("excerpt")), ["invoice_id", "row_idx"], "left")
