"""Text expressions: normal forms, keys, page counters, versions, and the text-quality score."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words whose presence suggests an invoice.
INVOICE_WORDS = ("total", "moms", "faktura", "bankgiro", "att betala", "summa")


def _folds() -> dict[str, str]:
    """Lower-case letters that are one letter and combining marks, and that letter: all of the planes' alphabetic scripts."""
    out = {}
    for cp in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(cp).lower()) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(cp).lower():
            out[chr(cp).lower()] = plain
    return {k: v for k, v in out.items() if len(k) == 1}


_FOLDS = _folds()
_ACCENTED, _PLAIN = "".join(_FOLDS), "".join(_FOLDS.values())


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain_lower(text: Column) -> Column:
    """Lower case without accents, white space collapsed."""
    return collapse(F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"\p{M}", ""))


def label_text(text: Column) -> Column:
    """Lower case, colon and hash as spaces, white space collapsed."""
    return collapse(F.translate(F.lower(text), ":#", "  "))


def path_key(text: Column, longest: int = 120) -> Column:
    """A path-safe key: other signs become one underscore, none at the ends, cut to ``longest``."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", ""), 1, longest)


def supplier_key(supplier: Column) -> Column:
    return F.when(F.coalesce(F.trim(supplier), F.lit("")) == "", F.lit("Unknown")).otherwise(F.lower(F.trim(supplier)))


def layout_hash(supplier: Column) -> Column:
    return F.md5(F.concat(supplier_key(supplier), F.lit("footer")).cast("binary"))


def garbled(text: Column) -> Column:
    t = strip_space(F.coalesce(text, F.lit("")))
    return (t == "") | t.rlike(r"\|[A-Za-z]{12,}|[A-Za-z]{12,}\||[a-z]{3,}[A-Z]")


def version_part(version: Column, part: int) -> Column:
    """Number ``part`` (0, 1, 2) of a dotted version; 0 where any of the three cannot be read."""
    parts = F.split(version, r"\.")
    read = [F.coalesce(F.get(parts, F.lit(i)), F.lit("0")).try_cast("int") for i in range(3)]
    sound = read[0].isNotNull() & read[1].isNotNull() & read[2].isNotNull()
    return F.when(sound, read[part]).otherwise(0)


def compatibility(artifact: Column, current: Column) -> Column:
    same = [version_part(artifact, i) == version_part(current, i) for i in range(3)]
    return F.when(artifact.isNull(), "UNKNOWN").when(same[0] & same[1] & same[2], "COMPATIBLE").when(same[0], "WARNING").otherwise("INCOMPATIBLE")


def page_counter(text: Column) -> Column:
    """struct(current, total) of 'Sida 1/2', 'page 1 av 3' or '1/2'; NULL unless 1 <= current <= total."""
    def read(pattern: str) -> Column:
        a, b = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2))
        return F.when((a >= 1) & (b >= a), F.struct(a.alias("current"), b.alias("total")))

    return F.coalesce(read(r"(?iu)\b(?:sida|page)\s*(\d{1,3})\s*(?:/|av)\s*(\d{1,3})\b"), read(r"\b(\d{1,3})\s*/\s*(\d{1,3})\b"))


def let(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _left(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("double")


def content_score(text: Column) -> Column:
    """Usability of a page's text in 0..1: enough content, clean characters, letters and digits,
    sane word lengths, and a little for invoice words. The text is split and its word lengths sorted once."""
    lengths = F.array_sort(F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), lambda w: F.length(w)))
    weird = _left(text, r"[\p{L}\p{N}\s.,/:;-]|(?U:\s)")
    alnum = _left(text, r"[^\p{L}\p{N}]")
    lower = F.lower(text)
    facts = F.struct(
        F.length(text).cast("double").alias("n"), lengths.alias("lengths"), weird.alias("weird"), alnum.alias("alnum"), F.filter(F.array(*[F.lit(w) for w in INVOICE_WORDS]), lambda w: F.contains(lower, w)).alias("known"),
    )

    def scored(x: Column) -> Column:
        n, count = x["n"], F.size(x["lengths"])
        middle = lambda i: F.get(x["lengths"], F.floor(i / 2).cast("int"))
        half = F.when(count > 0, (middle(count - 1) + middle(count)) / 2.0).otherwise(0.0)
        return let(half, lambda h: total(x, n, count.cast("double"), h))

    def total(x: Column, n: Column, count: Column, half: Column) -> Column:
        enough = F.least(F.lit(1.0), n / 30.0 * 0.5 + count / 5.0 * 0.5)
        clean = 1.0 - F.least(F.lit(1.0), x["weird"] / n * 2.0)
        sane = F.when(half.between(2, 20), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(half - 10) / 30.0))
        bonus = F.least(F.lit(0.2), F.size(x["known"]) * 0.05)
        raw = enough * 0.25 + clean * 0.3 + x["alnum"] / n * 0.25 + sane * 0.2 + bonus
        return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))

    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(let(facts, scored))
