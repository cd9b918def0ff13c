"""Structured invoice queries: filter, aggregate, group, sort, limit, summarise, compare.

Order of evaluation is part of the meaning: aggregates and groups ignore the limit; summaries and
comparisons come after it.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QueryIntent:
    """``filters`` keys: supplier_name, invoice_number, status (value or list), date_from, date_to, amount_min, amount_max."""

    query_type: str = "filter"
    filters: dict = field(default_factory=dict)
    aggregations: tuple[str, ...] = ()
    group_by: str | None = None
    sort_by: str | None = None
    limit: int | None = None
    fold_case: bool = False



def total() -> Column:
    return F.coalesce("total_amount", F.lit(0).cast("decimal(18,2)"))


def filter_invoices(invoices: DataFrame, filters: dict, *, fold_case: bool = False) -> DataFrame:
    """A missing date passes both date bounds; a missing total counts as 0."""
    out = invoices
    for name in ("supplier_name", "invoice_number", "status"):
        if (v := filters.get(name)) is not None:
            values = list(v) if isinstance(v, (list, tuple, set)) else [v]
            if fold_case and name == "supplier_name":
                out = out.filter(F.lower(name).isin([x.lower() for x in values]))
            else:
                out = out.filter(F.col(name).isin(values))
    for name, test in (("date_from", "__ge__"), ("date_to", "__le__")):
        if (v := filters.get(name)) is not None:
            out = out.filter(F.col("invoice_date").isNull() | getattr(F.col("invoice_date"), test)(F.lit(v)))
    for name, test in (("amount_min", "__ge__"), ("amount_max", "__le__")):
        if (v := filters.get(name)) is not None:
            out = out.filter(getattr(total(), test)(F.lit(v)))
    return out


def aggregate(invoices: DataFrame, aggregations: tuple[str, ...] = ("sum", "count", "average")) -> DataFrame:
    """One row; the average over no rows is 0."""
    n, s = F.count(F.lit(1)), F.coalesce(F.sum(total()), F.lit(0)).cast("decimal(28,2)")
    made = {"sum": s.alias("sum"), "count": n.alias("count"), "average": F.when(n > 0, s.cast("double") / n).otherwise(0.0).alias("average")}
    return invoices.agg(*[made[a] for a in aggregations])


def group_key(group_by: str) -> Column:
    keys = {"supplier": F.col("supplier_name"), "date": F.col("invoice_date").cast("string"), "month": F.date_format("invoice_date", "yyyy-MM"), "status": F.col("status")}
    return F.coalesce(keys.get(group_by, F.lit(None).cast("string")), F.lit("Unknown"))


def group(invoices: DataFrame, group_by: str) -> DataFrame:
    """Group key with the count and sum of its invoices; members stay with the frame they came from, so no
    group is ever collected."""
    return invoices.groupBy(group_key(group_by).alias("group_key")).agg(F.count(F.lit(1)).alias("count"), F.sum(total()).cast("decimal(28,2)").alias("sum"))


def sort_order(sort_by: str | None) -> list[Column]:
    by = {"date": [F.desc_nulls_last("invoice_date")], "amount": [total().desc()], "supplier": [F.asc_nulls_first("supplier_name")]}
    return [*by.get(sort_by or "", []), F.asc("invoice_number")]


def sort_limit(invoices: DataFrame, sort_by: str | None, limit: int | None) -> DataFrame:
    """Ties keep the order of invoice numbers; a limit of 0 or None keeps all."""
    out = invoices.orderBy(*sort_order(sort_by))
    return out.limit(limit) if limit else out


def summary(invoices: DataFrame) -> DataFrame:
    """One row: total, count, sorted suppliers, date range, count per status."""
    status = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("OK", "PARTIAL", "REVIEW")]
    return invoices.agg(
        F.coalesce(F.sum(total()), F.lit(0)).cast("decimal(28,2)").alias("total"), F.count(F.lit(1)).alias("count"),
        F.array_join(F.array_sort(F.collect_set("supplier_name")), ",").alias("suppliers"), F.min("invoice_date").alias("date_min"), F.max("invoice_date").alias("date_max"), *status,
    )


def compare(invoices: DataFrame) -> DataFrame:
    s = F.sum(total()).cast("decimal(28,2)")
    return invoices.groupBy(F.coalesce("supplier_name", F.lit("Unknown")).alias("supplier_name")).agg(F.count(F.lit(1)).alias("count"), s.alias("total"), (s.cast("double") / F.count(F.lit(1))).alias("average"))


def execute(intent: QueryIntent, invoices: DataFrame) -> dict[str, DataFrame]:
    """Lazy frames: ``rows``, and ``aggregates``, ``groups``, ``summary`` or ``comparison`` where asked for."""
    kept = filter_invoices(invoices, intent.filters, fold_case=intent.fold_case)
    out = {"rows": sort_limit(kept, intent.sort_by, intent.limit)}
    if intent.aggregations:
        out["aggregates"] = aggregate(kept, intent.aggregations)
    if intent.group_by:
        out["groups"] = group(kept, intent.group_by)
    if intent.query_type == "summarize":
        out["summary"] = summary(out["rows"])
    if intent.query_type == "compare":
        out["comparison"] = compare(out["rows"])
    return out


#: Swedish and English month names.
MONTHS = (
    ("januari", "january"), ("februari", "february"), ("mars", "march"), ("april",), ("maj", "may"), ("juni", "june"),
    ("juli", "july"), ("augusti", "august"), ("september",), ("oktober", "october"), ("november",), ("december",),
)
_NAME = r"([A-Za-zÅÄÖåäö\s]+?)"
_SUPPLIER = (rf"från\s+{_NAME}(?:\s+i\s+|\s+från\s+|$)", rf"from\s+{_NAME}(?:\s+in\s+|\s+from\s+|$)", rf"leverantör\s+{_NAME}(?:\s+i\s+|$)", rf"supplier\s+{_NAME}(?:\s+in\s+|$)")


def parse_query(text: str, *, today: dt.date | None = None) -> QueryIntent:
    """Keywords to an intent. 'summary' holds 'sum', so it reads as an aggregate. Suppliers are lower-cased, so
    they are compared without case."""
    low = text.lower()
    has = lambda *words: any(w in low for w in words)
    kind = "aggregate" if has("summa", "total", "sum") else "summarize" if has("sammanfattning", "översikt") else "compare" if has("jämför", "compare", "sammenlign") else "filter"
    filters: dict = {}
    if m := next((m for p in _SUPPLIER if (m := re.search(p, low))), None):
        filters["supplier_name"] = m[1].strip()
    if month := next((i for language in (0, 1) for i, names in enumerate(MONTHS, 1) if names[min(language, len(names) - 1)] in low), None):
        found = re.search(r"\d{4}", text)
        year = int(found[0]) if found else (today or dt.date.today()).year
        filters |= {"date_from": dt.date(year, month, 1), "date_to": dt.date(year, month, calendar.monthrange(year, month)[1])}
    asked = (("sum", ("summa", "total", "sum")), ("count", ("antal", "count", "number")), ("average", ("genomsnitt", "average", "medel")))
    order = next((k for k, words in (("date", ("datum", "date")), ("amount", ("belopp", "amount")), ("supplier", ("leverantör", "supplier"))) if has(*words)), None)
    return QueryIntent(kind, filters, tuple(k for k, words in asked if has(*words)), None, order if has("sortera", "sort") else None, None, True)
