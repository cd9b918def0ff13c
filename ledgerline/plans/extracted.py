"""Registered queries of header, footer and line extraction, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import rows
from ledgerline.operators import columns, extraction
from ledgerline.plans import views_sql as sql
from ledgerline.sources import files, tables

_HEADER_ROWS = """r AS (SELECT o_orderkey AS invoice_id, ['Sida 1/' || (o_orderkey % 3 + 1), CASE WHEN o_orderkey % 2 = 0 THEN 'Norra Verkstaden' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'Bygg ' || translate(o_custkey::VARCHAR, '0123456789', 'abcdefghij') || ' AB' END,
  CASE o_orderkey % 4 WHEN 0 THEN 'Fakturanummer' WHEN 3 THEN 'Kund' ELSE 'Faktura nr: ' || (o_orderkey + 1000000) END, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey + 1000000)::VARCHAR WHEN 3 THEN 'ID ' || (o_orderkey + 1000000) ELSE '2024-08-22' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'Er referens: RF ' || o_orderkey END] AS t FROM orders),
  h AS (SELECT invoice_id, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS row_idx FROM r), hr AS (SELECT * FROM h WHERE text IS NOT NULL)"""
_NET = "CAST(o_totalprice AS DECIMAL(18,2))"
_ITEMS = """o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k FROM lineitem)"""


def _supplier(s: SparkSession, d: str) -> DataFrame:
    return extraction.pick_supplier(tables.rendered_headers(s, d))


def _number(s: SparkSession, d: str) -> DataFrame:
    return extraction.pick_number(tables.rendered_headers(s, d)).withColumn("score", F.round("score", 6))


def _net_gross(s: SparkSession, d: str) -> DataFrame:
    footer = tables.rendered_footers(s, d)
    both = extraction.footer_total(footer, extraction.NET, "net").join(extraction.footer_total(footer, extraction.GROSS, "gross"), "invoice_id")
    return both.select("invoice_id", *(F.col(c).cast("decimal(18,2)").alias(c) for c in ("net", "gross")))


def _sums(s: SparkSession, d: str) -> DataFrame:
    return tables.lines(s, d).groupBy("invoice_id").agg(F.sum("line_total").cast("decimal(18,2)").alias("lines_sum"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    return extraction.score_totals(tables.rendered_footers(s, d), _sums(s, d)).select("invoice_id", "row_idx", F.col("amount").cast("decimal(18,2)").alias("amount"), "largest", F.round("score", 6).alias("score"))


def _shown(s: SparkSession, d: str) -> DataFrame:
    footer = tables.rendered_footers(s, d)
    return extraction.shown_candidates(extraction.score_totals(footer, _sums(s, d)), footer).select("invoice_id", "rank", F.col("amount").cast("decimal(18,2)").alias("amount"), "row_idx")


def _attempts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    tried = F.transform(F.array(*[F.lit(x) for x in extraction.RETRY]), lambda x, i: F.struct(i.alias("attempt"), x.alias("strategy"), ((k * (i + 3)) % 100 / F.lit(100.0)).alias("confidence")))
    listed = tables.table(s, d, "orders").select(k.alias("invoice_id"), F.explode(tried).alias("t")).select("invoice_id", "t.*")
    return extraction.retry(listed, 0.95)


def _truth(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = tables.table(s, d, "customer").select(
        F.when(k % 7 == 0, "x").when(k % 11 == 0, "1.5").otherwise((k % 4 / F.lit(4.0)).cast("string")).alias("raw_confidence"),
        F.when(k % 3 == 0, " Yes ").when(k % 3 == 1, "1").otherwise("no").alias("actual_correct"),
    )
    return files.truth_rows(raw, strict=False).groupBy("raw_confidence", "actual_correct").agg(F.count(F.lit(1)).alias("n"))


def _amounts(s: SparkSession, d: str) -> DataFrame:
    found = tables.rendered_items(s, d).withColumn("a", rows.line_amount(F.col("text"))).filter("a is not null")
    return found.select("invoice_id", "row_idx", F.col("a.amount").cast("decimal(18,2)").alias("amount"), F.col("a.discount").cast("decimal(18,2)").alias("discount"), rows.starts_item(F.col("text")).alias("starts"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return extraction.item_lines(tables.rendered_items(s, d)).select("invoice_id", "line_number", "description", F.col("quantity").cast("decimal(18,2)").alias("quantity"), "unit", F.col("amount").cast("decimal(18,2)").alias("amount"))


def _context(s: SparkSession, d: str) -> DataFrame:
    return extraction.page_context(tables.rendered_headers(s, d).withColumn("segment_type", F.when(F.col("y") < 70, "header").otherwise("items")))


_MATHS = """CASE WHEN s IS NULL THEN 0 WHEN abs(a - s) <= CASE WHEN a > 1000 THEN greatest(1.0, a * 0.005) ELSE 1.0 END THEN 0.32
  WHEN a > 1000 THEN CASE WHEN abs(a - s) / a * 100 <= 0.5 THEN 0.30 WHEN abs(a - s) / a * 100 <= 1 THEN 0.26 WHEN abs(a - s) / a * 100 <= 2 THEN 0.20 WHEN abs(a - s) / a * 100 <= 5 THEN 0.14 WHEN abs(a - s) / a * 100 <= 10 THEN 0.07 ELSE 0.03 END
  WHEN abs(a - s) <= 2 THEN 0.28 WHEN abs(a - s) <= 5 THEN 0.23 WHEN abs(a - s) <= 20 THEN 0.16 WHEN abs(a - s) <= 50 THEN 0.09 ELSE 0.05 END"""
# Net: keyword .28, place .18, VAT in the next row .05. Gross: keyword .32 and currency .03 where on its label's row, place .18, size .08, VAT two rows above .03.
_TOTALS = f"""WITH {sql.LINES}, q AS (SELECT invoice_id, CAST(sum(line_total) AS DECIMAL(18,2)) AS s FROM lines GROUP BY 1), f AS (
  SELECT o_orderkey AS invoice_id, 0 AS row_idx, {_NET} AS a, false AS largest, 0.51 AS base FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 2 END, CAST({_NET} * 2 AS DECIMAL(18,2)), true, CASE WHEN o_orderkey % 3 = 0 THEN 0.29 ELSE 0.64 END FROM orders)
  SELECT f.invoice_id, row_idx, a AS amount, largest, round(least(1.0, base + {_MATHS})::DOUBLE, 6) AS score FROM f LEFT JOIN q ON f.invoice_id = q.invoice_id"""
_TRIED = """WITH t AS (SELECT o_orderkey AS invoice_id, i AS attempt, [NULL, 'aggressive', 'conservative', 'extended_patterns', 'broader_search'][i + 1] AS strategy, (o_orderkey * (i + 3)) % 100 / CAST(100.0 AS DOUBLE) AS confidence FROM orders, range(5) x(i))
  SELECT invoice_id, strategy, confidence, confidence >= 0.95 AS reached FROM t QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY (confidence < 0.95), CASE WHEN confidence >= 0.95 THEN 0 ELSE -confidence END, attempt) = 1"""

QUERIES = {
    "supplier_pick": _supplier, "reference_pick": lambda s, d: extraction.pick_reference(tables.rendered_headers(s, d)), "label_number_extract": _number, "footer_net_gross": _net_gross, "total_scores": _scored, "candidate_uniqueness": _shown,
    "strategy_retry": _attempts, "ground_truth_load": _truth, "amount_candidates": _amounts, "line_items": _lines, "page_context": _context, "column_centres": lambda s, d: columns.detect_columns(tables.tokens(s, d)),
}

ORACLES = {
    "supplier_pick": f"""WITH {_HEADER_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY row_idx) AS n FROM hr)
    SELECT invoice_id, text AS supplier_name FROM n WHERE n <= 5 AND NOT regexp_matches(lower(text), 'faktura|sida|referens|date|datum|sek|kr|page|\\d{{4}}-\\d{{2}}-\\d{{2}}') AND len(regexp_replace(text, '[^0-9]', '', 'g')) <= 0.7 * len(text)
    QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY (text NOT LIKE '%AB%'), n) = 1""",
    "reference_pick": f"WITH {_HEADER_ROWS} SELECT invoice_id, regexp_extract(lower(text), 'referens: (.*)$', 1) AS reference FROM hr WHERE text LIKE 'Er referens%'",
    "label_number_extract": "SELECT o_orderkey AS invoice_id, CAST(o_orderkey + 1000000 AS VARCHAR) AS invoice_number, CASE o_orderkey % 4 WHEN 0 THEN 0.95 WHEN 3 THEN 0.65 ELSE 1.0 END::DOUBLE AS score FROM orders",
    "footer_net_gross": f"SELECT o_orderkey AS invoice_id, {_NET} AS net, CAST({_NET} * 2 AS DECIMAL(18,2)) AS gross FROM orders",
    "total_scores": _TOTALS,
    "candidate_uniqueness": f"""WITH t AS ({_TOTALS}) SELECT invoice_id, CAST(row_number() OVER (PARTITION BY invoice_id ORDER BY (largest AND row_idx = 2) DESC, score DESC, row_idx) AS INT) AS rank, amount, row_idx FROM t""",
    "strategy_retry": _TRIED,
    "ground_truth_load": "SELECT c_custkey % 4 / CAST(4.0 AS DOUBLE) AS raw_confidence, c_custkey % 3 <> 2 AS actual_correct, count(*) AS n FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 GROUP BY 1, 2",
    "amount_candidates": f"WITH {_ITEMS} SELECT l_orderkey AS invoice_id, CAST(k * 2 AS INT) AS row_idx, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_quantity AS DECIMAL(18,2)) AS discount, true AS starts FROM o",
    "line_items": f"WITH {_ITEMS} SELECT l_orderkey AS invoice_id, CAST(k AS INT) AS line_number, CASE WHEN k % 3 = 0 THEN '70000' || l_partkey || ' Skruv rostfri stor ' || CAST(l_quantity AS INT) || ' st ' || replace(CAST(l_extendedprice AS DECIMAL(18,2))::VARCHAR, '.', ',') || ' med bricka' ELSE 'Skruv rostfri stor' END AS description, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, 'st' AS unit, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM o",
    "page_context": f"""WITH {_HEADER_ROWS}, p AS (SELECT invoice_id, CASE WHEN row_idx * 20 + 20 < 70 THEN 'header' ELSE 'items' END AS seg, string_agg(text, chr(10) ORDER BY row_idx) AS t FROM hr GROUP BY 1, 2)
    SELECT invoice_id, string_agg('--- ' || upper(seg) || ' ---' || chr(10) || t, chr(10) ORDER BY seg) AS context FROM p GROUP BY 1""",
}
