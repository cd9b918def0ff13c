"""Registered queries of the invoice engine, each with its DuckDB oracle where SQL can say it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import numbers, text
from ledgerline.operators import analytics, calibration, layout, learning, reconcile, routing
from ledgerline.plans import checked, extracted, page_sql
from ledgerline.plans import views_sql as sql
from ledgerline.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def registered(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return _QUERIES | extracted.QUERIES | checked.QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES | extracted.ORACLES | checked.ORACLES | page_sql.ORACLES


INVOICE = ["invoice_number", "supplier_name", "invoice_date", "total_amount", "status"]
_COLUMNS = ", ".join(INVOICE)
JANUARY = {"date_from": dt.date(1996, 1, 1), "date_to": dt.date(1996, 1, 31)}
FRANCE_1996 = {"supplier_name": "FRANCE", "date_from": dt.date(1996, 1, 1), "date_to": dt.date(1996, 12, 31)}
_TOTAL = "coalesce(total_amount, 0)"
_FR96 = "(invoice_date IS NULL OR invoice_date >= DATE '1996-01-01') AND (invoice_date IS NULL OR invoice_date <= DATE '1996-12-31')"

# --- filters ---


def _filter(filters: dict) -> Query:
    return lambda s, d: analytics.filter_invoices(tables.invoices(s, d), filters).select(INVOICE)


registered("invoice_filter_supplier_month", f"WITH {sql.INV} SELECT {_COLUMNS} FROM inv WHERE supplier_name = (SELECT min(n_name) FROM nation) AND (invoice_date IS NULL OR (invoice_date >= DATE '1996-01-01' AND invoice_date <= DATE '1996-01-31'))")(
    lambda s, d: analytics.filter_invoices(tables.invoices(s, d).join(F.broadcast(tables.table(s, d, "nation").agg(F.min("n_name").alias("_n"))), F.col("supplier_name") == F.col("_n"), "left_semi"), JANUARY).select(INVOICE)
)
registered("invoice_filter_in_lists", f"WITH {sql.INV} SELECT {_COLUMNS} FROM inv WHERE status IN ('OK', 'PARTIAL') AND invoice_number IN ('1', '2', '3', '5', '8', '13', '21', '34', '55', '89')")(_filter({"status": ["OK", "PARTIAL"], "invoice_number": ["1", "2", "3", "5", "8", "13", "21", "34", "55", "89"]}))
registered("invoice_filter_amount_null", f"WITH {sql.INV} SELECT {_COLUMNS} FROM inv WHERE {_TOTAL} >= 0 AND {_TOTAL} <= 50000")(_filter({"amount_min": 0, "amount_max": 50000}))
registered("invoice_filter_null_date", f"WITH {sql.INV} SELECT {_COLUMNS} FROM inv WHERE invoice_date IS NULL OR (invoice_date >= DATE '1998-01-01' AND invoice_date <= DATE '1998-03-31')")(_filter({"date_from": dt.date(1998, 1, 1), "date_to": dt.date(1998, 3, 31)}))

# --- aggregates, groups, order ---

_AGG = f"SELECT CAST(coalesce(sum({_TOTAL}), 0) AS DECIMAL(28,2)) AS sum, count(*) AS count, CASE WHEN count(*) > 0 THEN CAST(CAST(coalesce(sum({_TOTAL}), 0) AS DECIMAL(28,2)) AS DOUBLE) / count(*) ELSE 0.0 END AS average"
registered("invoice_agg", f"WITH {sql.INV} {_AGG} FROM inv WHERE status = 'OK'")(lambda s, d: analytics.execute(analytics.QueryIntent("aggregate", {"status": "OK"}, ("sum", "count", "average"), limit=3), tables.invoices(s, d))["aggregates"])
registered("invoice_agg_empty", f"WITH {sql.INV} {_AGG} FROM inv WHERE supplier_name = 'NOWHERE'")(lambda s, d: analytics.aggregate(analytics.filter_invoices(tables.invoices(s, d), {"supplier_name": "NOWHERE"})))
for _by, _key in (("supplier", "supplier_name"), ("date", "CAST(invoice_date AS VARCHAR)"), ("month", "strftime(invoice_date, '%Y-%m')"), ("status", "status"), ("other", "NULL")):
    registered(f"invoice_group_{_by}", f"WITH {sql.INV} SELECT coalesce({_key}, 'Unknown') AS group_key, count(*) AS count, CAST(sum({_TOTAL}) AS DECIMAL(28,2)) AS sum FROM inv GROUP BY 1")(lambda s, d, by=_by: analytics.group(tables.invoices(s, d), by))


def _ranked(sort_by: str | None, limit: int) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        top = analytics.sort_limit(tables.invoices(s, d), sort_by, limit)
        return top.select("invoice_number", F.row_number().over(Window.orderBy(*analytics.sort_order(sort_by))).alias("rank"))  # over the limit's rows only

    return run


for _by, _order in (("date", "invoice_date DESC NULLS LAST, "), ("amount", f"{_TOTAL} DESC, "), ("supplier", "supplier_name ASC NULLS FIRST, "), (None, "")):
    registered(f"invoice_sort_{_by or 'none'}_limit", f"WITH {sql.INV} SELECT invoice_number, CAST(row_number() OVER (ORDER BY {_order}invoice_number) AS INT) AS rank FROM inv QUALIFY rank <= 100")(_ranked(_by, 100))
_TOP = f"top AS (SELECT * FROM inv ORDER BY {_TOTAL} DESC, invoice_number LIMIT 200)"
registered("invoice_summary", f"WITH {sql.INV}, {_TOP} SELECT CAST(sum({_TOTAL}) AS DECIMAL(28,2)) AS total, count(*) AS count, array_to_string(list_sort(list_distinct(list(supplier_name))), ',') AS suppliers, min(invoice_date) AS date_min, max(invoice_date) AS date_max, count(*) FILTER (status = 'OK') AS n_ok, count(*) FILTER (status = 'PARTIAL') AS n_partial, count(*) FILTER (status = 'REVIEW') AS n_review FROM top")(
    lambda s, d: analytics.execute(analytics.QueryIntent("summarize", sort_by="amount", limit=200), tables.invoices(s, d))["summary"]
)
registered("invoice_compare", f"WITH {sql.INV}, {_TOP} SELECT supplier_name, count(*) AS count, CAST(sum({_TOTAL}) AS DECIMAL(28,2)) AS total, CAST(CAST(sum({_TOTAL}) AS DECIMAL(28,2)) AS DOUBLE) / count(*) AS average FROM top GROUP BY supplier_name")(
    lambda s, d: analytics.execute(analytics.QueryIntent("compare", sort_by="amount", limit=200), tables.invoices(s, d))["comparison"]
)
registered("keyword_query", f"WITH {sql.INV} SELECT CAST(coalesce(sum({_TOTAL}), 0) AS DECIMAL(28,2)) AS sum, count(*) AS count FROM inv WHERE lower(supplier_name) = 'france' AND (invoice_date IS NULL OR (invoice_date >= DATE '1996-03-01' AND invoice_date <= DATE '1996-03-31'))")(
    lambda s, d: analytics.execute(analytics.parse_query("Totalsumma och antal i mars 1996 från France"), tables.invoices(s, d))["aggregates"]
)

# --- reconciliation ---


def reconciled(s: SparkSession, d: str) -> DataFrame:
    h = reconcile.line_sums(tables.headers(s, d), tables.lines(s, d)).withColumn("diff", reconcile.difference())
    gate = reconcile.hard_gate(F.col("number_confidence"), F.col("total_confidence"))
    h = h.withColumns({"gate": gate, "flat_ok": reconcile.flat_pass(F.col("diff")), "scaled_ok": reconcile.scaled_pass(F.col("header_total"), F.col("diff"))})
    return h.withColumn("status", reconcile.status(F.col("gate"), F.col("header_total"), F.col("n_lines"), F.col("scaled_ok")))


registered("recon_lines_sum", f"WITH {sql.HEADERS} SELECT invoice_id, lines_sum, diff, flat_ok AS passed FROM v")(lambda s, d: reconciled(s, d).select("invoice_id", "lines_sum", "diff", F.col("flat_ok").alias("passed")))
registered("recon_pct_tolerance", f"WITH {sql.HEADERS} SELECT invoice_id, flat_ok, scaled_ok FROM v")(lambda s, d: reconciled(s, d).select("invoice_id", "flat_ok", "scaled_ok"))


registered("invoice_status", f"WITH {sql.HEADERS} SELECT invoice_id, gate, status FROM v")(lambda s, d: reconciled(s, d).select("invoice_id", "gate", "status"))


_SCORE = ["invoice_id", "status_penalty", "missing_penalty", "difference_penalty", "wrap_penalty", "score"]
registered("quality_score", f"WITH {sql.HEADERS} SELECT {', '.join(_SCORE)} FROM sc")(lambda s, d: reconcile.quality(reconciled(s, d)).select(_SCORE))
registered("batch_rollup", f"WITH {sql.HEADERS} SELECT file_id, ['OK','PARTIAL','REVIEW','FAILED'][max(CASE status WHEN 'OK' THEN 1 WHEN 'PARTIAL' THEN 2 ELSE 3 END)] AS worst_status, min(score) AS least_score, count(*) FILTER (status = 'OK') AS n_ok, count(*) FILTER (status = 'PARTIAL') AS n_partial, count(*) FILTER (status = 'REVIEW') AS n_review, CAST(0 AS BIGINT) AS n_failed FROM sc GROUP BY file_id")(
    lambda s, d: reconcile.roll_up(reconcile.quality(reconciled(s, d)), "file_id")
)


def export(s: SparkSession, d: str) -> DataFrame:
    """Lines with their invoice's attributes repeated."""
    part = tables.table(s, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("description"))
    inv = tables.invoices(s, d).select("invoice_id", "invoice_number", "supplier_name", "invoice_date", F.col("total_amount").alias("total"), "status")
    return tables.lines(s, d).join(inv, "invoice_id").join(part, "part_id", "left")


_EXPORT = f"{sql.INV}, {sql.LINES}, ex AS (SELECT l.invoice_id, line_number, p_name AS description, quantity, discount, line_total, invoice_number, supplier_name, invoice_date, total_amount AS total, status FROM lines l JOIN inv ON l.invoice_id = inv.invoice_id LEFT JOIN part ON part_id = p_partkey)"
_EX = ["invoice_id", "line_number", "description", "quantity", "discount", "line_total", "invoice_number", "supplier_name", "invoice_date", "total", "status"]
registered("export_rows", f"WITH {_EXPORT} SELECT {', '.join(_EX)} FROM ex")(lambda s, d: export(s, d).select(_EX))
registered("global_line_numbers", f"WITH {sql.LINES} SELECT invoice_id, line_number, part_id, line_total, CAST(row_number() OVER (PARTITION BY invoice_id ORDER BY line_number, part_id, line_total, quantity, discount) AS INT) AS global_number FROM lines")(
    lambda s, d: tables.lines(s, d).select("invoice_id", "line_number", "part_id", "line_total", F.row_number().over(Window.partitionBy("invoice_id").orderBy("line_number", "part_id", "line_total", "quantity", "discount")).alias("global_number"))
)
# --- scalar parsing ---

_RENDER = "CASE o_orderkey % 6 WHEN 0 THEN replace(CAST(t AS VARCHAR), '.', ',') WHEN 1 THEN '-' || CAST(t AS VARCHAR) WHEN 2 THEN replace(CAST(t AS VARCHAR), '.', ',') || ' kr' WHEN 3 THEN 'SEK ' || CAST(t AS VARCHAR) WHEN 4 THEN CAST(t AS VARCHAR) || '-' ELSE 'x' || CAST(t AS VARCHAR) END"


@registered(
    "number_parse",
    "WITH r AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders) SELECT o_orderkey AS invoice_id, CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 6 IN (1, 4) THEN -CAST(t AS DECIMAL(18,4)) ELSE CAST(t AS DECIMAL(18,4)) END AS value, o_orderkey % 6 IN (0, 2, 3) AND t > 0 AS is_amount FROM r",
)
def number_parse(s: SparkSession, d: str) -> DataFrame:
    o = tables.table(s, d, "orders").select("o_orderkey", tables.money(F.col("o_totalprice")).cast("string").alias("t"))
    k, comma = F.col("o_orderkey") % 6, F.replace(F.col("t"), F.lit("."), F.lit(","))
    shown = F.when(k == 0, comma).when(k == 1, F.concat(F.lit("-"), "t")).when(k == 2, F.concat(comma, F.lit(" kr"))).when(k == 3, F.concat(F.lit("SEK "), "t")).when(k == 4, F.concat("t", F.lit("-"))).otherwise(F.concat(F.lit("x"), "t"))
    o = o.withColumn("shown", shown)
    return o.select(F.col("o_orderkey").alias("invoice_id"), numbers.parse_number(F.col("shown")).alias("value"), numbers.parse_amount(F.col("shown")).isNotNull().alias("is_amount"))


@registered(
    "text_normalise",
    r"SELECT s_suppkey, regexp_replace(lower(strip_accents('Ålands  ' || s_name || ' Société')), '\s+', ' ', 'g') AS plain, trim(regexp_replace(translate(lower('Fakt:nr # ' || s_name), ':#', '  '), '\s+', ' ', 'g')) AS label, regexp_replace(regexp_replace('a/b ' || s_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS path FROM supplier",
)
def text_normalise(s: SparkSession, d: str) -> DataFrame:
    n = F.col("s_name")
    t = tables.table(s, d, "supplier")
    return t.select("s_suppkey", text.plain_lower(F.concat(F.lit("Ålands  "), n, F.lit(" Société"))).alias("plain"), text.label_text(F.concat(F.lit("Fakt:nr # "), n)).alias("label"), text.path_key(F.concat(F.lit("a/b "), n)).alias("path"))


@registered(
    "version_bands",
    """WITH v AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '1.2.3' WHEN 2 THEN '1.2.9' WHEN 3 THEN '1.' || c_custkey WHEN 4 THEN '2.0.0' ELSE 'x.y' END AS version FROM customer)
    SELECT c_custkey, CASE WHEN version IS NULL THEN 'UNKNOWN' WHEN version = '1.2.3' THEN 'COMPATIBLE' WHEN version LIKE '1.%' THEN 'WARNING' ELSE 'INCOMPATIBLE' END AS band FROM v""",
)
def version_bands(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    v = F.when(k % 6 == 1, "1.2.3").when(k % 6 == 2, "1.2.9").when(k % 6 == 3, F.concat(F.lit("1."), k)).when(k % 6 == 4, "2.0.0").when(k % 6 == 5, "x.y")
    return tables.table(s, d, "customer").select("c_custkey", text.compatibility(v, F.lit("1.2.3")).alias("band"))


# --- text quality and routing ---

registered(
    "text_layer_route",
    r"""WITH t AS (SELECT doc_id, trim(text, E' \n\t\r') AS t FROM documents), w AS (SELECT doc_id, t, length(t) AS text_chars, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS word_tokens FROM t)
    SELECT doc_id, text_chars, CAST(word_tokens AS INT) AS word_tokens, text_chars >= 500 AND regexp_matches(t, '(?i)\bthe\b') AS base_ok FROM w""",
)(
    lambda s, d: routing.text_layer(tables.table(s, d, "documents"), routing.RoutingConfig(required=(r"\bthe\b",), extra=(), allow_quality_override=False)).select("doc_id", F.col("text_chars").cast("long").alias("text_chars"), "word_tokens", F.col("use_text_layer").alias("base_ok"))
)


def _routed(s: SparkSession, d: str) -> DataFrame:
    return routing.text_layer(tables.table(s, d, "documents"), routing.RoutingConfig(required=(r"\bthe\b",), extra=(r"\bof\b",)))


registered("text_quality")(lambda s, d: _routed(s, d).select("doc_id", F.round("text_quality", 9).alias("text_quality"), "use_text_layer", F.array_join("reasons", ",").alias("reasons")))
registered("edi_signals")(lambda s, d: routing.structured_signals(_routed(s, d), required=(r"\bthe\b",), extra=(r"\bof\b",), tables=(r"\|",)).select("doc_id", "edi_like", F.array_join("signals", ",").alias("signals")))
registered("policy_gate")(
    lambda s, d: routing.policy_gate(routing.structured_signals(_routed(s, d), required=(r"\bthe\b",), extra=(), tables=(r"\|",)).withColumn("status", F.when(F.col("doc_id") % 3 == 0, "OK").when(F.col("doc_id") % 3 == 1, "REVIEW"))).select("doc_id", "allow_ai", "gate_reason")
)
registered(
    "document_type",
    """WITH f AS (SELECT doc_id // 4 AS file_id, length(trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END, E' \\n\\t\\r')) AS n FROM documents), g AS (SELECT file_id, count(*) FILTER (n > 0) AS pages_with_text, CAST(sum(n) AS BIGINT) AS total_chars, count(*) AS n_pages FROM f GROUP BY 1), h AS (SELECT *, pages_with_text / n_pages AS share FROM g)
    SELECT file_id, pages_with_text, total_chars, n_pages, CASE WHEN (share >= 0.5 AND total_chars > 50) OR (share >= 0.3 AND total_chars > 20) THEN 'searchable' ELSE 'scanned' END AS pdf_type, CASE WHEN (share >= 0.5 AND total_chars > 50) OR (share >= 0.3 AND total_chars > 20) THEN 'text' ELSE 'ocr' END AS route,
    CASE WHEN share >= 0.8 AND total_chars > 200 THEN 'HIGH' WHEN share >= 0.5 AND total_chars > 50 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM h""",
)(lambda s, d: routing.document_type(tables.table(s, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("file_id"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("text"))))

@registered(
    "choose_best",
    f"""WITH {sql.HEADERS}, p AS (SELECT invoice_id, scaled_ok AS a_ok, CASE WHEN invoice_id % 23 = 0 THEN 'FAILED' ELSE status END AS a_status, total_confidence AS a_t, number_confidence AS a_n, invoice_id % 4 = 0 AS b_ok, 'OK' AS b_status, CAST(0.95 AS DOUBLE) AS b_t, CAST(0.93 AS DOUBLE) AS b_n FROM v),
    k AS (SELECT invoice_id, CASE WHEN a_status = 'FAILED' THEN false ELSE a_ok END AS ao, CASE WHEN a_status = 'FAILED' THEN 0 ELSE a_t END AS tc, CASE WHEN a_status = 'FAILED' THEN 0 ELSE a_n END AS an, b_ok AS bo, b_t AS bt, b_n AS bn FROM p)
    SELECT invoice_id, CASE WHEN ao AND NOT bo THEN 'a' WHEN bo AND NOT ao THEN 'b' WHEN tc > bt THEN 'a' WHEN bt > tc THEN 'b' WHEN an >= bn THEN 'a' ELSE 'b' END AS chosen FROM k""",
)
def choose_best(s: SparkSession, d: str) -> DataFrame:
    v, k = reconciled(s, d), F.col("invoice_id")
    a = {"a_ok": F.col("scaled_ok"), "a_status": F.when(k % 23 == 0, "FAILED").otherwise(F.col("status")), "a_total_confidence": F.col("total_confidence"), "a_number_confidence": F.col("number_confidence")}
    b = {"b_ok": k % 4 == 0, "b_status": F.lit("OK"), "b_total_confidence": F.lit(0.95), "b_number_confidence": F.lit(0.93)}
    return reconcile.choose_best(v.withColumns(a | b)).select("invoice_id", "chosen")


# --- learning ---

registered("corrections_keep_best", f"WITH {sql.CORRECTIONS} SELECT invoice_id, supplier_name, corrected_total, confidence, arrival FROM cor QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY coalesce(confidence, 0) DESC, arrival) = 1")(
    lambda s, d: learning.keep_best(tables.corrections(s, d)).select("invoice_id", "supplier_name", "corrected_total", "confidence", "arrival")
)
registered(
    "corrections_apply",
    f"WITH {sql.INV}, {sql.CORRECTIONS}, last AS (SELECT invoice_id, corrected_total FROM cor QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY arrival DESC) = 1) SELECT inv.invoice_id, corrected_total, coalesce(corrected_total, total_amount) AS final_total FROM inv LEFT JOIN last ON inv.invoice_id = last.invoice_id",
)(lambda s, d: learning.apply_corrections(tables.invoices(s, d).withColumnRenamed("total_amount", "total"), tables.corrections(s, d)).select("invoice_id", "corrected_total", "final_total"))
registered(
    "pattern_extract",
    f"WITH {sql.CORRECTIONS}, k AS (SELECT corrected_total, CASE WHEN coalesce(trim(supplier_name), '') = '' THEN 'Unknown' ELSE lower(trim(supplier_name)) END AS supplier_name FROM cor WHERE corrected_total IS NOT NULL) SELECT supplier_name, md5(supplier_name || 'footer') AS layout_hash, count(*) AS n, CAST(sum(corrected_total) AS DECIMAL(28,2)) AS total FROM k GROUP BY 1, 2",
)(lambda s, d: learning.extract_patterns(tables.corrections(s, d)).groupBy("supplier_name", "layout_hash").agg(F.count(F.lit(1)).alias("n"), F.sum("corrected_total").cast("decimal(28,2)").alias("total")))


def _queried(s: SparkSession, d: str) -> DataFrame:
    """The stated query set of the similarity search: events whose id is divisible by 20."""
    k = F.col("event_id")
    return tables.table(s, d, "events").filter(k % 20 == 0).select(k.alias("invoice_id"), F.col("event_type").alias("supplier_name"), F.md5(F.concat(F.col("event_type"), F.when(k % 100 == 0, "footer").otherwise("other")).cast("binary")).alias("layout_hash"), F.when(k % 150 != 0, (k % 500).cast("double")).alias("position_x"), F.when(k % 150 != 0, (k % 700).cast("double")).alias("position_y"))


registered(
    "pattern_similarity_topk",
    f"""WITH {sql.PATTERNS}, i AS (SELECT event_id AS invoice_id, event_type AS supplier_name, md5(event_type || CASE WHEN event_id % 100 = 0 THEN 'footer' ELSE 'other' END) AS layout_hash, CASE WHEN event_id % 150 <> 0 THEN CAST(event_id % 500 AS DOUBLE) END AS x, CASE WHEN event_id % 150 <> 0 THEN CAST(event_id % 700 AS DOUBLE) END AS y FROM events WHERE event_id % 20 = 0),
    s AS (SELECT invoice_id, pattern_id, CASE WHEN i.layout_hash = p.layout_hash THEN 0.5 ELSE 0.0 END::DOUBLE + CASE WHEN x IS NULL AND position_x IS NULL THEN 0.25 WHEN x IS NULL OR position_x IS NULL THEN 0.0 ELSE CAST(0.5 AS DOUBLE) / (sqrt((position_x - x) * (position_x - x) + (position_y - y) * (position_y - y)) / CAST(100.0 AS DOUBLE) + 1.0) END AS similarity FROM i JOIN pat p ON i.supplier_name = p.supplier_name)
    SELECT invoice_id, CAST(row_number() OVER (PARTITION BY invoice_id ORDER BY similarity DESC, pattern_id) AS INT) AS rank, pattern_id, round(similarity, 9) AS similarity FROM s WHERE similarity >= 0.5 QUALIFY rank <= 3""",
)(lambda s, d: learning.match_patterns(_queried(s, d), tables.patterns(s, d)).withColumn("similarity", F.round("similarity", 9)))
registered(
    "pattern_conflicts",
    f"""WITH {sql.PATTERNS}, c AS (SELECT *, CASE WHEN position_x IS NOT NULL THEN floor(position_x / 10)::BIGINT || '::' || floor(position_y / 10)::BIGINT ELSE 'none' END AS cell FROM pat),
    r AS (SELECT *, min(correct_total) OVER w AS lo, max(correct_total) OVER w AS hi, row_number() OVER (PARTITION BY supplier_name, layout_hash, cell ORDER BY usage_count DESC, confidence_boost DESC, pattern_id) AS k FROM c WINDOW w AS (PARTITION BY supplier_name, layout_hash, cell)) SELECT pattern_id FROM r WHERE lo = hi OR k = 1""",
)(lambda s, d: learning.without_conflicts(tables.patterns(s, d)).select("pattern_id"))
registered("pattern_cleanup", f"WITH {sql.PATTERNS} SELECT pattern_id, last_used >= TIMESTAMP '2024-04-15 00:00:00' - INTERVAL 90 DAY AND usage_count >= 1 AS kept FROM pat")(
    lambda s, d: learning.clean_up(tables.patterns(s, d), F.expr("timestamp_ntz'2024-04-15 00:00:00'")).select("pattern_id", "kept")
)
registered("pattern_consolidate")(lambda s, d: learning.consolidate(tables.patterns(s, d)))
registered("pattern_dml", f"WITH {sql.PATTERNS} SELECT pattern_id, usage_count + CASE WHEN pattern_id % 2 = 0 THEN 1 ELSE 0 END AS usage_count FROM pat WHERE pattern_id % 21 <> 0")(
    lambda s, d: learning.delete_where(learning.update_where(tables.patterns(s, d), F.col("pattern_id") % 2 == 0, {"usage_count": F.col("usage_count") + 1}), F.col("pattern_id") % 21 == 0).select("pattern_id", "usage_count")
)

# --- calibration ---

_POINTS = f"{sql.TRUTH}, pts AS (SELECT round_even(raw_confidence, 4) AS x, avg(CAST(actual_correct AS INT))::DOUBLE AS y, count(*) AS weight FROM truth GROUP BY 1)"
registered("calib_weighted_points", f"WITH {_POINTS} SELECT * FROM pts")(lambda s, d: calibration.weighted_points(tables.truth(s, d)))
registered(
    "calib_isotonic",
    f"""WITH {_POINTS}, n AS (SELECT row_number() OVER (ORDER BY x) AS k, x, y * weight AS s, weight FROM pts), c AS (SELECT k, x, sum(s) OVER (ORDER BY k) AS cs, sum(weight) OVER (ORDER BY k) AS cw, s, weight FROM n),
    m AS (SELECT a.k AS i, b.k AS j, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.weight) AS w FROM c a JOIN c b ON a.k <= b.k), lo AS (SELECT i, j, min(w) OVER (PARTITION BY i ORDER BY j DESC) AS w FROM m)
    SELECT c.x, round(max(lo.w), 9) AS fit FROM c JOIN lo ON lo.j = c.k AND lo.i <= c.k GROUP BY c.x""",
)(lambda s, d: calibration.isotonic(calibration.weighted_points(tables.truth(s, d))).select("x", F.round("fit", 9).alias("fit")))
registered(
    "calib_segment_cube",
    f"""WITH {sql.TRUTH} SELECT coalesce(supplier, '*') AS supplier, coalesce(field, '*') AS field, count(*) AS n_rows, count(DISTINCT round_even(raw_confidence, 4)) AS n_scores, avg(CAST(actual_correct AS INT))::DOUBLE AS accuracy,
    count(*) >= CASE grouping(supplier, field) WHEN 0 THEN 200 WHEN 1 THEN 150 WHEN 2 THEN 100 ELSE 50 END AND count(DISTINCT round_even(raw_confidence, 4)) >= 8 AS trains FROM truth GROUP BY CUBE (supplier, field)""",
)(lambda s, d: calibration.segments(tables.truth(s, d)))
registered(
    "calib_fallback_lookup",
    f"""WITH {sql.TRUTH}, m AS (SELECT coalesce(supplier, '*') AS s, coalesce(field, '*') AS f FROM truth GROUP BY CUBE (supplier, field) HAVING count(*) >= CASE grouping(supplier, field) WHEN 0 THEN 200 WHEN 1 THEN 150 WHEN 2 THEN 100 ELSE 50 END AND count(DISTINCT round_even(raw_confidence, 4)) >= 8)
    SELECT doc_id, coalesce((SELECT s || '/' || f FROM m WHERE s = supplier AND f = field), (SELECT s || '/' || f FROM m WHERE s = supplier AND f = '*'), (SELECT s || '/' || f FROM m WHERE s = '*' AND f = field), (SELECT s || '/' || f FROM m WHERE s = '*' AND f = '*')) AS model FROM truth""",
)(lambda s, d: calibration.lookup(tables.truth(s, d), calibration.segments(tables.truth(s, d)).filter("trains")).select("doc_id", "model"))
_BINNED = f"{sql.TRUTH}, b AS (SELECT least(floor(raw_confidence * 10), 9)::INT AS bin, count(*) AS n, avg(raw_confidence) AS confidence, avg(CAST(actual_correct AS INT))::DOUBLE AS accuracy FROM truth GROUP BY 1)"


def _binned(s: SparkSession, d: str) -> DataFrame:
    return calibration.bin_means(tables.truth(s, d), F.least(F.floor(F.col("raw_confidence") * 10), F.lit(9)).cast("int"), "raw_confidence")


registered("calib_bin_report", f"WITH {_BINNED} SELECT bin, n, round(confidence, 9) AS confidence, round(accuracy, 9) AS accuracy, round(abs(confidence - accuracy), 9) AS drift FROM b")(
    lambda s, d: _binned(s, d).select("bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"), F.round(F.abs(F.col("confidence") - F.col("accuracy")), 9).alias("drift"))
)
registered(
    "calib_ece_mce_brier",
    f"""WITH {_BINNED}, e AS (SELECT sum(abs(confidence - accuracy) * n) / sum(n) AS ece, max(abs(confidence - accuracy)) AS mce, sum(n) AS n, count(*) AS k FROM b), r AS (SELECT avg(pow(raw_confidence - CAST(actual_correct AS INT), 2)) AS brier FROM truth)
    SELECT round(ece, 9) AS ece, round(mce, 9) AS mce, round(brier, 9) AS brier, CAST(n AS BIGINT) AS n, k AS bins_with_data, k >= 5 AND (ece > CASE WHEN n < 200 THEN 0.08 WHEN n < 500 THEN 0.06 ELSE 0.05 END OR mce > CASE WHEN n < 200 THEN 0.15 WHEN n < 500 THEN 0.12 ELSE 0.10 END) AS recalibrate FROM e, r""",
)(
    lambda s, d: calibration.errors(_binned(s, d)).join(calibration.brier(tables.truth(s, d), "raw_confidence")).select(*[F.round(c, 9).alias(c) for c in ("ece", "mce", "brier")], "n", "bins_with_data", calibration.recalibrate(F.col("ece"), F.col("mce"), F.col("n"), F.col("bins_with_data")).alias("recalibrate"))
)


@registered(
    "calib_quantile_bins",
    f"""WITH {sql.TRUTH}, e AS (SELECT unnest(quantile_cont(raw_confidence, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM truth), b AS (SELECT doc_id, (SELECT count(*) FROM e WHERE edge <= raw_confidence) AS bin FROM truth) SELECT CAST(bin AS INT) AS bin, count(*) AS n FROM b GROUP BY 1""",
)
def calib_quantile_bins(s: SparkSession, d: str) -> DataFrame:
    t = tables.truth(s, d)
    binned = t.join(F.broadcast(calibration.quantile_edges(t))).withColumn("bin", calibration.bin_index(F.col("raw_confidence"), F.col("edges")))  # edges are one row of 11 numbers
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


registered("calib_applied")(lambda s, d: calibration.apply_fit(tables.truth(s, d), calibration.isotonic(calibration.weighted_points(tables.truth(s, d)))).select("doc_id", F.round("calibrated", 9).alias("calibrated")))

# --- layout ---

# y in a row of eight words rises by 1.25 a word from the row's first; a row's 7 steps pass 5 points after the fifth word.
registered("row_grouping", f"WITH {sql.TOKENS} SELECT doc_id, page_number, token_idx, CAST(i % 200 // 8 * 2 + CASE WHEN i % 8 > 4 THEN 1 ELSE 0 END AS INT) AS row_idx FROM tok")(lambda s, d: layout.group_rows(tables.tokens(s, d)).select("doc_id", "page_number", "token_idx", "row_idx"))
registered(
    "row_text",
    f"WITH {sql.TOKENS} SELECT doc_id, page_number, CAST(i % 200 // 8 * 2 + CASE WHEN i % 8 > 4 THEN 1 ELSE 0 END AS INT) AS row_idx, avg(y) AS y, min(x) AS x_min, max(x + width) AS x_max, string_agg(text, ' ' ORDER BY x, token_idx) AS text FROM tok GROUP BY 1, 2, 3",
)(lambda s, d: layout.row_table(layout.group_rows(tables.tokens(s, d))).select("doc_id", "page_number", "row_idx", "y", "x_min", "x_max", "text"))
registered("segment_bands", f"WITH {sql.TOKENS}, r AS (SELECT doc_id, page_number, i % 200 // 8 * 2 + CASE WHEN i % 8 > 4 THEN 1 ELSE 0 END AS row_idx, avg(y) AS y FROM tok GROUP BY 1, 2, 3) SELECT doc_id, page_number, CAST(row_idx AS INT) AS row_idx, CASE WHEN y < 792.0::DOUBLE * 0.3 THEN 'header' WHEN y > 792.0::DOUBLE * 0.7 THEN 'footer' ELSE 'items' END AS segment_type FROM r")(
    lambda s, d: layout.bands(layout.row_table(layout.group_rows(tables.tokens(s, d)))).select("doc_id", "page_number", "row_idx", "segment_type")
)
registered("reading_order")(lambda s, d: layout.reading_order(tables.tokens(s, d)).select("doc_id", "page_number", "token_idx", "position"))
registered("segment_table")(lambda s, d: layout.segments(layout.row_table(layout.group_rows(tables.tokens(s, d)))))
registered("wrap_gap_threshold")(lambda s, d: layout.gap_threshold(layout.row_table(layout.group_rows(tables.tokens(s, d)))))
registered("wrap_absorb")(
    lambda s, d: layout.absorb_wraps(layout.row_table(layout.group_rows(tables.tokens(s, d))).withColumns({"page_width": F.lit(612.0), "starts": F.col("row_idx") % 4 == 0})).select("doc_id", "page_number", "row_idx", "line_number", "absorbed")
)
registered(
    "column_assign",
    f"WITH {sql.TOKENS} SELECT doc_id, page_number, token_idx, CASE WHEN x + 25 <= 175 THEN 0 WHEN x + 25 <= 375 THEN 1 ELSE 2 END AS column FROM tok",
)(lambda s, d: layout.assign_columns(tables.tokens(s, d), [100.0, 250.0, 500.0]).select("doc_id", "page_number", "token_idx", "column"))


@registered("invoice_boundaries")
def invoice_boundaries(s: SparkSession, d: str) -> DataFrame:
    c = tables.table(s, d, "conversations")
    k = F.col("conv_id") + F.col("turn")
    shown = F.when(k % 3 == 0, F.concat(F.lit("Sida "), (F.col("turn") % 3 + 1), F.lit("/3"))).otherwise("")
    pages = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.when(k % 4 == 0, F.concat(F.lit("INV-"), (k % 8))).alias("invoice_no"), text.page_counter(shown).alias("counter"))
    return layout.invoice_boundaries(pages)
