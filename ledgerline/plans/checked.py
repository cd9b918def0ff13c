"""Registered queries of dates, totals, line checks, column-mapped lines, diagnostics, validators, stores and calibration, with their oracles.

Inputs are rendered from the standard tables by the key, so that every branch of a rule occurs; oracles state what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.operators import calibration, compose, constraints, diagnostics, headers, learning, linecheck, mapped_lines, reconcile, routing, totals
from ledgerline.plans import views_sql as sql
from ledgerline.sources import engines, runs, store, tables

Q = "CAST({} AS DECIMAL(18,2))"


def _case(key: Column, *values) -> Column:
    """The value at the key's place."""
    out = F.when(key == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(key == i, v)
    return out


def _swedish(v: Column) -> Column:
    return F.translate(F.format_number(v, 2), ",.", " ,")


# --- dates ---

_FORMS = ("yyyy-MM-dd", "yyyy.MM.dd", "d/M/yyyy", "d.M.yyyy", "dd-MM-yyyy", "dd-MM-yy", "dd.MM.yy", "dd/MM/yy")


def invoice_dates(s: SparkSession, d: str) -> DataFrame:
    o, k = tables.table(s, d, "orders"), F.col("o_orderkey")
    shown = _case(k % 8, *[F.concat(F.lit("Datum "), F.date_format("o_orderdate", f)) for f in _FORMS])
    texts = F.array(F.lit("Sida 1/2"), F.when(k % 3 == 0, "Förfaller 31.02.2024"), F.when(k % 13 != 0, shown), F.lit("Order 2001-01-01"))
    rows = o.select(k.alias("invoice_id"), F.posexplode(texts).alias("row_idx", "text"))
    return headers.pick_date(rows)


DATES_SQL = """SELECT o_orderkey AS invoice_id, CASE WHEN o_orderkey % 13 = 0 THEN DATE '2001-01-01' WHEN o_orderkey % 8 >= 5 THEN make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END AS invoice_date FROM orders"""


# --- totals ---


def _sums(s: SparkSession, d: str) -> DataFrame:
    return tables.lines(s, d).groupBy("invoice_id").agg(F.sum("line_total").cast("decimal(18,2)").alias("lines_sum"))


def _footer(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sums = _sums(s, d)
    k, v = F.col("invoice_id") % 5, F.col("lines_sum")
    one, two, three, four = (_swedish((v * m + a).cast("decimal(18,2)")) for m, a in ((1, 0), (2, 100), (3, 0), (5, 7)))
    say = lambda label, amount: F.concat(F.lit(label), amount)
    texts = _case(
        k, F.array(say("Netto ", one), F.lit("Att betala"), two), F.array(say("Totalt inkl. moms ", two), say("Att betala ", one)), F.array(say("Summa ", three), say("Belopp ", one)),
        F.array(say("Delsumma ", four)), F.array(three, F.lit("Tack")),
    )
    rows = sums.select("invoice_id", F.posexplode(texts).alias("row_idx", "text")).select("invoice_id", "row_idx", (F.col("row_idx") * 20 + 600.0).alias("y"), F.lit(800.0).alias("page_height"), "text")
    above = sums.filter(k == 4).select("invoice_id", F.lit(-1).alias("row_idx"), F.lit("Att betala: SEK").alias("text"))
    return rows, sums, above


def final_total(s: SparkSession, d: str) -> DataFrame:
    footer, sums, above = _footer(s, d)
    return totals.final_totals(footer, sums, above=above).select("invoice_id", F.col("total_amount").cast("decimal(18,2)").alias("total_amount"), "keyword_type", "validated", "row_idx")


def total_retry(s: SparkSession, d: str) -> DataFrame:
    footer, sums, above = _footer(s, d)
    return totals.retried_totals(footer, sums, above=above).groupBy("keyword_type", "strategy", "reached").agg(F.count(F.lit(1)).alias("n"))


_FINAL = f"""WITH {sql.LINES}, q AS (SELECT invoice_id, CAST(sum(line_total) AS DECIMAL(18,2)) AS s FROM lines GROUP BY 1)
  SELECT invoice_id, CAST(CASE invoice_id % 5 WHEN 0 THEN s * 2 + 100 WHEN 3 THEN s * 5 + 7 WHEN 4 THEN s * 3 ELSE s END AS DECIMAL(18,2)) AS total_amount, CASE invoice_id % 5 WHEN 2 THEN 'generic' WHEN 3 THEN 'without_vat' ELSE 'with_vat' END AS keyword_type,
  invoice_id % 5 IN (1, 2) AS validated, CAST(CASE invoice_id % 5 WHEN 0 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 1 END AS INT) AS row_idx FROM q"""
# A subtotal is penalised least by 'aggressive'; of the others, only a total with VAT that agrees with the lines reaches the target.
RETRY_SQL = f"""WITH {sql.LINES}, q AS (SELECT DISTINCT invoice_id % 5 AS k, invoice_id FROM lines) SELECT CASE k WHEN 2 THEN 'generic' WHEN 3 THEN 'without_vat' ELSE 'with_vat' END AS keyword_type, CASE k WHEN 3 THEN 'aggressive' ELSE 'standard' END AS strategy, k = 1 AS reached, count(*) AS n FROM q GROUP BY 1, 2, 3"""
BOOSTS_SQL = f"""WITH {sql.PATTERNS}, s AS (SELECT i.pattern_id AS invoice_id, p.pattern_id, 0.5 + CASE WHEN i.position_x IS NULL AND p.position_x IS NULL THEN 0.25 WHEN i.position_x IS NULL OR p.position_x IS NULL THEN 0.0 ELSE 0.5::DOUBLE / (sqrt((p.position_x - i.position_x) * (p.position_x - i.position_x) + (p.position_y - i.position_y) * (p.position_y - i.position_y)) / 100.0::DOUBLE + 1) END AS v
  FROM pat i JOIN pat p ON i.supplier_name = p.supplier_name WHERE i.pattern_id % 21 = 0), t AS (SELECT pattern_id FROM s QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY v DESC, pattern_id) = 1), u AS (SELECT pattern_id, count(*) AS n FROM t GROUP BY 1)
  SELECT pat.pattern_id, CAST(usage_count + coalesce(n, 0) AS INT) AS usage_count, n IS NOT NULL AS used FROM pat LEFT JOIN u ON u.pattern_id = pat.pattern_id"""


# --- line checks ---


def _checked_lines(s: SparkSession, d: str) -> DataFrame:
    v = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    q, p = F.col("l_quantity").cast("decimal(18,2)"), F.col("l_extendedprice").cast("decimal(18,2)")
    lines = tables.table(s, d, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line_number"), v.alias("v"), q.alias("q"), p.alias("p"))
    base, v = (F.col("q") * F.col("p")).cast("decimal(18,4)"), F.col("v")
    dec = lambda x: F.lit(x).cast("decimal(18,2)")
    total = F.when(v == 1, base * F.lit("0.9").cast("decimal(2,1)")).when(v == 2, base - 5).when(v == 3, base - dec("4.50")).when(v == 4, base * 2).otherwise(base)
    return lines.select(
        "invoice_id", "line_number", F.when(~v.isin(6, 7), F.col("q")).alias("quantity"), F.when(~v.isin(5, 7), F.col("p")).alias("unit_price"),
        F.when(v == 1, dec("0.10")).when(v == 2, dec("5")).when(v == 3, dec("-5")).alias("discount"), total.cast("decimal(18,2)").alias("line_total"),
    )


def line_checks(s: SparkSession, d: str) -> DataFrame:
    c = linecheck.line_warnings(linecheck.check_lines(_checked_lines(s, d)))
    two = lambda x: x.cast("decimal(18,2)")
    return c.select(
        "invoice_id", "line_number", F.round("confidence", 2).alias("confidence"), "discount_type", "fields_ok", two(F.col("expected_total")).alias("expected_total"), two(F.col("suggested.unit_price")).alias("suggested_price"),
        two(F.col("suggested.quantity")).alias("suggested_quantity"), F.size("warnings").alias("n_warnings"), F.size("messages").alias("n_messages"),
    )


LINE_CHECKS_SQL = """WITH l AS (SELECT l_orderkey AS invoice_id, l_linenumber AS line_number, (l_orderkey + l_linenumber) % 8 AS v, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem),
  b AS (SELECT *, CAST(q * p AS DECIMAL(18,4)) AS base FROM l)
  SELECT invoice_id, line_number, CASE v WHEN 0 THEN 0.9 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.8 WHEN 4 THEN 0.6 WHEN 5 THEN 0.65 WHEN 6 THEN 0.65 ELSE 0.4 END::DOUBLE AS confidence, CASE v WHEN 1 THEN 'percent' WHEN 2 THEN 'amount' WHEN 3 THEN 'amount' END AS discount_type, v <= 3 AS fields_ok,
  CAST(CASE WHEN v IN (0, 4) THEN base WHEN v = 1 THEN base * 0.9 WHEN v IN (2, 3) THEN base - 5 END AS DECIMAL(18,2)) AS expected_total, CAST(CASE v WHEN 4 THEN p * 2 WHEN 5 THEN p END AS DECIMAL(18,2)) AS suggested_price, CAST(CASE v WHEN 4 THEN q * 2 WHEN 6 THEN q END AS DECIMAL(18,2)) AS suggested_quantity,
  CAST([0, 0, 0, 2, 1, 1, 1, 1][v + 1] AS INT) AS n_warnings, CAST([0, 1, 1, 3, 2, 2, 2, 1][v + 1] AS INT) AS n_messages FROM b"""


def invoice_messages(s: SparkSession, d: str) -> DataFrame:
    h = tables.headers(s, d).select("invoice_id", "header_total", "number_confidence", "total_confidence")
    out = linecheck.invoice_messages(h, tables.lines(s, d))
    return out.select("invoice_id", "status", "lines_sum", "diff", F.array_join("errors", ";").alias("errors"), F.size("warnings").alias("n_warnings"), F.when(F.col("status") == "PARTIAL", F.element_at("warnings", -1)).alias("mismatch"))


MESSAGES_SQL = f"""WITH {sql.HEADERS} SELECT invoice_id, status, lines_sum, diff, CASE WHEN NOT gate THEN 'Hard gate failed: invoice_number_confidence=' || printf('%.2f', number_confidence) || ', total_confidence=' || printf('%.2f', total_confidence) WHEN header_total IS NULL THEN 'Total amount not extracted (confidence < 0.95)' WHEN n_lines = 0 THEN 'No invoice lines extracted (cannot validate)' ELSE '' END AS errors,
  CAST(n_lines + CASE WHEN status = 'PARTIAL' THEN 1 ELSE 0 END AS INT) AS n_warnings, CASE WHEN status = 'PARTIAL' THEN 'Sum mismatch: diff=' || CAST(diff AS VARCHAR) || ' SEK (tolerance: ±1.0 SEK)' END AS mismatch FROM v"""


def stated_sums(s: SparkSession, d: str) -> DataFrame:
    k, n = F.col("invoice_id"), F.col("lines_sum")
    step = lambda m, big, small: F.when(k % m == 0, F.lit(big)).otherwise(F.lit(small)).cast("decimal(18,2)")
    stated = _sums(s, d).withColumns({"stated_net": (n + step(3, "0.75", "0.25")).cast("decimal(28,2)"), "stated_gross": F.when(k % 7 != 0, F.round(n * F.lit("1.25").cast("decimal(4,2)"), 2) + step(4, "-1.00", "0.25")).cast("decimal(28,2)"), "lines_sum": n.cast("decimal(28,2)")})
    return linecheck.gross_check(linecheck.net_check(stated)).select("invoice_id", "net_diff", "net_ok", "vat", "gross_diff", "gross_ok")


STATED_SQL = f"""WITH {sql.LINES}, n AS (SELECT invoice_id, CAST(sum(line_total) AS DECIMAL(28,2)) AS net FROM lines GROUP BY 1), t AS (
  SELECT invoice_id, net, CAST(CASE WHEN invoice_id % 3 = 0 THEN 0.75 ELSE 0.25 END AS DECIMAL(28,2)) AS net_diff, CAST(round(net * 0.25, 2) AS DECIMAL(28,2)) AS vat, CASE WHEN invoice_id % 7 <> 0 THEN CAST(round(net * 1.25, 2) + CASE WHEN invoice_id % 4 = 0 THEN -1.00 ELSE 0.25 END AS DECIMAL(28,2)) END AS gross FROM n)
  SELECT invoice_id, net_diff, net_diff <= 0.50 AS net_ok, vat, CAST(gross - (net + vat) AS DECIMAL(28,2)) AS gross_diff, coalesce(abs(gross - (net + vat)) <= 0.50, false) AS gross_ok FROM t"""


# --- lines by position ---


def lines_by_position(s: SparkSession, d: str) -> DataFrame:
    """Tables of some thirty lines: eight orders on one page, under a header row."""
    group = F.floor(F.col("l_orderkey") / 8)
    at = F.row_number().over(Window.partitionBy("g").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    l = tables.table(s, d, "lineitem").withColumn("g", group).withColumn("i", at)
    shown = lambda v: F.translate(v.cast("decimal(18,2)").cast("string"), ".", ",")
    q, total = F.col("l_quantity").cast("int").cast("string"), F.col("l_extendedprice")
    words = (F.concat(F.lit("ART"), F.col("l_partkey").cast("string")), F.lit("skruvrostfriextralang"), q, _case(F.col("i") % 3, F.lit("st"), F.lit("kg"), F.lit("paket")), F.concat((F.col("l_partkey") % 900 + 100).cast("string"), F.lit(",50")), F.lit("25,00"), shown(total))
    places = (50.0, 150.0, 300.0, 360.0, 420.0, 470.0, 540.0)
    token = lambda i, t, x: F.struct(F.lit(i).alias("token_idx"), t.alias("text"), F.lit(x).alias("x"))
    body = l.select(F.col("g").alias("invoice_id"), F.col("i").alias("row_idx"), F.array(*[token(j, w, x) for j, (w, x) in enumerate(zip(words, places, strict=True))]).alias("t"))
    names = ("Artikelnr", "Benämning", "Antal", "Enhet", "Á-pris", "Moms", "Nettobelopp")
    head = l.select(F.col("g").alias("invoice_id")).distinct().select("invoice_id", F.lit(0).alias("row_idx"), F.array(*[token(j, F.lit(w), x) for j, (w, x) in enumerate(zip(names, places, strict=True))]).alias("t"))
    both = body.unionByName(head)
    rows = both.select("invoice_id", "row_idx", F.array_join(F.transform("t", lambda t: t["text"]), " ").alias("text"), (F.col("row_idx") * 20.0 + 100.0).alias("y"), F.lit(50.0).alias("x_min"), F.lit(10.0).alias("height"), F.lit(612.0).alias("page_width"))
    tokens = both.select("invoice_id", "row_idx", F.inline("t")).withColumns({"width": F.lit(25.0), "page_width": F.lit(612.0)})
    found = mapped_lines.mapped_lines(rows, tokens, own_header=True)
    return found.select("invoice_id", "line_number", "description", *(F.col(c).cast("decimal(18,2)").alias(c) for c in ("quantity", "unit_price", "amount", "vat_rate")), "unit")


POSITION_SQL = """SELECT CAST(l_orderkey // 8 AS BIGINT) AS invoice_id, CAST(i AS INT) AS line_number, 'skruvrostfriextralang' AS description, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_partkey % 900 + 100.5 AS DECIMAL(18,2)) AS unit_price, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(0.25 AS DECIMAL(18,2)) AS vat_rate, ['st', 'kg', 'paket'][i % 3 + 1] AS unit
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS i FROM lineitem)"""


# --- diagnostics ---


def _odd_lines(s: SparkSession, d: str) -> DataFrame:
    v, u, q = (F.col("l_orderkey") + F.col("l_linenumber")) % 6, F.col("l_partkey") % 6, F.col("l_quantity")
    unit = _case(u, *[F.lit(x) for x in ("ea", "LTR", "månad", "day", "xpa", "st")])
    article = (F.col("l_partkey") + 100000).cast("string")
    number = lambda c: c.cast("decimal(18,4)")
    return tables.table(s, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("invoice_number"), unit.alias("unit"), _case(v, F.lit("Vara"), F.concat(article, F.lit(" Skruv")), F.lit("Bult"), F.concat(F.lit("Mutter 2 108 "), F.lower(unit)), F.lit("spik"), F.lit("Rör")).alias("description"),
        number(_case(v, q, F.col("l_partkey") + 100000.0, F.lit(2.0), F.lit(8.0), F.lit(1500.0), q)).alias("quantity"), number(_case(v, F.lit(100.0), F.lit(1.0), F.lit(5.0), F.lit(10.0), F.lit(1.0))).alias("unit_price"),
        _case(v, q * 100.0, F.col("l_partkey") + 100000.0, F.lit(5000.0), F.lit(21080.0), F.lit(1500.0), q).cast("decimal(18,2)").alias("line_total"), F.when(F.col("l_partkey") % 4 == 0, number(F.lit(0.1))).alias("discount"),
    )


_ODD = "o AS (SELECT (l_orderkey + l_linenumber) % 6 AS v, l_partkey % 6 AS u, l_partkey % 4 = 0 AS d FROM lineitem)"


def odd_units(s: SparkSession, d: str) -> DataFrame:
    return diagnostics.flagged_units(_odd_lines(s, d)).groupBy(F.lower("unit").alias("unit"), F.array_join("problems", ";").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


def odd_prices(s: SparkSession, d: str) -> DataFrame:
    found = diagnostics.spaced_quantities(_odd_lines(s, d))
    return found.groupBy("description", F.round("ratio", 6).alias("ratio"), F.array_join(F.transform("quantities", lambda x: x.cast("string")), ",").alias("quantities")).agg(F.count(F.lit(1)).alias("n"))


# --- validators ---


def _records(s: SparkSession, d: str) -> dict[str, tuple[DataFrame, constraints.Rules]]:
    o, k = tables.table(s, d, "orders"), F.col("o_orderkey")
    facts = o.select(
        k.alias("k"), (k % 7).alias("page_number"), (k % 11 - 1).cast("double").alias("width"), F.when(k % 13 != 0, 1.0).alias("height"), (k % 5).alias("n_tokens"), (k % 3).alias("x_min"), F.lit(1).alias("x_max"),
        _case(k % 4, F.lit("header"), F.lit("items"), F.lit("footer"), F.lit("x")).alias("segment_type"), (k % 6).alias("y_min"), F.lit(4).alias("y_max"), (k % 9).alias("n_rows"), (k % 10 - 3).alias("line_total"), (k % 12 / F.lit(10.0)).alias("number_confidence"), ((k % 8 - 1) / F.lit(7.0)).alias("total_confidence"),
        _case(k % 5, *[F.lit(x) for x in ("OK", "PARTIAL", "REVIEW", "FAILED", "?")]).alias("status"), (k % 14 - 2).alias("lines_sum"), (k % 6).alias("virtual_invoice_index"), (k % 4).alias("page_start"), (k % 5).alias("page_end"), (k % 30 * 4 - 8).alias("score"),
        _case(k % 3, F.lit("invoice_no"), F.lit("total"), F.lit("other")).alias("field"), (k % 12 / F.lit(10.0)).alias("confidence"),
        _case(k % 4, F.lit('{"page_number":1,"bbox":[1,2,3,4],"row_index":0,"text_excerpt":"x","tokens":[]}'), F.lit('{"page_number":1,"bbox":[1,2,3],"row_index":0,"text_excerpt":"x","tokens":[]}'), F.lit('{"page_number":1,"bbox":[1,2,3,4],"row_index":0,"tokens":[]}'), F.lit('{"page_number":1,"bbox":[1,2,3,4],"row_index":0,"text_excerpt":"x","tokens":"t"}')).alias("evidence"),
        _case(k % 4, F.lit('{"total_amount": 5.5, "confidence": 0.5, "validation_passed": true}'), F.lit('{"total_amount": "x", "confidence": 1.5, "validation_passed": false}'), F.lit('{"confidence": 1}'), F.lit("none")).alias("reply"),
    )
    c = constraints
    return {
        "page": (facts, c.PAGE), "token": (facts, c.TOKEN), "row": (facts, c.ROW), "segment": (facts, c.SEGMENT), "line": (facts, c.LINE), "header": (facts, c.HEADER), "validation": (facts, c.VALIDATION), "virtual": (facts, c.VIRTUAL), "quality": (facts, c.QUALITY),
        "trace": (facts, c.evidence_rules()), "reply": (facts, c.reply_rules()),
    }


def _named(record: str) -> Column:
    return F.transform("broken", lambda r: F.struct(F.lit(record).alias("record"), r.alias("rule")))


def record_rejects(s: SparkSession, d: str) -> DataFrame:
    """Rows that break each rule, by kind of record: one pass over the records, whatever the number of rules."""
    facts, kinds = None, _records(s, d)
    for name, (df, rules) in kinds.items():
        facts = df if facts is None else facts
        facts = constraints.broken(facts, rules).withColumn(f"_{name}", _named(name)).drop("broken")
    listed = facts.select(F.explode(F.concat(*[F.col(f"_{n}") for n in kinds])).alias("b"))
    return listed.groupBy("b.record", "b.rule").agg(F.count(F.lit(1)).alias("n"))


_BREAKS = {
    ("page", "page_number"): "k % 7 = 0", ("token", "width"): "k % 11 = 0", ("token", "height"): "k % 13 = 0", ("row", "tokens"): "k % 5 = 0", ("row", "x_range"): "k % 3 = 2", ("segment", "segment_type"): "k % 4 = 3", ("segment", "y_range"): "k % 6 = 5", ("segment", "rows"): "k % 9 = 0",
    ("line", "rows"): "k % 9 = 0", ("line", "total"): "k % 10 <= 3", ("header", "number_confidence"): "k % 12 = 11", ("header", "total_confidence"): "k % 8 = 0", ("validation", "number_confidence"): "k % 12 = 11", ("validation", "total_confidence"): "k % 8 = 0", ("validation", "status"): "k % 5 >= 3", ("validation", "lines_sum"): "k % 14 < 2",
    ("virtual", "status"): "k % 5 = 4", ("virtual", "index"): "k % 6 = 0", ("virtual", "page_start"): "k % 4 = 0", ("virtual", "page_order"): "k % 5 < k % 4", ("quality", "score"): "k % 30 < 2 OR k % 30 > 27",
    ("trace", "field"): "k % 3 = 2", ("trace", "confidence"): "k % 12 = 11", ("trace", "bbox"): "k % 4 = 1", ("trace", "parts"): "k % 4 = 2", ("trace", "tokens"): "k % 4 = 3", ("reply", "total_amount"): "k % 4 > 0", ("reply", "confidence"): "k % 4 IN (1, 3)", ("reply", "validation_passed"): "k % 4 >= 2",
}
REJECTS_SQL = "WITH o AS (SELECT o_orderkey AS k FROM orders) " + " UNION ALL ".join(f"SELECT '{a}' AS record, '{b}' AS rule, count(*) AS n FROM o WHERE {w} HAVING count(*) > 0" for (a, b), w in _BREAKS.items())


def document_rejects(s: SparkSession, d: str) -> DataFrame:
    pages = tables.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"))
    documents = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", (F.col("n") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).alias("page_count"))
    return constraints.document_rules(pages, documents).select("doc_id", (F.size("broken") > 0).alias("rejected"))


def reply_parse(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = k.cast("string")
    reply = _case(k % 5, F.concat(F.lit('{"total_amount": '), n, F.lit('.5, "confidence": 0.9, "reasoning": "r", "validation_passed": true}')), F.concat(F.lit('Here: ```json\n{"total_amount": '), n, F.lit(', "confidence": 0.8, "reasoning": "", "validation_passed": false}\n```')), F.concat(F.lit("Totalen är 12 eller "), n, F.lit(",25")), F.lit("vet ej"), F.concat(F.lit('{"total_amount": '), n, F.lit("}")))
    r = tables.table(s, d, "orders").select(k.alias("invoice_id"), constraints.parse_reply(reply).alias("r"))
    return r.select("invoice_id", "r.total_amount", "r.confidence", "r.validation_passed")


REPLY_SQL = """SELECT o_orderkey AS invoice_id, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey + 0.5 WHEN 1 THEN o_orderkey WHEN 2 THEN o_orderkey + 0.25 WHEN 4 THEN o_orderkey END::DOUBLE AS total_amount, CASE o_orderkey % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 3 THEN NULL ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN o_orderkey % 5 <> 3 THEN o_orderkey % 5 = 0 END AS validation_passed FROM orders"""


def reply_plausible(s: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey"), F.col("o_totalprice")
    lines_sum = _case(k % 6, t, t + 0.5, t + 100, F.lit(50.0), t * 2)
    ok, conf = constraints.plausible(F.when(k % 7 != 0, t), F.lit(0.75), lines_sum)
    return tables.table(s, d, "orders").select(k.alias("invoice_id"), ok.alias("validated"), F.round(conf, 6).alias("confidence"))


PLAUSIBLE_SQL = """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS t, CASE o_orderkey % 6 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice + 0.5 WHEN 2 THEN o_totalprice + 100 WHEN 3 THEN 50.0 WHEN 4 THEN o_totalprice * 2 END AS s FROM orders), g AS (SELECT *, abs(t - s) AS gap FROM o), h AS (SELECT *, gap > greatest(500.0, t * 0.15) OR (s < 100 AND t > 1000) AS odd FROM g)
  SELECT k AS invoice_id, CASE WHEN t IS NULL THEN false WHEN s IS NULL THEN true ELSE odd OR gap <= 1.0 END AS validated, round(CASE WHEN t IS NULL OR s IS NULL OR odd OR gap > 1.0 THEN 0.75 WHEN gap < 0.01 THEN 0.95 ELSE 0.85 END, 6)::DOUBLE AS confidence FROM h"""


def artifact_bands(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = tables.table(s, d, "customer").select(k.alias("run_id"), F.when(k % 4 == 1, "1.2.3").when(k % 4 == 2, "1.0.0").when(k % 4 == 3, "2.0.0").alias("pipeline_version"), F.when(k % 3 == 0, "1.0").when(k % 3 == 1, "2.0").alias("manifest_version"))
    return constraints.artifact_bands(c, c, "1.2.3")


BANDS_SQL = """SELECT c_custkey AS run_id, 'run_summary' AS kind, ['UNKNOWN', 'COMPATIBLE', 'WARNING', 'INCOMPATIBLE'][c_custkey % 4 + 1] AS band FROM customer UNION ALL SELECT c_custkey, 'artifact_manifest', CASE WHEN c_custkey % 3 = 1 THEN 'WARNING' ELSE 'COMPATIBLE' END FROM customer"""

# --- routing lists ---

_PATTERNS = (r"\bthe\b", r"\bof\b", "a(b", r"\d{4}")


def matched_patterns(s: SparkSession, d: str) -> DataFrame:
    return tables.table(s, d, "documents").select("doc_id", F.array_join(routing.matching(F.col("text"), _PATTERNS), "|").alias("matched"))


MATCHED_SQL = r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)\bthe\b') THEN '\bthe\b' END, CASE WHEN regexp_matches(text, '(?i)\bof\b') THEN '\bof\b' END, CASE WHEN regexp_matches(text, '(?i)a\(b') THEN 'a(b' END, CASE WHEN regexp_matches(text, '\d{4}') THEN '\d{4}' END], lambda x: x IS NOT NULL), '|') AS matched FROM documents"""


def gate_flags(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pages = tables.table(s, d, "orders").select(
        k.alias("invoice_id"), (k % 2 == 0).alias("edi_like"), F.array(F.lit("text_layer"), F.lit("text_layer")).alias("signals"), _case(k % 3, F.lit("OK"), F.lit("REVIEW")).alias("status"),
        (k % 5 == 0).alias("fallback_attempted"), F.when(k % 10 == 0, True).when(k % 15 == 0, False).alias("fallback_passed"), F.when(k % 7 != 0, "ocr").alias("extraction_source"),
    )
    return routing.policy_gate(pages).select("invoice_id", "allow_ai", F.array_join("gate_flags", ",").alias("gate_flags"))


GATE_SQL = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS edi, CASE o_orderkey % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'REVIEW' END AS status FROM orders)
  SELECT k AS invoice_id, NOT edi AS allow_ai, 'text_layer,' || CASE WHEN status IS NULL THEN 'validation_missing' WHEN status = 'OK' THEN 'validation_passed' ELSE 'validation_failed' END || CASE WHEN k % 5 = 0 THEN ',fallback_attempted' ELSE ',fallback_not_attempted' END || CASE WHEN k % 10 = 0 THEN ',fallback_passed' WHEN k % 15 = 0 THEN ',fallback_failed' ELSE '' END
  || CASE WHEN NOT edi THEN '' WHEN status = 'OK' THEN ',edi_blocked_validation_ok' ELSE ',edi_force_review' END || CASE WHEN k % 7 <> 0 THEN ',source:ocr' ELSE '' END AS gate_flags FROM o"""

# --- stores and runs ---


def invoice_store(s: SparkSession, d: str) -> DataFrame:
    """Every seventh export row lacks its invoice's id and goes by its number, which is the same."""
    inv = tables.invoices(s, d).select("invoice_id", "invoice_number", "supplier_name", "invoice_date", F.col("total_amount").alias("total"))
    rows = tables.lines(s, d).join(inv, "invoice_id").withColumn("invoice_id", F.when((F.col("invoice_id") + F.col("line_number")) % 7 != 0, F.col("invoice_id").cast("string")))
    found = store.load_invoices(rows.select("invoice_id", "line_number", "quantity", "line_total", "invoice_number", "supplier_name", "invoice_date", "total"))
    added = F.aggregate("lines", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["line_total"]).cast("decimal(28,2)"))
    return found.select("invoice_key", "supplier_name", "invoice_date", "total", "n_lines", added.alias("lines_sum"))


STORE_SQL = f"WITH {sql.INV}, {sql.LINES} SELECT invoice_number AS invoice_key, min(supplier_name) AS supplier_name, min(invoice_date) AS invoice_date, min(total_amount) AS total, CAST(count(*) AS INT) AS n_lines, CAST(sum(line_total) AS DECIMAL(28,2)) AS lines_sum FROM lines JOIN inv ON lines.invoice_id = inv.invoice_id GROUP BY 1"


def corrections_newest(s: SparkSession, d: str) -> DataFrame:
    c = tables.corrections(s, d).select(F.col("invoice_id"), "supplier_name", F.concat(F.col("ts").cast("string"), F.lit("-"), F.col("arrival").cast("string")).alias("timestamp"), "arrival")
    return store.corrections_of(c, "click").limit(50).select("arrival")  # a report's top 50


def patterns_by_use(s: SparkSession, d: str) -> DataFrame:
    p = store.update_patterns(tables.patterns(s, d), F.col("pattern_id") % 3 == 0, {"usage_count": F.lit(9), "correct_total": F.lit(-1.0)})
    return store.patterns_of(p).limit(50).select("pattern_id", "usage_count", "correct_total")  # a report's top 50


def chosen_corrections(s: SparkSession, d: str) -> DataFrame:
    inv = tables.invoices(s, d)
    k = F.col("invoice_id")
    offered = inv.select("invoice_id", F.when(k % 5 != 0, F.col("supplier_name")).otherwise("").alias("supplier_name"), "total_amount", F.lit(0.5).alias("total_confidence"), F.array(F.struct(F.col("total_amount").alias("amount"), F.lit(0.5).alias("score")), F.struct((F.col("total_amount") + 1).alias("amount"), F.lit(0.25).alias("score"))).alias("candidates"))
    picks = inv.select("invoice_id", (k % 3).cast("int").alias("candidate_index"), F.lit(None).cast("double").alias("raw_confidence"))
    return store.correction(offered, picks, F.lit("2024-01-01")).select("invoice_id", "supplier_name", "original_total", "corrected_total", "corrected_confidence", "candidate_index", "correction_type")


CHOSEN_SQL = f"""WITH {sql.INV} SELECT CAST(invoice_id AS VARCHAR) AS invoice_id, CASE WHEN invoice_id % 5 = 0 THEN 'Unknown' ELSE supplier_name END AS supplier_name, total_amount::DOUBLE AS original_total, (total_amount + invoice_id % 3)::DOUBLE AS corrected_total, CASE invoice_id % 3 WHEN 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS corrected_confidence, CAST(invoice_id % 3 AS INT) AS candidate_index, 'total_amount' AS correction_type FROM inv WHERE invoice_id % 3 < 2"""


def batch_counts(s: SparkSession, d: str) -> DataFrame:
    h = reconcile.line_sums(tables.headers(s, d), tables.lines(s, d)).withColumn("diff", reconcile.difference())
    status = reconcile.status(reconcile.hard_gate(F.col("number_confidence"), F.col("total_confidence")), F.col("header_total"), F.col("n_lines"), reconcile.scaled_pass(F.col("header_total"), F.col("diff")))
    return runs.batch_counts(h.withColumn("status", F.when(F.col("invoice_id") % 29 == 0, "FAILED").otherwise(status)))


COUNTS_SQL = f"""WITH {sql.HEADERS}, f AS (SELECT file_id, CASE WHEN invoice_id % 29 = 0 THEN 'FAILED' ELSE status END AS status FROM v) SELECT count(DISTINCT file_id) AS n_files, count(*) AS n_invoices, count(*) FILTER (status = 'OK') AS n_ok, count(*) FILTER (status = 'PARTIAL') AS n_partial, count(*) FILTER (status = 'REVIEW') AS n_review, count(*) FILTER (status = 'FAILED') AS n_failed FROM f"""


def enrichment_diff(s: SparkSession, d: str) -> DataFrame:
    inv = tables.invoices(s, d).select("invoice_id", "invoice_number", "supplier_name", "invoice_date", F.col("total_amount").alias("header_total"))
    k = F.col("invoice_id")
    after = inv.withColumns({"supplier_name": F.when(k % 6 == 0, F.lit("NY")).otherwise(F.col("supplier_name")), "header_total": F.when(k % 7 != 0, F.col("header_total"))})
    lines = tables.lines(s, d).groupBy("invoice_id", "line_number").agg(F.sum("line_total").cast("decimal(28,2)").alias("line_total"))
    changed = lines.filter("line_number < 7").withColumn("line_total", F.when(k % 10 == 0, F.col("line_total") + 1).when(k % 10 != 1, F.col("line_total")))
    return compose.enrichment_diff(inv, after, lines, changed)


DIFF_SQL = f"""WITH {sql.INV}, {sql.LINES}, b AS (SELECT invoice_id, line_number, CAST(sum(line_total) AS DECIMAL(28,2)) AS t FROM lines GROUP BY 1, 2), c AS (SELECT *, CASE WHEN invoice_id % 10 = 0 THEN CAST(t + 1 AS DECIMAL(28,2)) WHEN invoice_id % 10 = 1 THEN NULL ELSE t END AS u FROM b WHERE line_number < 7)
  SELECT invoice_id, 'header' AS place, 'supplier_name' AS field, supplier_name AS original, 'NY' AS enriched FROM inv WHERE invoice_id % 6 = 0 UNION ALL SELECT invoice_id, 'header', 'header_total', CAST(total_amount AS VARCHAR), NULL FROM inv WHERE invoice_id % 7 = 0 AND total_amount IS NOT NULL
  UNION ALL SELECT invoice_id, CAST(line_number AS VARCHAR), 'line_total', CAST(t AS VARCHAR), CAST(u AS VARCHAR) FROM c WHERE t IS DISTINCT FROM u"""


def artifact_kinds(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    names = ("AI_request.json", "run_summary.json", "a.XLSX", "review_1.json", "tokens/1.json", "rows/1.json", "segments/1.json", "misc.bin")
    path = F.concat(F.lit("out/"), k.cast("string"), F.lit("/"), _case(k % 8, *[F.lit(n) for n in names]))
    return tables.table(s, d, "events").select(path.alias("path"), routing.artifact_type(path).alias("kind"))


KINDS_SQL = """SELECT 'out/' || event_id || '/' || ['AI_request.json', 'run_summary.json', 'a.XLSX', 'review_1.json', 'tokens/1.json', 'rows/1.json', 'segments/1.json', 'misc.bin'][event_id % 8 + 1] AS path, ['ai/ai_enrichment', 'summary/', 'excel/export', 'debug/validation', 'tokens/tokenization', 'rows/row_grouping', 'segments/segment_identification', 'debug/'][event_id % 8 + 1] AS kind FROM events"""


def page_metrics(s: SparkSession, d: str) -> DataFrame:
    t = tables.table(s, d, "events").select(F.col("user_id").alias("path"), F.lit(1).alias("page_number"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 103 - 2).cast("double")).alias("confidence"))
    m = engines.page_metrics(t).join(t.groupBy("path").agg(engines.mean_confidence(F.col("confidence")).alias("share")), "path")
    return m.select("path", *(F.round(c, 9).alias(c) for c in ("mean_conf", "median_conf", "low_conf_fraction", "share")))


METRICS_SQL = """WITH t AS (SELECT user_id AS path, CASE WHEN event_id % 3 <> 0 AND event_id % 103 >= 2 THEN (event_id % 103 - 2)::DOUBLE END AS c FROM events)
  SELECT path, round(coalesce(avg(c), 0), 9) AS mean_conf, round(coalesce(median(c), 0), 9) AS median_conf, round(coalesce(avg(CASE WHEN c < 50 THEN 1.0 WHEN c >= 50 THEN 0.0 END), 1)::DOUBLE, 9) AS low_conf_fraction, round(coalesce(avg(c) / 100, 1), 9) AS share FROM t GROUP BY path"""


def page_invoice_numbers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = F.concat(F.lit("F-"), (k + 10000).cast("string"))
    texts = F.array(_case(k % 4, F.concat(F.lit("Faktura nr: "), n), F.lit("Fakturanummer"), F.lit("Hej"), F.lit("Invoice No 12")), _case(k % 4, F.lit("Kund 1"), n, F.concat(F.lit("Ordernr "), n), F.lit("Tack")))
    rows = tables.table(s, d, "orders").select(k.alias("invoice_id"), F.posexplode(texts).alias("row_idx", "text")).withColumns({"y": F.col("row_idx") * 20 + 20.0, "page_height": F.lit(800.0), "segment_type": F.lit("header")})
    return headers.page_numbers(rows).select("invoice_id", "candidate", "row_idx")


PAGE_NUMBERS_SQL = "SELECT o_orderkey AS invoice_id, 'F-' || (o_orderkey + 10000) AS candidate, CAST(o_orderkey % 4 AS INT) AS row_idx FROM orders WHERE o_orderkey % 4 < 2 UNION ALL SELECT o_orderkey, 'Tack', 1 FROM orders WHERE o_orderkey % 4 = 3"


# --- calibration ---


def segment_models(s: SparkSession, d: str) -> DataFrame:
    m = calibration.train(tables.truth(s, d))
    return m.select("supplier", "field", "x", "weight", F.round("fit", 9).alias("fit"))


_SEGMENTS = f"""{sql.TRUTH}, seg AS (SELECT DISTINCT doc_id, unnest([coalesce(supplier, '*'), coalesce(supplier, '*'), '*', '*']) AS s, unnest([coalesce(field, '*'), '*', coalesce(field, '*'), '*']) AS f, raw_confidence, actual_correct FROM truth),
  pt AS (SELECT s, f, round_even(raw_confidence, 4) AS x, avg(CAST(actual_correct AS INT))::DOUBLE AS y, count(*) AS weight FROM seg GROUP BY 1, 2, 3), able AS (SELECT s, f FROM pt GROUP BY 1, 2 HAVING sum(weight) >= CASE WHEN s <> '*' AND f <> '*' THEN 200 WHEN s <> '*' THEN 150 WHEN f <> '*' THEN 100 ELSE 50 END AND count(*) >= 8),
  n AS (SELECT row_number() OVER (PARTITION BY s, f ORDER BY x) AS k, s, f, x, y * weight AS t, weight FROM pt JOIN able USING (s, f)), c AS (SELECT *, sum(t) OVER (PARTITION BY s, f ORDER BY k) AS ct, sum(weight) OVER (PARTITION BY s, f ORDER BY k) AS cw FROM n),
  m AS (SELECT a.s, a.f, a.k AS i, b.k AS j, (b.ct - a.ct + a.t) / (b.cw - a.cw + a.weight) AS w FROM c a JOIN c b ON a.s = b.s AND a.f = b.f AND a.k <= b.k), lo AS (SELECT s, f, i, j, min(w) OVER (PARTITION BY s, f, i ORDER BY j DESC) AS w FROM m),
  model AS (SELECT c.s AS supplier, c.f AS field, c.x, c.weight, max(lo.w) AS fit FROM c JOIN lo ON lo.s = c.s AND lo.f = c.f AND lo.j = c.k AND lo.i <= c.k GROUP BY ALL)"""
# Interpolation between a segment's points; segments are tried from the narrowest.
_CALIBRATED = f"""{_SEGMENTS}, used AS (SELECT doc_id, raw_confidence, actual_correct, coalesce((SELECT any_value(supplier || '/' || field) FROM model m WHERE m.supplier = t.supplier AND m.field = t.field), (SELECT any_value(supplier || '/*') FROM model m WHERE m.supplier = t.supplier AND m.field = '*'), (SELECT any_value('*/' || field) FROM model m WHERE m.supplier = '*' AND m.field = t.field), (SELECT '*/*' FROM model m WHERE m.supplier = '*' AND m.field = '*' LIMIT 1)) AS model FROM truth t),
  near AS (SELECT doc_id, raw_confidence, actual_correct, u.model, (SELECT max(x) FROM model m WHERE m.supplier || '/' || m.field = u.model AND x <= raw_confidence) AS lx, (SELECT min(x) FROM model m WHERE m.supplier || '/' || m.field = u.model AND x >= raw_confidence) AS hx FROM used u),
  ends AS (SELECT near.*, l.fit AS lf, h.fit AS hf FROM near LEFT JOIN model l ON l.supplier || '/' || l.field = near.model AND l.x = lx LEFT JOIN model h ON h.supplier || '/' || h.field = near.model AND h.x = hx),
  cal AS (SELECT doc_id, raw_confidence, actual_correct, model, CASE WHEN model IS NULL THEN raw_confidence WHEN lx = hx THEN lf WHEN lx IS NULL THEN hf WHEN hx IS NULL THEN lf ELSE lf + (hf - lf) * (raw_confidence - lx) / (hx - lx) END AS calibrated FROM ends)"""


def segment_calibrated(s: SparkSession, d: str) -> DataFrame:
    t = tables.truth(s, d)
    return calibration.calibrate(t, calibration.train(t)).select("doc_id", "model", F.round("calibrated", 9).alias("calibrated"))


def _whole_fit(s: SparkSession, d: str) -> DataFrame:
    t = tables.truth(s, d)
    return calibration.apply_fit(t, calibration.isotonic(calibration.weighted_points(t)))


def calib_report(s: SparkSession, d: str) -> DataFrame:
    r = calibration.report(_whole_fit(s, d))
    return r.select(*(F.round(c, 8).alias(c) for c in ("ece", "ece_equal_width", "mce", "max_drift", "brier", "accuracy")), "n", "bins_with_data", "recalibrate")


def calib_bins(s: SparkSession, d: str) -> DataFrame:
    return calibration.report_bins(_whole_fit(s, d)).select("label", "n", *(F.round(c, 8).alias(c) for c in ("mean_raw", "mean_calibrated", "accuracy", "drift")))


WHOLE_FIT = f"""{sql.TRUTH}, pts AS (SELECT round_even(raw_confidence, 4) AS x, avg(CAST(actual_correct AS INT))::DOUBLE AS y, count(*) AS weight FROM truth GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY x) AS k, x, y * weight AS s, weight FROM pts), c AS (SELECT k, x, sum(s) OVER (ORDER BY k) AS cs, sum(weight) OVER (ORDER BY k) AS cw, s, weight FROM n),
  m AS (SELECT a.k AS i, b.k AS j, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.weight) AS w FROM c a JOIN c b ON a.k <= b.k), lo AS (SELECT i, j, min(w) OVER (PARTITION BY i ORDER BY j DESC) AS w FROM m), fit AS (SELECT c.x, max(lo.w) AS fit FROM c JOIN lo ON lo.j = c.k AND lo.i <= c.k GROUP BY c.x),
  near AS (SELECT doc_id, raw_confidence, actual_correct, (SELECT max(x) FROM fit WHERE x <= raw_confidence) AS lx, (SELECT min(x) FROM fit WHERE x >= raw_confidence) AS hx FROM truth),
  cal AS (SELECT doc_id, raw_confidence, CAST(actual_correct AS INT)::DOUBLE AS ok, CASE WHEN lx = hx OR hx IS NULL THEN l.fit WHEN lx IS NULL THEN h.fit ELSE l.fit + (h.fit - l.fit) * (raw_confidence - lx) / (hx - lx) END AS calibrated FROM near LEFT JOIN fit l ON l.x = lx LEFT JOIN fit h ON h.x = hx)"""
REPORT_SQL = f"""WITH {WHOLE_FIT}, q AS (SELECT quantile_cont(raw_confidence, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM truth), fb AS (SELECT len(list_filter(e, lambda v: v <= raw_confidence)) AS bin, count(*) AS n, abs(avg(calibrated) - avg(ok)) AS gap FROM cal, q GROUP BY 1),
  eb AS (SELECT least(floor(raw_confidence * 10), 9) AS bin, count(*) AS n, abs(avg(calibrated) - avg(ok)) AS gap FROM cal GROUP BY 1), f AS (SELECT sum(gap * n) / sum(n) AS ece, max(gap) AS mce, CAST(sum(n) AS BIGINT) AS n FROM fb), e AS (SELECT sum(gap * n) / sum(n) AS ece_equal_width, max(gap) AS max_drift, count(*) AS bins_with_data FROM eb), b AS (SELECT avg((calibrated - ok) * (calibrated - ok)) AS brier, avg(ok) AS accuracy FROM cal)
  SELECT round(ece, 8) AS ece, round(ece_equal_width, 8) AS ece_equal_width, round(mce, 8) AS mce, round(max_drift, 8) AS max_drift, round(brier, 8) AS brier, round(accuracy, 8) AS accuracy, n, bins_with_data, bins_with_data >= 5 AND (ece > CASE WHEN n < 200 THEN 0.08 WHEN n < 500 THEN 0.06 ELSE 0.05 END OR mce > CASE WHEN n < 200 THEN 0.15 WHEN n < 500 THEN 0.12 ELSE 0.10 END) AS recalibrate FROM f, e, b"""
BINS_SQL = f"""WITH {WHOLE_FIT}, eb AS (SELECT least(floor(raw_confidence * 10), 9) AS bin, count(*) AS n, avg(raw_confidence) AS r, avg(calibrated) AS c, avg(ok) AS a FROM cal GROUP BY 1)
  SELECT printf('%.1f', i / 10.0) || '-' || printf('%.1f', (i + 1) / 10.0) AS label, coalesce(n, 0) AS n, round(coalesce(r, 0), 8) AS mean_raw, round(coalesce(c, 0), 8) AS mean_calibrated, round(coalesce(a, 0), 8) AS accuracy, round(coalesce(abs(c - a), 0), 8) AS drift FROM range(10) t(i) LEFT JOIN eb ON bin = i"""


def plain_words(s: SparkSession, d: str) -> DataFrame:
    """Accented forms of every supplier's name fold to the same plain text."""
    n = F.col("s_name")
    return tables.table(s, d, "supplier").select("s_suppkey", text.plain_lower(F.concat(F.lit("Ålands  ĆŽ ẛ "), n, F.lit(" Société"))).alias("plain"))


QUERIES = {f.__name__: f for f in (
    invoice_dates, final_total, total_retry, line_checks, invoice_messages, stated_sums, lines_by_position, odd_units, odd_prices, record_rejects, document_rejects, reply_parse, reply_plausible, artifact_bands, matched_patterns, gate_flags, invoice_store, corrections_newest, patterns_by_use, chosen_corrections,
    batch_counts, enrichment_diff, artifact_kinds, page_metrics, page_invoice_numbers, segment_models, segment_calibrated, calib_report, calib_bins, plain_words,
)} | {
    "odd_unit_shares": lambda s, d: diagnostics.unit_summary(_odd_lines(s, d)).withColumn("percent", F.round("percent", 6)), "odd_categories": lambda s, d: diagnostics.problem_counts(_odd_lines(s, d)),
    "odd_fixes": lambda s, d: diagnostics.fix_check(_odd_lines(s, d)).groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "pattern_boosts": lambda s, d: _pattern_boosts(s, d),
}


def _pattern_boosts(s: SparkSession, d: str) -> DataFrame:
    """Uses that a run adds to its patterns."""
    q = tables.patterns(s, d).filter("pattern_id % 21 = 0").select(F.col("pattern_id").alias("invoice_id"), "supplier_name", "layout_hash", "position_x", "position_y")
    matches = learning.match_patterns(q, tables.patterns(s, d))
    after = totals.used(tables.patterns(s, d), matches, F.expr("timestamp_ntz'2024-06-01 00:00:00'"))
    return after.select("pattern_id", "usage_count", (F.col("last_used") == F.expr("timestamp_ntz'2024-06-01 00:00:00'")).alias("used"))


ORACLES = {
    "invoice_dates": DATES_SQL, "final_total": _FINAL, "total_retry": RETRY_SQL, "pattern_boosts": BOOSTS_SQL, "line_checks": LINE_CHECKS_SQL, "invoice_messages": MESSAGES_SQL, "stated_sums": STATED_SQL, "lines_by_position": POSITION_SQL,
    "odd_units": f"WITH {_ODD} SELECT ['ea', 'ltr', 'månad', 'day', 'xpa'][u + 1] AS unit, ['', 'Artikelnummer i antal;Antal för stort', 'Á-pris stämmer inte', 'Á-pris stämmer inte', 'Antal för stort', ''][v + 1] AS problems, count(*) AS n FROM o WHERE u < 5 GROUP BY 1, 2",
    "odd_prices": f"WITH {_ODD} SELECT CASE v WHEN 2 THEN 'Bult' ELSE 'Mutter 2 108 ' || ['ea', 'ltr', 'månad', 'day', 'xpa'][u + 1] END AS description, CASE v WHEN 2 THEN 500.0 ELSE 263.5 END::DOUBLE AS ratio, CASE v WHEN 2 THEN '' ELSE '2108' END AS quantities, count(*) AS n FROM o WHERE u < 5 AND v IN (2, 3) GROUP BY ALL",
    "odd_unit_shares": f"WITH {_ODD}, c AS (SELECT v IN (0, 5) AS sound FROM o WHERE u < 5), a AS (SELECT count(*) AS t FROM c) SELECT sound, count(*) AS n, round(count(*) * 100.0 / any_value(t), 6)::DOUBLE AS percent FROM c, a GROUP BY sound",
    "odd_categories": f"WITH {_ODD}, r AS (SELECT unnest(CASE v WHEN 1 THEN ['artikelnummer_i_antal'] WHEN 2 THEN ['unit_price_for_liten'] ELSE [CASE WHEN d THEN 'komplexa_rabatter' ELSE 'unit_price_stämmer_inte' END, 'tusen_separator_problem'] END) AS category FROM o WHERE u < 5 AND v IN (1, 2, 3)) SELECT category, count(*) AS n FROM r GROUP BY 1",
    "odd_fixes": f"WITH {_ODD} SELECT ['ea', 'LTR', 'månad', 'day', 'xpa', 'st'][u + 1] AS unit, count(*) AS n FROM o WHERE v = 1 GROUP BY 1",
    "record_rejects": REJECTS_SQL, "document_rejects": "SELECT conv_id AS doc_id, conv_id % 4 = 0 AS rejected FROM conversations GROUP BY 1", "reply_parse": REPLY_SQL, "reply_plausible": PLAUSIBLE_SQL, "artifact_bands": BANDS_SQL, "matched_patterns": MATCHED_SQL, "gate_flags": GATE_SQL, "invoice_store": STORE_SQL,
    "corrections_newest": f"WITH {sql.CORRECTIONS} SELECT arrival FROM cor WHERE supplier_name = 'click' ORDER BY ts DESC, CAST(arrival AS VARCHAR) DESC LIMIT 50",
    "patterns_by_use": f"WITH {sql.PATTERNS}, u AS (SELECT pattern_id, CAST(CASE WHEN pattern_id % 3 = 0 THEN 9 ELSE usage_count END AS INT) AS usage_count, correct_total, last_used FROM pat) SELECT pattern_id, usage_count, correct_total FROM u ORDER BY usage_count DESC, last_used DESC, pattern_id LIMIT 50",
    "chosen_corrections": CHOSEN_SQL, "batch_counts": COUNTS_SQL, "enrichment_diff": DIFF_SQL, "artifact_kinds": KINDS_SQL, "page_metrics": METRICS_SQL, "page_invoice_numbers": PAGE_NUMBERS_SQL,
    "segment_models": f"WITH {_SEGMENTS} SELECT supplier, field, x, weight, round(fit, 9) AS fit FROM model", "segment_calibrated": f"WITH {_CALIBRATED} SELECT doc_id, model, round(calibrated, 9) AS calibrated FROM cal", "calib_report": REPORT_SQL, "calib_bins": BINS_SQL,
    "plain_words": r"SELECT s_suppkey, 'alands cz s ' || lower(s_name) || ' societe' AS plain FROM supplier",
    "calib_applied": f"WITH {WHOLE_FIT} SELECT doc_id, round(calibrated, 9) AS calibrated FROM cal",
}
