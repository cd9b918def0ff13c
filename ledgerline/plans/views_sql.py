"""The views of ``sources.tables`` in DuckDB SQL, as common table expressions."""

INV = """inv AS (
  SELECT o_orderkey AS invoice_id, CAST(o_orderkey AS VARCHAR) AS invoice_number, n_name AS supplier_name, c_name AS customer_name, o_custkey AS file_id,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS invoice_date, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS total_amount,
    CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'P' THEN 'PARTIAL' ELSE 'REVIEW' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

LINES = """lines AS (
  SELECT l_orderkey AS invoice_id, l_linenumber AS line_number, l_partkey AS part_id, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_discount AS DECIMAL(4,2)) AS discount,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS line_total, l_linenumber % 3 + 1 AS n_rows
  FROM lineitem)"""

HEADERS = f"""{INV}, {LINES}, sums AS (
  SELECT invoice_id, CAST(sum(line_total) AS DECIMAL(28,2)) AS s, count(*) AS n, sum(n_rows) AS rows_all, max(n_rows) AS max_rows FROM lines GROUP BY invoice_id), h AS (
  SELECT inv.invoice_id, invoice_number, supplier_name, customer_name, file_id, invoice_date,
    CASE WHEN inv.invoice_id % 17 <> 0 THEN CAST(coalesce(s, 0) + CASE inv.invoice_id % 5 WHEN 0 THEN 25.50 WHEN 1 THEN 0.75 WHEN 2 THEN 3.25 ELSE 0.00 END AS DECIMAL(28,2)) END AS header_total,
    CAST(0.99 AS DOUBLE) - CASE WHEN inv.invoice_id % 7 = 0 THEN CAST(0.09 AS DOUBLE) ELSE 0 END AS number_confidence, CAST(0.97 AS DOUBLE) - CASE WHEN inv.invoice_id % 19 = 0 THEN CAST(0.05 AS DOUBLE) ELSE 0 END AS total_confidence,
    CAST(coalesce(s, 0) AS DECIMAL(28,2)) AS lines_sum, coalesce(n, 0) AS n_lines, rows_all, max_rows
  FROM inv LEFT JOIN sums ON inv.invoice_id = sums.invoice_id), d AS (
  SELECT *, CAST(header_total - lines_sum AS DECIMAL(28,2)) AS diff, number_confidence >= 0.95 AND total_confidence >= 0.95 AS gate FROM h), st AS (
  SELECT *, coalesce(abs(diff) <= 1.00, false) AS flat_ok, coalesce(abs(diff) <= CASE WHEN header_total > 1000 THEN greatest(1.0000, CAST(header_total * 0.005 AS DECIMAL(28,4))) ELSE 1.0000 END, false) AS scaled_ok FROM d), v AS (
  SELECT *, CASE WHEN NOT gate OR header_total IS NULL OR n_lines = 0 THEN 'REVIEW' WHEN scaled_ok THEN 'OK' ELSE 'PARTIAL' END AS status FROM st), q AS (
  SELECT *, CASE status WHEN 'REVIEW' THEN 40.0 WHEN 'PARTIAL' THEN 15.0 ELSE 0.0 END::DOUBLE AS status_penalty,
    least((CAST(invoice_date IS NULL AS INT) + CAST(header_total IS NULL AS INT)) * 10.0, 30.0)::DOUBLE AS missing_penalty,
    CASE WHEN diff IS NULL THEN 20.0 WHEN abs(diff::DOUBLE) <= 0.01 THEN 0.0 WHEN abs(diff::DOUBLE) <= 1 THEN abs(diff::DOUBLE) * 2 WHEN abs(diff::DOUBLE) <= 10 THEN (abs(diff::DOUBLE) - 1) * 1.5 + 2 ELSE least((abs(diff::DOUBLE) - 10) * 0.5, 4.5) + 15.5 END::DOUBLE AS difference_penalty,
    least(greatest(CASE WHEN n_lines > 0 THEN rows_all::DOUBLE / n_lines ELSE 0 END - 1, 0) * 2 + greatest(coalesce(max_rows, 0)::DOUBLE - 2, 0) * 3, 20)::DOUBLE AS wrap_penalty
  FROM v), sc AS (
  SELECT *, greatest(0, 100 - status_penalty - missing_penalty - difference_penalty - wrap_penalty)::DOUBLE AS score FROM q)"""

CORRECTIONS = """cor AS (
  SELECT user_id AS invoice_id, CASE WHEN event_id % 9 <> 0 THEN event_type END AS supplier_name, CASE WHEN event_id % 6 <> 0 THEN CAST(value AS DECIMAL(18,2)) END AS corrected_total,
    CASE WHEN event_id % 10 <> 0 THEN round(event_id % 97 / CAST(97.0 AS DOUBLE), 4) END AS confidence, event_id AS arrival, CAST(ts AS TIMESTAMP) AS ts FROM events)"""

PATTERNS = """pat AS (
  SELECT event_id AS pattern_id, event_type AS supplier_name, md5(event_type || 'footer') AS layout_hash, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id * 37 % 600 AS DOUBLE) END AS position_x, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id * 53 % 800 AS DOUBLE) END AS position_y,
    CAST(event_id % 3 AS DOUBLE) AS correct_total, CAST(0.1 AS DOUBLE) AS confidence_boost, CAST(event_id % 5 AS INT) AS usage_count, CAST(ts AS TIMESTAMP) AS last_used FROM events)"""

TRUTH = """truth AS (
  SELECT l.doc_id, round(least(1.0, n_chars % 1000 / CAST(1000.0 AS DOUBLE) * CAST(0.6 AS DOUBLE) + l.doc_id % 41 / CAST(100.0 AS DOUBLE)), 6) AS raw_confidence, quality = 1 AS actual_correct, source AS supplier, lang AS field
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

TOKENS = r"""words AS (
  SELECT doc_id, unnest(string_split(trim(regexp_replace(text, '[ \n\t\r]+', ' ', 'g')), ' ')) AS text, generate_subscripts(string_split(trim(regexp_replace(text, '[ \n\t\r]+', ' ', 'g')), ' '), 1) - 1 AS i FROM documents), tok AS (
  SELECT doc_id, CAST(i // 200 AS INT) AS page_number, CAST(i AS INT) AS token_idx, text, (i % 8 * 70.0)::DOUBLE AS x, (i % 200 // 8 * 30.0 + i % 8 * 1.25)::DOUBLE AS y, 50.0::DOUBLE AS width, (i % 5 + 8.0)::DOUBLE AS height, i FROM words)"""
