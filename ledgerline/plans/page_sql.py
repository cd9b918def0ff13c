"""Oracles of the page queries: layout, routing, boundaries and pattern folds in DuckDB SQL."""

from __future__ import annotations

from ledgerline.plans import views_sql as sql

# y in a row of eight words rises by 1.25 a word from the row's first; within 5 points that is the first five words.
ROWS = f"""{sql.TOKENS}, r AS (SELECT doc_id, page_number, CAST(i % 200 // 8 * 2 + CASE WHEN i % 8 > 4 THEN 1 ELSE 0 END AS INT) AS row_idx, avg(y) AS y, min(x) AS x_min, arg_min(height, x) AS height FROM tok GROUP BY 1, 2, 3)"""
_GAPS = f"""{ROWS}, g AS (SELECT *, lead(y) OVER w - (y + height) AS after, y - lag(y + height) OVER w AS before FROM r WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY y, row_idx)),
  t AS (SELECT doc_id, page_number, coalesce(median(CASE WHEN after > 0 THEN after END) * 1.5, 15.0)::DOUBLE AS gap_threshold FROM g GROUP BY 1, 2)"""
_SCORED = r"""d AS (SELECT doc_id, trim(coalesce(text, ''), E' \n\t\r') AS t FROM documents), w AS (SELECT doc_id, t, length(t) AS n, list_transform(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> ''), lambda x: length(x)) AS l, lower(t) AS low FROM d),
  h AS (SELECT *, coalesce(list_aggregate(l, 'median'), 0) AS half, length(regexp_replace(t, '[\p{L}\p{N}\s.,/:;-]', '', 'g')) AS weird, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) AS alnum, len(list_filter(['total', 'moms', 'faktura', 'bankgiro', 'att betala', 'summa'], lambda k: contains(low, k))) AS known FROM w),
  q AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, least(1.0, n / 30.0::DOUBLE * 0.5 + len(l) / 5.0::DOUBLE * 0.5) * 0.25 + (1 - least(1.0, weird / n::DOUBLE * 2)) * 0.3 + alnum / n::DOUBLE * 0.25 + CASE WHEN half BETWEEN 2 AND 20 THEN 1.0 ELSE greatest(0.0, 1 - abs(half - 10) / 30.0::DOUBLE) END * 0.2 + least(0.2, known * 0.05))) END::DOUBLE AS quality,
    n >= 500 AS chars, regexp_matches(t, '(?i)\bthe\b') AS req, regexp_matches(t, '(?i)\bof\b') AS ext FROM h),
  u AS (SELECT *, (chars AND req AND ext) AS base, round(quality, 12) >= 0.5 AND len(l) >= 40 AS override FROM q), z AS (SELECT *, base OR override AS used FROM u)"""
_ONLY = lambda *pairs: f"list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for c, n in pairs)}], lambda x: x IS NOT NULL)"
_SIGNALS = (("used", "text_layer"), ("round(quality, 12) >= 0.5", "text_quality"), ("req", "anchor_required"))
_TABLE = ("contains(t, '|')", "table_pattern")

ORACLES = {
    "reading_order": f"""WITH {sql.TOKENS}, m AS (SELECT doc_id, page_number, greatest(2.0, least(15.0, median(height) * 0.5)) AS tol FROM tok GROUP BY 1, 2)
    SELECT doc_id, page_number, token_idx, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY i % 200 // 8 * 2 + CASE WHEN i % 8 * 1.25 > tol THEN 1 ELSE 0 END, x, token_idx) - 1 AS INT) AS position FROM tok JOIN m USING (doc_id, page_number)""",
    "segment_table": f"""WITH {ROWS}, b AS (SELECT *, CASE WHEN y < 792.0::DOUBLE * 0.3 THEN 'header' WHEN y > 792.0::DOUBLE * 0.7 THEN 'footer' ELSE 'items' END AS k FROM r), o AS (SELECT doc_id, page_number FROM b GROUP BY 1, 2 HAVING bool_and(k = 'footer')), c AS (SELECT doc_id, page_number, k, y FROM b UNION ALL SELECT doc_id, page_number, 'items', y FROM b JOIN o USING (doc_id, page_number))
    SELECT doc_id, page_number, k AS segment_type, count(*) AS n_rows, min(y) AS y_min, max(y) AS y_max FROM c GROUP BY 1, 2, 3""",
    "wrap_gap_threshold": f"WITH {_GAPS} SELECT * FROM t",
    "wrap_absorb": f"""WITH {_GAPS}, l AS (SELECT g.*, gap_threshold, row_idx % 4 = 0 AS starts, sum(CASE WHEN row_idx % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY y, row_idx) AS line FROM g JOIN t USING (doc_id, page_number)),
    f AS (SELECT *, starts OR (before <= gap_threshold AND x_min - min(CASE WHEN starts THEN x_min END) OVER (PARTITION BY doc_id, page_number, line) BETWEEN 612 * -0.02 AND 612 * 0.05) AS fits FROM l)
    SELECT doc_id, page_number, row_idx, CAST(line AS BIGINT) AS line_number, min(CASE WHEN fits THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number, line ORDER BY y, row_idx ROWS UNBOUNDED PRECEDING) = 1 AND line > 0 AS absorbed FROM f""",
    "text_quality": f"WITH {_SCORED} SELECT doc_id, round(quality, 9) AS text_quality, used AS use_text_layer, array_to_string({_ONLY(('NOT chars', 'min_text_chars'), ('NOT req', 'required_anchor_missing'), ('NOT ext', 'extra_anchor_missing'), ('override AND NOT base', 'quality_override'))}, ',') AS reasons FROM z",
    "edi_signals": f"WITH {_SCORED}, s AS (SELECT *, {_ONLY(*_SIGNALS, ('ext', 'anchor_extra'), _TABLE)} AS signals FROM z) SELECT doc_id, used AND req AND len(signals) >= 2 AS edi_like, array_to_string(signals, ',') AS signals FROM s",
    "policy_gate": f"""WITH {_SCORED}, s AS (SELECT doc_id, used AND req AND len({_ONLY(*_SIGNALS, _TABLE)}) >= 2 AS edi, doc_id % 3 = 0 AS ok FROM z)
    SELECT doc_id, NOT edi AS allow_ai, CASE WHEN edi AND ok THEN 'edi_blocked_validation_ok' WHEN edi THEN 'edi_force_review' END AS gate_reason FROM s""",
    "invoice_boundaries": """WITH RECURSIVE c AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'INV-' || ((conv_id + turn) % 8) END AS inv, CASE WHEN (conv_id + turn) % 3 = 0 THEN turn % 3 + 1 END AS cur FROM conversations),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, inv NULLS FIRST, cur NULLS FIRST) AS n FROM c), f(doc_id, n, starts, num, cur) AS (
      SELECT doc_id, CAST(0 AS BIGINT), [min(page_number)], CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM p GROUP BY doc_id UNION ALL
      SELECT f.doc_id, p.n, CASE WHEN (coalesce(p.inv <> f.num, false) OR (p.inv IS NULL AND coalesce(p.cur <> f.cur + 1, false))) AND p.page_number > f.starts[-1] THEN list_append(f.starts, p.page_number) ELSE f.starts END,
        CASE WHEN p.inv IS NOT NULL THEN p.inv WHEN coalesce(p.cur <> f.cur + 1, false) THEN NULL ELSE f.num END, CAST(p.cur AS BIGINT) FROM f JOIN p ON p.doc_id = f.doc_id AND p.n = f.n + 1),
    e AS (SELECT doc_id, arg_max(starts, n) AS s FROM f GROUP BY 1), l AS (SELECT doc_id, max(page_number) AS last FROM p GROUP BY 1), x AS (SELECT doc_id, s, unnest(s) AS page_start, generate_subscripts(s, 1) AS i FROM e)
    SELECT x.doc_id, page_start, CAST(coalesce(s[i + 1] - 1, last) AS INT) AS page_end FROM x JOIN l ON l.doc_id = x.doc_id""",
    "pattern_consolidate": f"""WITH RECURSIVE {sql.PATTERNS}, a AS (SELECT * FROM pat WHERE position_x IS NOT NULL), pl AS (SELECT supplier_name AS s, layout_hash AS h, position_x AS x, position_y AS y, min((-usage_count, -epoch_us(last_used), pattern_id)) AS o, sum(usage_count) AS u, max(last_used) AS t, count(*) AS n FROM a GROUP BY 1, 2, 3, 4),
    k AS (SELECT *, o[3] AS id, row_number() OVER (PARTITION BY s, h ORDER BY o) AS k FROM pl), f(s, h, k, leaders, owner) AS (SELECT s, h, k, [{{'id': id, 'x': x, 'y': y}}], id FROM k WHERE k = 1 UNION ALL
      SELECT f.s, f.h, k.k, CASE WHEN len(list_filter(f.leaders, lambda q: sqrt((q.x - k.x) * (q.x - k.x) + (q.y - k.y) * (q.y - k.y)) <= 50)) > 0 THEN f.leaders ELSE list_append(f.leaders, {{'id': k.id, 'x': k.x, 'y': k.y}}) END,
        coalesce(list_filter(f.leaders, lambda q: sqrt((q.x - k.x) * (q.x - k.x) + (q.y - k.y) * (q.y - k.y)) <= 50)[1].id, k.id) FROM f JOIN k ON k.s = f.s AND k.h = f.h AND k.k = f.k + 1)
    SELECT k.s AS supplier_name, k.h AS layout_hash, owner AS pattern_id, CAST(sum(u) AS BIGINT) AS usage_count, max(t) AS last_used, CAST(sum(n) AS BIGINT) AS merged FROM k JOIN f ON f.s = k.s AND f.h = k.h AND f.k = k.k GROUP BY 1, 2, 3 UNION ALL SELECT supplier_name, layout_hash, pattern_id, usage_count, last_used, 1 FROM pat WHERE position_x IS NULL""",
}
