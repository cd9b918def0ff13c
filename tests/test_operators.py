import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import analytics, calibration, layout, learning, reconcile
from ledgerline.sources import tables


def test_keyword_parser():
    q = analytics.parse_query("Totalsumma i mars 2026 från Acme Corp i Sverige")
    assert q.query_type == "aggregate" and q.filters["supplier_name"] == "acme corp"
    assert q.filters["date_from"] == dt.date(2026, 3, 1) and q.filters["date_to"] == dt.date(2026, 3, 31)
    assert analytics.parse_query("summary of invoices").query_type == "aggregate"  # 'summary' holds 'sum'
    assert analytics.parse_query("översikt").query_type == "summarize"
    assert analytics.parse_query("jämför, sortera på belopp").sort_by == "amount"


def test_aggregates_ignore_the_limit(spark, small):
    inv = tables.invoices(spark, small)
    one = analytics.execute(analytics.QueryIntent("aggregate", aggregations=("count",), limit=2), inv)
    assert one["aggregates"].first()[0] == inv.count() and one["rows"].count() == 2


def test_anchored_rows(spark):
    t = spark.createDataFrame([("d", 1, i, f"w{i}", float(i), y, 5.0, 792.0) for i, y in enumerate([1.0, 2.0, 7.0, 8.0, 20.0])], "doc_id string, page_number int, token_idx int, text string, x double, y double, width double, page_height double")
    got = {r.token_idx: r.row_idx for r in layout.group_rows(t).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def boundary(spark, pages):
    rows = [("f", i + 1, n, c) for i, (n, c) in enumerate(pages)]
    df = spark.createDataFrame(rows, "doc_id string, page_number int, invoice_no string, counter struct<current:int,total:int>")
    return sorted((r.page_start, r.page_end) for r in layout.invoice_boundaries(df).collect())


def test_boundaries(spark):
    assert boundary(spark, [("A", None), (None, None), ("B", None), ("B", None)]) == [(1, 2), (3, 4)]
    assert boundary(spark, [(None, (1, 2)), (None, (2, 2)), (None, (1, 2)), (None, (2, 2))]) == [(1, 2), (3, 4)]
    assert boundary(spark, [(None, None), ("A", None), (None, None)]) == [(1, 3)]


def test_only_footer_page_has_items(spark):
    rows = spark.createDataFrame([("d", 1, i, 700.0 + i, 792.0) for i in range(3)], "doc_id string, page_number int, row_idx int, y double, page_height double")
    assert sorted((r.segment_type, r.n_rows) for r in layout.segments(rows).collect()) == [("footer", 3), ("items", 3)]


def test_keep_best_is_idempotent(spark, small):
    once = learning.keep_best(tables.corrections(spark, small))
    assert sorted(once.collect(), key=str) == sorted(learning.keep_best(once).collect(), key=str)


def test_keep_best_tie_keeps_the_first(spark):
    c = spark.createDataFrame([(1, 0.9, 2, "b"), (1, 0.9, 1, "a"), (1, None, 0, "n"), (2, None, 5, "x")], "invoice_id int, confidence double, arrival int, tag string")
    assert {r.invoice_id: r.tag for r in learning.keep_best(c).collect()} == {1: "a", 2: "x"}


def test_consolidation(spark):
    p = spark.createDataFrame([("s", "h", 1, 0.0, 0.0, 5), ("s", "h", 2, 30.0, 0.0, 3), ("s", "h", 3, 70.0, 0.0, 1), ("s", "h", 4, None, None, 9)], "supplier_name string, layout_hash string, pattern_id int, position_x double, position_y double, usage_count int").withColumn("last_used", F.lit("2024-01-01").cast("timestamp"))
    got = {r.pattern_id: (r.usage_count, r.merged) for r in learning.consolidate(p).collect()}
    assert got == {1: (8, 2), 3: (1, 1), 4: (9, 1)}


def test_isotonic_rises_and_ece_below_mce(spark, small):
    t = tables.truth(spark, small)
    fit = [r.fit for r in calibration.isotonic(calibration.weighted_points(t)).orderBy("x").collect()]
    assert fit == sorted(fit)
    e = calibration.errors(calibration.bin_means(t, F.least(F.floor(F.col("raw_confidence") * 10), F.lit(9)), "raw_confidence")).first()
    assert e.ece <= e.mce


@pytest.mark.parametrize(("gate", "total", "n", "passed", "want"), [(False, 1.0, 1, True, "REVIEW"), (True, None, 1, True, "REVIEW"), (True, 1.0, 0, True, "REVIEW"), (True, 1.0, 1, True, "OK"), (True, 1.0, 1, False, "PARTIAL")])
def test_status(spark, gate, total, n, passed, want):
    got = spark.range(1).select(reconcile.status(F.lit(gate), F.lit(total).cast("double"), F.lit(n), F.lit(passed))).first()[0]
    assert got == want


@pytest.mark.parametrize(("diff", "want"), [(None, 20.0), (0.005, 0.0), (0.5, 1.0), (4.0, 6.5), (10.0, 15.5), (1000.0, 20.0)])
def test_difference_penalty(spark, diff, want):
    assert spark.range(1).select(reconcile.difference_penalty(F.lit(diff).cast("double"))).first()[0] == pytest.approx(want)
