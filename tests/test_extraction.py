import decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import rows
from ledgerline.operators import columns, extraction
from ledgerline.sources import files
from ledgerline.streaming import arrivals

D = decimal.Decimal


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("text"))).collect()]


def test_line_amounts(spark):
    got = values(spark, ["440,00 -88,00 1 672,00", "10,5% 1 200,00", "Vara 283.00 38 st 500,00", "-5,00", "ingen", None, ""], rows.line_amount)
    assert [(r.amount, r.discount) if r else None for r in got] == [(D("1672"), D("88")), (D("1200"), D("0.105")), (D("500"), D("38")), None, None, None, None]


def test_row_kinds(spark):
    assert values(spark, ["Att betala", "Summa 5,00", "Summa", "12345 Maskiner 20 000,00", "Betong C25 till platta på mark 100,00", None], rows.is_footer_row) == [True, True, False, True, False, False]
    assert values(spark, ["12345 x", "ABC12", "2026-01-26 x", "26/01", "4010 x", "med bricka", None], rows.starts_item) == [True] * 5 + [False] * 2
    assert values(spark, ["Artikelnr Nettobelopp", "Nettobelopp", None], rows.is_table_header) == [True, False, False]


def test_number_candidates(spark):
    df = spark.createDataFrame([("1234567", "x"), ("20240131", "x"), ("12345", "Storgata 12345"), ("123456", "123456 kr"), ("5560001234", "x"), (None, None)], "c string, text string")
    assert [tuple(r) for r in df.select(rows.number_likely(F.col("c"), F.col("text")), rows.number_shape(F.col("c"))).collect()] == [(True, True), (False, True), (False, True), (False, True), (True, False), (False, False)]


HEADER = "invoice_id string, row_idx int, y double, page_height double, text string"


def page(spark, *texts, y=20.0):
    return spark.createDataFrame([("a", i, y + 20 * i, 800.0, t) for i, t in enumerate(texts)], HEADER)


def test_header_fields(spark):
    header = page(spark, "Sida 1/2", None, "Norra Verkstaden", "Bygg AB", "Fakturanummer", "4061547", "Er referens: RF 12")
    assert extraction.pick_supplier(header).first().supplier_name == "Bygg AB"
    assert extraction.pick_reference(header).first().reference == "rf 12"
    assert extraction.pick_number(header).first().invoice_number == "4061547"
    assert extraction.pick_number(page(spark, "Faktura 123456")).first().invoice_number == "123456"  # the label takes a digit, the word gives it back
    assert extraction.pick_number(page(spark, "Hej", "")).count() == 0
    assert extraction.pick_supplier(header.limit(0)).count() == 0


def test_totals(spark):
    footer = page(spark, "Netto 1 000,00", "Moms 25 %", "Att betala", "1 250,00", None, y=600.0)
    assert extraction.footer_total(footer, extraction.NET, "v").first().v == 1000
    assert extraction.footer_total(footer, extraction.GROSS, "v").first().v == 1250
    sums = spark.createDataFrame([("a", D("1250.00"))], "invoice_id string, lines_sum decimal(18,2)")
    scored = extraction.score_totals(footer, sums)
    best = scored.orderBy(F.desc("score")).first()
    assert best.amount == 1250 and best.largest
    assert [r["rank"] for r in extraction.shown_candidates(scored, footer, most=2).orderBy("rank").collect()] == [1, 2]


def test_items(spark):
    items = page(spark, "Artikelnr Benämning Nettobelopp", "12345 Skruv 10 st 5,00 25,00 50,00", "med bricka", "20001 Mutter 2 st 10,00 25,00 -5,00 15,00", "30001 Bult 1 st 4,00", "Nettobelopp exkl. moms 65,00", "9 st 3,00")
    got = [(r.line_number, r.description, r.quantity, r.unit, r.amount, r.discount) for r in extraction.item_lines(items).orderBy("line_number").collect()]
    assert got == [(1, "12345 Skruv 10 st 5,00 25,00 50,00 med bricka", 10, "st", 50, None), (2, "Mutter", 2, "st", 15, 5)]  # no line without the VAT mark
    loose = page(spark, "12345 Skruv 10 st 5,00 50,00", "20001 Mutter 2 st 10,00 25,00 15,00")
    got = [(r.line_number, r.description, r.quantity, r.unit_price, r.amount) for r in extraction.item_lines(loose).orderBy("line_number").collect()]
    assert got == [(1, "Skruv", 10, 5, 50), (2, "Mutter", 2, 10, 15)]
    assert extraction.item_lines(items.limit(0)).count() == 0


def test_page_context(spark):
    rows_ = page(spark, "Hej", "nigirO", None, "12").withColumn("segment_type", F.when(F.col("row_idx") < 2, "header").otherwise("items"))
    assert extraction.page_context(rows_).first().context == "--- HEADER ---\nHej\n--- ITEMS ---\n12"


def test_retry(spark):
    tried = spark.createDataFrame([(1, 0, None, 0.5), (1, 1, "aggressive", 0.96), (1, 2, "conservative", 0.99), (2, 0, None, 0.4), (2, 1, "aggressive", 0.4), (3, 0, None, None)], "invoice_id int, attempt int, strategy string, confidence double")
    got = {r.invoice_id: (r.strategy, r.reached) for r in extraction.retry(tried, 0.95).collect()}
    assert got[1] == ("aggressive", True) and got[2] == (None, False) and not got[3][1]


def test_column_centres(spark):
    middles = np.concatenate([np.full(20, c) for c in (100.0, 325.0, 475.0, 535.0)])
    assert columns.centres_of(middles) == [100.0, 325.0, 475.0, 535.0]
    assert columns.centres_of(np.append(middles, [331.0])) == [100.0, 325.0, 475.0, 535.0]
    assert columns.centres_of(np.array([])) == [] and columns.centres_of(np.array([7.0])) == [7.0]
    assert columns.tukey_bounds(np.array([1.0, 2, 3, 4, 5]), 1.0) == (1.5 - 3, 4.5 + 3)
    t = spark.createDataFrame([("d", 1, float(m) - 5, 10.0) for m in middles] + [("e", 1, None, 1.0)], "doc_id string, page_number int, x double, width double")
    assert {r.doc_id: r.centers for r in columns.detect_columns(t).collect()} == {"d": [100.0, 325.0, 475.0, 535.0], "e": []}


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("raw_confidence,actual_correct\n0.5,Yes\n2,true\nx,1\n0.25,no\n")
    assert [tuple(r) for r in files.read_truth(spark, f"{tmp_path}/t.csv").collect()] == [(0.5, True), (0.25, False)]
    (tmp_path / "t.json").write_text('[{"raw_confidence": 0.5, "actual_correct": true}, {"raw_confidence": 1.5, "actual_correct": false}]')
    with pytest.raises(Exception, match="between 0 and 1"):
        files.read_truth(spark, f"{tmp_path}/t.json").collect()
    (tmp_path / "c.json").write_text('[{"invoice_id": "a", "corrected_total": 5.0}, {"invoice_id": "b", "corrected_total": null}]')
    assert files.read_corrections(spark, f"{tmp_path}/c.json").count() == 2
    export = spark.createDataFrame([("a", "1", "S", 5.0)], "invoice_id string, invoice_number string, supplier_name string, total_amount double").withColumn("at", F.current_timestamp())
    for kind in ("parquet", "csv"):
        files.write_export(export, f"{tmp_path}/{kind}", kind)
        assert files.read_export(spark, f"{tmp_path}/{kind}", kind).count() == 1
    files.write_export(export.select("invoice_id"), f"{tmp_path}/less")
    with pytest.raises(ValueError, match="invoice_number"):
        files.read_export(spark, f"{tmp_path}/less")
    points = spark.createDataFrame([("A/B", None, 0.1, 0.2, 3), (None, "total", 0.5, 0.6, 4)], files.POINTS)
    files.save_models(points, f"{tmp_path}/models")
    assert sorted(map(str, files.load_models(spark, f"{tmp_path}/models").collect())) == sorted(map(str, points.collect()))
    files.write_reports(points, f"{tmp_path}/reports")
    assert spark.read.json(f"{tmp_path}/reports").count() == 2
    files.write_batch_summary(spark.createDataFrame([("b", "OK"), ("a", "FAILED")], "filename string, status string"), f"{tmp_path}/batch")
    assert [r.filename for r in spark.read.option("header", "true").csv(f"{tmp_path}/batch").collect()] == ["a", "b"]
    index = files.index_artifacts(spark, f"{tmp_path}/reports")
    assert index.filter("length(sha256) = 64").count() == index.count() > 0
    assert files.merge_manifests(index, index).count() == index.count()
    (tmp_path / "x.pdf").write_bytes(b"1")
    assert files.scan_documents(spark, str(tmp_path)).count() == 1


def test_streams(spark, tmp_path):
    schema = "invoice_id int, corrected_total double, confidence double, arrival long"
    batch = spark.createDataFrame([(1, 5.0, 0.5, 1), (1, 6.0, 0.9, 2), (1, 7.0, 0.9, 3), (2, 8.0, None, 4)], schema)
    batch.write.parquet(f"{tmp_path}/c")
    arrivals.run_once(arrivals.best_corrections(arrivals.stream_parquet(spark, f"{tmp_path}/c", schema)), "best", "complete", f"{tmp_path}/k1")
    assert sorted(tuple(r)[:2] for r in spark.table("best").collect()) == [(1, 6.0), (2, 8.0)]
    events = spark.createDataFrame([("a", 1.0, "2024-01-01 00:10:00"), ("a", 2.0, "2024-01-01 00:50:00"), ("b", 3.0, "2024-01-01 01:10:00")], "event_type string, value double, t string").select("event_type", "value", F.to_timestamp("t").alias("ts"))
    events.write.parquet(f"{tmp_path}/e")
    arrivals.run_once(arrivals.windowed_counts(arrivals.stream_parquet(spark, f"{tmp_path}/e", "event_type string, value double, ts timestamp")), "counts", "complete", f"{tmp_path}/k2")
    assert sorted((r.event_type, r.n, r.value) for r in spark.table("counts").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]
