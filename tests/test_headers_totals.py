"""Dates, page numbers, totals, line checks, column-mapped lines and diagnostics on small pages."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import diagnostics, extraction, headers, linecheck, mapped_lines, totals


def page(spark, *texts, invoice=1, first_y=20.0):
    rows = [(invoice, i, first_y + 20.0 * i, 800.0, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "invoice_id int, row_idx int, y double, page_height double, text string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Datum 2024-02-29", dt.date(2024, 2, 29)), ("2024.03.05", dt.date(2024, 3, 5)), ("5/3/2024", dt.date(2024, 3, 5)), ("05.03.2024", dt.date(2024, 3, 5)), ("5-3-2024", dt.date(2024, 3, 5)),
        ("24-03-05", dt.date(2005, 3, 24)), ("05.03.24", dt.date(2024, 3, 5)), ("05/03/24", dt.date(2024, 3, 5)), ("31.02.2024", None), ("2023-02-29", dt.date(2029, 2, 23)), ("2023-02-30 5/3/2024", dt.date(2024, 3, 5)),
        ("13/13/2024 01.02.24", dt.date(2024, 2, 1)), ("Sida 1/2", None), ("0000-01-01", None), (None, None), ("", None),
    ],
)
def test_row_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(headers.row_date(F.col("t"))).first()[0] == want


def test_invoice_date_is_the_first_valid_one(spark):
    rows = page(spark, "Sida 1/2", "Fakturadatum 31.02.2024", None, "Förfaller 2024-04-01", "Datum 2024-03-01")
    assert [tuple(r) for r in headers.pick_date(rows).collect()] == [(1, dt.date(2024, 4, 1))]
    assert headers.pick_date(page(spark, "inget")).count() == 0


def test_page_numbers(spark):
    rows = page(spark, "Faktura nr: AB-1234", "Annat", "Fakturanummer", "998877").withColumn("segment_type", F.lit("header"))
    best = headers.page_numbers(rows).first()
    assert best.candidate == "AB-1234" and best.row_idx == 0
    below = headers.page_numbers(page(spark, "Fakturanummer", "998877").withColumn("segment_type", F.lit("items"))).first()
    assert below.candidate == "998877" and below.row_idx == 1
    assert headers.page_numbers(page(spark, "Ordernummer 12345").withColumn("segment_type", F.lit("header"))).count() == 0
    assert spark.range(1).select(headers.boundary_number(F.lit("abc")), headers.boundary_number(F.lit("a-1234")), headers.boundary_number(F.lit("x" * 21))).first() == (False, True, False)


def test_header_marks(spark):
    assert headers.strong_header(page(spark, "Faktura 2024-01-01")).first().strong and not headers.strong_header(page(spark, "Hej hopp")).first().strong
    assert headers.has_total(page(spark, "Att betala 12")).first().has_total and not headers.has_total(page(spark, "Att betala", "12")).first().has_total
    one = headers.header_fields(page(spark, "Bygg AB", "Fakturanummer 1234567", "2024-01-02", "Er referens: Olle")).first()
    assert (one.supplier_name, one.invoice_date, one.invoice_number) == ("Bygg AB", dt.date(2024, 1, 2), "1234567") and one.number_confidence > 0.9
    none = headers.header_fields(page(spark, "1")).first()
    assert none.invoice_number is None and none.number_confidence == 0.0 and not none.number_reached


def sums(spark, total, invoice=1):
    return spark.createDataFrame([(invoice, None if total is None else D(total))], "invoice_id int, lines_sum decimal(18,2)")


def chosen(spark, *texts, total=None, above=None, **options):
    footer = page(spark, *texts, first_y=600.0)
    rows = totals.final_totals(footer, sums(spark, total), above=None if above is None else page(spark, *above), **options).collect()
    return (rows[0].total_amount, rows[0].keyword_type, rows[0].validated) if rows else None


def test_totals_with_vat_win_and_agreeing_ones_among_them(spark):
    assert chosen(spark, "Netto 100,00", "Att betala 125,00", total="100") == (D("125.0000"), "with_vat", False)
    assert chosen(spark, "Totalt inkl. moms 130,00", "Att betala 125,00", total="125") == (D("125.0000"), "with_vat", True)
    assert chosen(spark, "Delsumma 100,00", "Summa 90,00", total="90") == (D("90.0000"), "generic", True)
    assert chosen(spark, "Delsumma 100,00", total="5") == (D("100.0000"), "without_vat", False)
    assert chosen(spark, "Hej", "Tack") is None and chosen(spark, None, "") is None


def test_labels_above_their_amounts(spark):
    assert chosen(spark, "Att betala", "1 250,00", "900,00") == (D("1250.0000"), "with_vat", False)
    assert chosen(spark, "1 250,00", "Moms 250,00", above=["Summa", "Att betala: SEK"]) == (D("1250.0000"), "with_vat", False)
    assert chosen(spark, "1 250,00", above=["Ordernr"]) == (D("1250.0000"), None, False)


def test_label_kinds(spark):
    got = spark.createDataFrame([(t,) for t in ("SUMMA ATT BETALA", "Netto att betala", "Netto", "exkl. moms", "totalt", "Belopp", "x", None, "inkl moms", "Total moms inkluderad")], "t string").select(totals.label_kind(F.col("t"))).collect()
    assert [r[0] for r in got] == ["with_vat", "with_vat", "without_vat", "without_vat", "generic", "generic", None, None, "with_vat", "with_vat"]


def test_strategies_boosts_and_calibration(spark):
    footer = page(spark, "Att betala 125,00", first_y=600.0)
    s = sums(spark, "125")
    raw = totals.candidates(footer, s).first().score
    by = {k: totals.final_totals(footer, s, strategy=k).first().total_confidence for k in (None, "aggressive", "conservative", "broader_search")}
    for k, boost in ((None, 0.15), ("aggressive", 0.20), ("conservative", 0.10), ("broader_search", 0.15)):
        assert by[k] == pytest.approx(min(1.0, raw + boost))
    matches = spark.createDataFrame([(1, 1, 7, 0.9), (1, 2, 8, 0.6)], "invoice_id int, rank int, pattern_id long, similarity double")
    patterns = spark.createDataFrame([(7, 0.05, 3), (8, 0.5, 1)], "pattern_id long, confidence_boost double, usage_count int").withColumn("last_used", F.lit(None).cast("timestamp"))
    small = page(spark, "x 10,00", first_y=100.0)
    plain, more = (totals.final_totals(small, sums(spark, None), **o).first().total_confidence for o in ({}, {"matches": matches, "patterns": patterns}))
    assert more == pytest.approx(plain + 0.05)
    after = {r.pattern_id: r for r in totals.used(patterns, matches, F.current_timestamp()).collect()}
    assert after[7].usage_count == 4 and after[7].last_used and after[8].usage_count == 1 and not after[8].last_used
    fit = spark.createDataFrame([(0.0, 0.0), (1.0, 0.5)], "x double, fit double")
    assert totals.final_totals(small, sums(spark, None), fit=fit).first().total_confidence == pytest.approx(plain / 2)


def test_second_pass_and_best_attempt(spark):
    weak = totals.retried_totals(page(spark, "Delsumma 100,00", first_y=100.0), sums(spark, "5")).first()
    assert not weak.reached and weak.strategy == "aggressive"  # its penalty is the least
    strong = totals.retried_totals(page(spark, "Att betala 100,00", first_y=600.0), sums(spark, "100")).first()
    assert strong.reached and strong.strategy == "standard"


def test_font_raises_a_larger_row(spark):
    footer = page(spark, "Att betala 100,00", "Summa 100,00", first_y=600.0).withColumn("font_size", F.when(F.col("row_idx") == 0, 14.0).otherwise(9.0))
    with_font = {r.row_idx: r.score for r in extraction.score_totals(footer, sums(spark, None)).collect()}
    without = {r.row_idx: r.score for r in extraction.score_totals(footer.drop("font_size"), sums(spark, None)).collect()}
    assert with_font[0] - without[0] == pytest.approx(0.05) and with_font[1] == pytest.approx(without[1])


def test_line_checks(spark):
    rows = [
        (1, 1, "10", "5", None, "50"), (1, 2, "10", "5", "0.10", "45"), (1, 3, "10", "5", "5", "45"), (1, 4, "10", "5", "-5", "45.50"), (1, 5, "10", "5", None, "80"), (1, 6, "10", None, None, "55"),
        (1, 7, None, "5", None, "50"), (1, 8, None, None, None, "50"), (1, 9, "1", "1", None, "0"), (1, 10, "10", "5", "0.10", "20"), (1, 11, "1", "100", "3000", "70"), (1, 12, None, "3", None, "50"),
    ]
    df = spark.createDataFrame([(a, b, *(None if v is None else D(v) for v in rest)) for a, b, *rest in rows], "invoice_id int, line_number int, quantity decimal(18,4), unit_price decimal(18,4), discount decimal(18,4), line_total decimal(18,2)")
    got = {r.line_number: r for r in linecheck.line_warnings(linecheck.check_lines(df)).collect()}
    conf = {k: round(r.confidence, 2) for k, r in got.items()}
    assert conf == {1: 0.9, 2: 1.0, 3: 1.0, 4: 0.8, 5: 0.6, 6: 0.65, 7: 0.65, 8: 0.4, 9: 0.0, 10: 0.7, 11: 0.7, 12: 0.65}
    assert [got[i].discount_type for i in (1, 2, 3, 4, 11)] == [None, "percent", "amount", "amount", "percent"]
    assert got[5].suggested.unit_price == 8 and got[5].suggested.quantity == 16 and got[10].suggested.discount == D("0.6") and got[10].suggested.discount_type == "percent"
    assert got[6].warnings == ["A-pris saknas, beräknat: 5.50 SEK"] and got[7].warnings == ["Antal saknas, beräknat: 10"] and got[12].warnings == ["Antal saknas, beräknat: 16.6667"]
    assert got[9].warnings == ["total_amount <= 0 (invalid line)"] and got[8].warnings == ["Antal och a-pris saknas - kan inte validera mot summa"]
    assert got[4].messages == ["Rad 4: Liten avvikelse: förväntat 45.00, faktiskt 45.50 (diff: 0.50 SEK)", "Rad 4: Rabatt är negativ: -5.0000", "Rad 4: Rabatt identifierad som belopp (-5.00 SEK)"]
    assert got[5].messages[-1] == "Rad 5: Beräknade värden - Föreslaget a-pris: 8.00 SEK, Föreslaget antal: 16"
    assert got[1].fields_ok and got[4].fields_ok and not got[5].fields_ok and got[11].expected_total == -2900


def test_invoice_messages(spark):
    h = spark.createDataFrame([(1, D("50"), 0.99, 0.99), (2, D("90"), 0.99, 0.99), (3, None, 0.99, 0.99), (4, D("1"), 0.5, 0.99), (5, D("1"), 0.99, 0.99)], "invoice_id int, header_total decimal(18,2), number_confidence double, total_confidence double")
    lines = spark.createDataFrame([(i, 1, D("10"), D("5"), None, D("50")) for i in (1, 2, 3, 4)], "invoice_id int, line_number int, quantity decimal(18,4), unit_price decimal(18,4), discount decimal(18,4), line_total decimal(18,2)")
    got = {r.invoice_id: (r.status, r.errors, r.warnings) for r in linecheck.invoice_messages(h, lines).collect()}
    assert got[1] == ("OK", [], []) and got[2] == ("PARTIAL", [], ["Sum mismatch: diff=40.00 SEK (tolerance: ±1.0 SEK)"])
    assert got[3][:2] == ("REVIEW", ["Total amount not extracted (confidence < 0.95)"]) and got[4][1] == ["Hard gate failed: invoice_number_confidence=0.50, total_confidence=0.99"]
    assert got[5][1] == ["No invoice lines extracted (cannot validate)"]


def test_net_and_gross(spark):
    df = spark.createDataFrame([(D("100"), D("100.50"), D("125.51")), (D("100"), D("100.51"), D("125.50")), (D("100"), None, None)], "lines_sum decimal(28,2), stated_net decimal(28,2), stated_gross decimal(28,2)")
    got = [(r.net_ok, r.gross_ok, r.vat) for r in linecheck.gross_check(linecheck.net_check(df)).collect()]
    assert got == [(True, False, 25), (False, True, 25), (False, False, 25)]


HEAD = ("Artikelnr", "Benämning", "Antal", "Enhet", "Á-pris", "Nettobelopp")
AT = (50.0, 150.0, 300.0, 360.0, 420.0, 520.0)


def table(spark, lines, invoice=1):
    """Rows and tokens of a table: each line is a list of (text, x) or of texts at the columns' places."""
    toks, rows = [], []
    for i, line in enumerate(lines):
        placed = [(t, x) if isinstance(t, str) else t for t, x in zip(line, AT, strict=False)] if not isinstance(line[0], tuple) else line
        words = [(w, x + 30.0 * j) for t, x in placed if t for j, w in enumerate(t.split())]
        toks += [(invoice, i, j, w, x, 25.0, 612.0) for j, (w, x) in enumerate(words)]
        rows.append((invoice, i, " ".join(w for w, _ in words), 100.0 + 20.0 * i, min(x for _, x in words), 10.0, 612.0))
    return (
        spark.createDataFrame(rows, "invoice_id int, row_idx int, text string, y double, x_min double, height double, page_width double"),
        spark.createDataFrame(toks, "invoice_id int, row_idx int, token_idx int, text string, x double, width double, page_width double"),
    )


def test_header_words_map_columns(spark):
    head = spark.createDataFrame([(1, i, float(i), i, w) for i, w in enumerate(HEAD)], "invoice_id int, column int, x double, token_idx int, text string")
    got = {r.field: r["column"] for r in mapped_lines.map_columns(head).collect()}
    assert got == {"article_no": 0, "description": 1, "quantity": 2, "unit": 3, "unit_price": 4, "netto": 5}
    shared = spark.createDataFrame([(1, 0, 0.0, 0, "Artikelnr"), (1, 0, 1.0, 1, "Beskrivning")], "invoice_id int, column int, x double, token_idx int, text string")
    assert {r.field: r["column"] for r in mapped_lines.map_columns(shared).collect()} == {"article_no": 0, "description": 0}
    score = spark.range(1).select(mapped_lines.field_score(F.lit("artikelnr"), ("artikelnr", "art", "sku"))).first()[0]
    assert score == pytest.approx(1.9 + 1.3)


def test_lines_by_position(spark):
    body = [[f"Vara{i}x", f"Stor skruv {chr(97 + i)}", str(i + 1), "st", f"{i + 2},50", ""] for i in range(6)]
    lines = [list(HEAD)] + [[*b[:5], f"25,00 {(i + 1) * 10},00"] for i, b in enumerate(body)]
    rows, toks = table(spark, lines)
    got = mapped_lines.mapped_lines(rows, toks, own_header=True).orderBy("line_number").collect()
    assert [(r.line_number, r.quantity, r.unit, r.unit_price, r.amount, r.vat_rate) for r in got] == [(i + 1, i + 1, "st", D(f"{i + 2}.5"), (i + 1) * 10, D("0.25")) for i in range(6)]
    plain = mapped_lines.mapped_lines(rows, toks).orderBy("line_number").collect()  # no header inside the table: by words
    assert [r.amount for r in plain] == [r.amount for r in got] and [r.quantity for r in plain] == [i + 1 for i in range(6)]
    assert mapped_lines.mapped_lines(rows.limit(0), toks.limit(0)).count() == 0


def test_wraps_footers_and_odd_rows(spark):
    lines = [[("12345", 50.0), ("Skruv", 150.0), ("2", 300.0), ("kg", 360.0), ("100,00", 520.0)], [("av", 52.0), ("stål", 152.0)], [("Rad", 50.0), ("Bult", 150.0), ("200,00", 520.0)], [("Summa", 50.0), ("att", 80.0), ("betala", 110.0), ("300,00", 520.0)], [("Text", 300.0)]]
    rows, toks = table(spark, lines)
    got = mapped_lines.mapped_lines(rows, toks).orderBy("line_number").collect()
    assert [(r.description, r.quantity, r.unit, r.amount) for r in got] == [("12345 Skruv 2 kg 100,00 av stål", 2, "kg", 100), ("Bult", None, None, 200)]


def test_positions_replace_a_reading_that_misses_the_net(spark):
    lines = [[("12345", 50.0), ("Skruv", 150.0), ("10,00", 520.0)], [("12346", 50.0), ("Bult", 150.0), ("20,00", 520.0)]]
    rows, toks = table(spark, lines)
    stated = lambda n, g=None: spark.createDataFrame([(1, D(n), None if g is None else D(g))], "invoice_id int, stated_net decimal(18,2), stated_gross decimal(18,2)")
    modes = lambda s: {r.mode for r in mapped_lines.read_lines(rows, toks, s).collect()}
    assert modes(stated("30")) == {"text"} and modes(stated("30", "99")) == {"pos"} and modes(stated("99")) == {"text"}
    assert {r.mode for r in mapped_lines.read_lines(rows, toks, stated("30"), mode="pos").collect()} == {"pos"}
    with pytest.raises(ValueError, match="mode"):
        mapped_lines.read_lines(rows, toks, stated("30"), mode="x")


def test_diagnostics(spark):
    rows = [
        ("1", "123456 Skruv", D("123456"), "ea", D("1"), D("123456"), None), ("1", "Mutter 2 108 ea", D("8"), "EA", D("10"), D("21080"), None), ("2", "Bult", D("2"), "day", D("5"), D("10"), None), ("2", "Bult", D("2"), "st", D("5"), D("100"), None),
        ("3", "1 234,50 Virke", D("1"), "ltr", D("5"), D("1500"), D("0.1")), ("3", "Rör", D("2"), "xpa", D("50"), D("150"), D("0.1")), ("3", "Rör", D("2"), "xpa", D("50"), D("150"), None), ("4", None, None, None, None, None, None), ("5", "1500 spik", D("1500"), "ea", D("1"), D("1500"), None),
    ]
    df = spark.createDataFrame(rows, "invoice_number string, description string, quantity decimal(18,4), unit string, unit_price decimal(18,4), line_total decimal(18,2), discount decimal(18,4)")
    assert diagnostics.unit_rows(df).count() == 7
    flagged = {(r.description, r.discount): r.problems for r in diagnostics.flagged_units(df).collect()}
    assert flagged["123456 Skruv", None] == [diagnostics.ARTICLE, diagnostics.LARGE] and flagged["Bult", None] == [] and flagged["1500 spik", None] == [diagnostics.LARGE]
    assert {r.sound: r.n for r in diagnostics.unit_summary(df).collect()} == {True: 1, False: 6}
    assert {r.description for r in diagnostics.underpriced(df).collect()} == {"Mutter 2 108 ea", "1 234,50 Virke"}
    assert {r.description: r.quantities for r in diagnostics.spaced_quantities(df).collect()} == {"Mutter 2 108 ea": [2108], "1 234,50 Virke": []}
    counts = {r.category: r.n for r in diagnostics.problem_counts(df).collect()}
    assert counts == {"artikelnummer_i_antal": 2, "unit_price_for_liten": 1, "tusen_separator_problem": 2, "komplexa_rabatter": 1, "unit_price_stämmer_inte": 2}
    assert [r.description for r in diagnostics.fix_check(df).collect()] == ["123456 Skruv"]
    assert diagnostics.unit_summary(df.limit(0)).filter("percent <> 0").count() == 0
