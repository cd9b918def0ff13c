"""Validators, stores, run artifacts, engines, composition, calibration by segment and entry points."""

import datetime as dt
import json
import math
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerline import api
from ledgerline.operators import calibration, compose, constraints, layout, learning, routing
from ledgerline.operators.analytics import QueryIntent
from ledgerline.sources import engines, files, runs, store

NOW = "timestamp'2024-05-01 00:00:00'"


# --- validators ---


def test_rules_route_and_strict_mode_fails(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "i int, number_confidence double").withColumn("total_confidence", F.lit(1.0))
    assert {r.i: r.broken for r in constraints.rejects(df, constraints.HEADER).collect()} == {2: ["number_confidence"], 3: ["number_confidence"]}
    assert [r.i for r in constraints.accepted(df, constraints.HEADER).collect()] == [1]
    assert constraints.strict(df.limit(1), constraints.HEADER).count() == 1
    with pytest.raises(Exception, match="number_confidence"):
        constraints.strict(df, constraints.HEADER).collect()
    assert constraints.rejects(df.limit(0), constraints.HEADER).count() == 0


def test_replies(spark):
    texts = ['{"total_amount": 5, "confidence": 0.9, "reasoning": "x", "validation_passed": true}', "```json\n{\"total_amount\": 7.5, \"confidence\": 1, \"validation_passed\": false}\n```", "summan är 1 234,50 kr", "vet ej", None, ""]
    got = [r[0] and (r[0].total_amount, r[0].confidence, r[0].validation_passed) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(constraints.parse_reply(F.col("t"))).collect()]
    assert got == [(5.0, 0.9, True), (7.5, 1.0, False), (234.5, 0.7, False), None, None, None]


def test_raw_text(spark):
    h = spark.createDataFrame([(1, None), (2, ""), (3, "own")], "invoice_id int, raw_text string")
    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c"), (3, 0, "d")], "invoice_id int, row_idx int, text string")
    assert {r.invoice_id: r.raw_text for r in constraints.with_raw_text(h, rows).collect()} == {1: "a b", 2: "c", 3: "own"}


# --- stores ---


def patterns(spark):
    rows = [(1, "a", "h", 10.0, 10.0, 100.0, 3, "2024-04-30"), (2, "a", "h", 12.0, 10.0, 100.0, 1, "2024-04-30"), (3, "a", "h", 400.0, 10.0, 5.0, 1, "2020-01-01"), (4, "b", "h", None, None, 5.0, 1, "2024-04-30")]
    return spark.createDataFrame(rows, "pattern_id long, supplier_name string, layout_hash string, position_x double, position_y double, correct_total double, usage_count int, t string").withColumn("last_used", F.to_timestamp("t")).withColumn("confidence_boost", F.lit(0.1)).drop("t")


def test_pattern_store(spark, tmp_path):
    path = f"{tmp_path}/patterns"
    known = store.create(spark, path, store.PATTERN)
    assert known.count() == 0 and store.create(spark, path, store.PATTERN).count() == 0
    made = store.new_patterns(patterns(spark).drop("pattern_id", "confidence_boost"), known, F.expr(NOW))
    store.add(made, path)
    back = spark.read.schema(store.PATTERN).parquet(path)
    assert back.count() == 4 == back.select("pattern_id").distinct().count() and {r.confidence_boost for r in back.collect()} == {0.1} and back.filter("created_at is null").count() == 0
    with pytest.raises(ValueError, match="correct_total"):
        store.new_patterns(patterns(spark).drop("correct_total"), known, F.expr(NOW))
    assert [r.pattern_id for r in store.patterns_of(patterns(spark), "a").collect()] == [1, 2, 3]
    changed = {r.pattern_id: r for r in store.update_patterns(patterns(spark), F.col("pattern_id") == 2, {"usage_count": F.lit(7), "supplier_name": F.lit("z")}).collect()}
    assert changed[2].usage_count == 7 and changed[2].supplier_name == "a" and changed[1].usage_count == 3
    kept = {r.pattern_id: r.usage_count for r in store.maintain(patterns(spark), F.expr(NOW)).collect()}
    assert kept == {1: 4, 4: 1}  # 2 joins 1, 3 is old
    store.replace(store.maintain(patterns(spark), F.expr(NOW)), path)
    assert spark.read.parquet(path).count() == 2
    assert store.clear(back).count() == 0 and store.append(patterns(spark), patterns(spark).drop("confidence_boost")).count() == 8


def test_consolidation_against_a_plain_loop(spark):
    import random

    r = random.Random(3)
    rows = [(i, "s", "h", round(r.uniform(0, 300), 3), round(r.uniform(0, 300), 3), r.randint(0, 4), r.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "pattern_id long, supplier_name string, layout_hash string, position_x double, position_y double, usage_count int, day int").withColumn("last_used", F.expr("timestamp'2024-01-01' + make_dt_interval(day)"))
    leaders, want = [], {}
    for i, *_, x, y, u, day in sorted(rows, key=lambda t: (-t[5], -t[6], t[0])):
        near = next((j for j, a, b in leaders if math.dist((a, b), (x, y)) <= 50), None)
        if near is None:
            leaders.append((i, x, y))
            near = i
        n, total = want.get(near, (0, 0))
        want[near] = (n + 1, total + u)
    assert {q.pattern_id: (q.merged, q.usage_count) for q in learning.consolidate(df).collect()} == want


def test_similar_patterns_against_a_plain_search(spark):
    import random

    r = random.Random(4)
    place = lambda: (None, None) if r.random() < 0.2 else (float(r.randint(0, 20)) * 10, float(r.randint(0, 20)) * 10)
    p = [(i, r.choice("ab"), r.choice("hk"), *place()) for i in range(150)]
    q = [(i, r.choice("abc"), r.choice("hk"), *place()) for i in range(60)]
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} long, supplier_name string, layout_hash string, position_x double, position_y double")
    got = {}
    for x in learning.match_patterns(df(q, "invoice_id"), df(p, "pattern_id")).collect():
        got.setdefault(x.invoice_id, {})[x["rank"]] = (x.pattern_id, round(x.similarity, 9))

    def similar(a, b):
        none = (a[3] is None) + (b[3] is None)
        return 0.5 * (a[2] == b[2]) + (0.25 if none == 2 else 0.0 if none else 0.5 / (math.dist(a[3:], b[3:]) / 100 + 1))

    for a in q:
        near = sorted((-round(similar(a, b), 12), b[0]) for b in p if b[1] == a[1] and similar(a, b) >= 0.5)[:3]
        assert got.get(a[0], {}) == {k: (i, round(-s, 9)) for k, (s, i) in enumerate(near, 1)}
    with pytest.raises(ValueError, match="threshold"):
        learning.match_patterns(df(q, "invoice_id"), df(p, "pattern_id"), threshold=0.4)


def test_corrections(spark, tmp_path):
    for name, rows in (("b", [{"invoice_id": "1", "corrected_total": 5.0, "timestamp": "2024-01-02"}, {"invoice_id": "1", "corrected_total": 6.0}]), ("a", [{"supplier_name": "S", "corrected_total": 7.0}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    read = files.read_corrections(spark, f"{tmp_path}/*.json")
    assert [r.corrected_total for r in read.orderBy("arrival").collect()] == [7.0, 5.0, 6.0]
    got = {r.corrected_total: r for r in store.import_corrections(spark, f"{tmp_path}/*.json", F.lit("now")).collect()}
    assert got[7.0].invoice_id == "" and got[7.0].timestamp == "now" and got[5.0].supplier_name == "Unknown" and got[6.0].correction_type == "total_amount"
    n = api.import_corrections(spark, f"{tmp_path}/*.json", f"{tmp_path}/store", f"{tmp_path}/pats")
    assert n == 3 and spark.read.parquet(f"{tmp_path}/store").count() == 3 == spark.read.parquet(f"{tmp_path}/pats").count()
    assert api.maintain_patterns(spark, f"{tmp_path}/pats") == (3, 2)  # two totals of one supplier without a place conflict
    inv = spark.createDataFrame([(1, "", 5.0, 0.5, [(5.0, 0.5), (6.0, None)])], "invoice_id int, supplier_name string, total_amount double, total_confidence double, candidates array<struct<amount:double,score:double>>")
    pick = lambda i: store.correction(inv, spark.createDataFrame([(1, i, None)], "invoice_id int, candidate_index int, raw_confidence double"), F.lit("t")).collect()
    assert pick(1)[0].corrected_total == 6.0 and pick(1)[0].corrected_confidence == 0.0 and pick(1)[0].supplier_name == "Unknown" and pick(5) == []


def test_invoices_of_export_rows(spark):
    rows = spark.createDataFrame([("x", "1", "S", 2, 5.0), ("x", "1", "T", 1, 6.0), (None, "2", "U", 1, 7.0), ("", "2", "U", 2, 8.0)], "invoice_id string, invoice_number string, supplier_name string, line_number int, line_total double")
    got = {r.invoice_key: (r.supplier_name, r.n_lines, [x.line_total for x in r.lines]) for r in store.load_invoices(rows).collect()}
    assert got == {"x": ("T", 2, [6.0, 5.0]), "2": ("U", 2, [7.0, 8.0])}


# --- run artifacts ---


def test_summary_and_manifest(spark, tmp_path):
    folder = f"{tmp_path}/run/run"  # the folder's name repeats on purpose
    inv = spark.createDataFrame([(1, "OK"), (1, "REVIEW"), (2, "FAILED")], "file_id int, status string")
    summary = runs.RunSummary("r1", "in", folder, "t0", pipeline_version="1.2.0", durations={"a": float("nan"), "b": D("1.5")})
    summary.count(inv).complete("t1").save(spark, f"{folder}/run_summary.json")
    summary.save(spark, f"{folder}/run_summary.json")
    got = json.loads(runs.read_text(spark, f"{folder}/run_summary.json"))
    assert (got["ok_count"], got["review_count"], got["failed_count"], got["total_files"], got["status"], got["durations"]) == (1, 1, 1, 2, "COMPLETED", {"a": 0.0, "b": 1.5})
    entries = runs.manifest_of(spark, folder)
    assert [(r.filename, r.artifact_type, r.relative_path) for r in entries.collect()] == [("run_summary.json", "summary", "run_summary.json")]
    runs.save_manifest(entries, f"{tmp_path}/manifest", run_id="r1", created_at="t")
    assert runs.load_manifest(spark, f"{tmp_path}/manifest").first().manifest_version == "1.0"
    assert runs.check_artifacts(spark, folder, "1.2.3") == {"run_summary": "WARNING"} == runs.check_artifacts(spark, f"{folder}/sub", "1.2.3")
    runs.write_text(spark, '{"manifest_version": "3"}', f"{folder}/artifact_manifest.json")
    runs.write_text(spark, "not json", f"{folder}/run_summary.json")
    assert runs.check_artifacts(spark, folder, "1.2.3") == {"run_summary": "UNKNOWN", "artifact_manifest": "WARNING"}
    assert runs.json_safe({1: {float("inf"), 2}, "d": dt.date(2024, 1, 2)}) in ({"1": [0.0, 2], "d": "2024-01-02"}, {"1": [2, 0.0], "d": "2024-01-02"})


def test_reports_and_dumps(spark, tmp_path):
    checked = spark.createDataFrame([(1, "7", 0.9, 5.0, 0.8, "S", dt.date(2024, 1, 2), "REVIEW", 4.0, 1.0, ["e"], ["w"], 2), (2, None, float("nan"), None, 0.8, None, None, "REVIEW", 4.0, None, [], [], 0)], "invoice_id int, invoice_number string, number_confidence double, header_total double, total_confidence double, supplier_name string, invoice_date date, status string, lines_sum double, diff double, errors array<string>, warnings array<string>, n_lines int")
    traces = spark.createDataFrame([(1, "total", "5.0", 0.8, '{"page_number":1,"bbox":[1,2,3,4],"row_index":0,"text_excerpt":"x","tokens":[]}')], "invoice_id int, field string, value string, confidence double, evidence string")
    got = {r.invoice_id: json.loads(r.report) for r in runs.review_reports(checked, traces).collect()}
    assert got[1]["invoice_header"]["total_traceability"]["evidence"]["bbox"] == [1, 2, 3, 4] and got[1]["validation"]["errors"] == ["e"] and got[1]["invoice_header"]["invoice_date"] == "2024-01-02"
    assert got[2]["invoice_header"]["invoice_number_confidence"] is None and got[2]["invoice_header"]["total_amount"] is None
    runs.write_review_package(runs.review_reports(checked), f"{tmp_path}/review")
    assert spark.read.text(f"{tmp_path}/review/invoice=1").count() == 1
    rows = spark.createDataFrame([(1, "a")], "invoice_id int, text string")
    runs.write_table_dump(f"{tmp_path}/dump", rows, rows, rows, rows)
    assert spark.read.json(f"{tmp_path}/dump/parsed_lines/invoice=1").first().text == "a"


def test_profiles(spark, tmp_path):
    folder = str(tmp_path)
    assert runs.list_profiles(spark, folder) == ["default"] == runs.list_profiles(spark, f"{folder}/none")
    (tmp_path / "b.json").write_text('{"name": "b", "table_parser_mode": "pos", "ocr_routing": {"min_chars": 9, "required": ["x"], "odd": 1}, "odd": 1}')
    (tmp_path / "a.json").write_text("{}")
    assert runs.list_profiles(spark, folder) == ["a", "b"]
    made = runs.load_profile(spark, folder, "b")
    assert made["table_parser_mode"] == "pos" and made["footer"] == {} and "odd" not in made
    config = routing.overlaid(routing.RoutingConfig(), made["ocr_routing"])
    assert config.min_chars == 9 and config.required == ("x",) and config.min_words == 40
    assert routing.policy_of({"allow_ai_for_edi": True, "x": 1}) == routing.POLICY | {"allow_ai_for_edi": True} and routing.policy_of(None) == routing.POLICY
    for name, error in (("none", FileNotFoundError), ("a", ValueError)):
        with pytest.raises(error):
            runs.load_profile(spark, folder, name)


# --- engines ---


def test_engines(spark, tmp_path):
    class Lines(engines.TextLayer):
        def pages(self, content):
            if content.startswith(b"bad"):
                raise OSError("broken")
            return iter([(600.0, 800.0)] * content.count(b"\f"))

        def tokens(self, content, page):
            words = content.decode().split("\f")[page - 1].split(" ")
            return iter([{"text": w, "x": 10.0 * i, "y": 5.0, "width": 8.0 if w != "thin" else 0.0, "height": 9.0} for i, w in enumerate(words)])

    class Eyes(engines.Recogniser):
        def render(self, content, page, dpi):
            return f"{dpi}|{content.decode().split(chr(12))[page - 1]}".encode()

        def words(self, picture):
            dpi, _, text = picture.decode().partition("|")
            sure = 90.0 if int(dpi) > 300 or "clear" in text else 20.0
            return 1200.0, 1600.0, iter([{"text": w, "x": 100.0 * (9 - i), "y": 10.0, "width": 50.0, "height": 20.0, "confidence": sure if w != "noise" else -1} for i, w in enumerate(text.split())])

    class Asked(engines.Enricher):
        def ask(self, text, lines_sum, strict):
            if text == "fail":
                raise OSError
            return f'{{"total_amount": {lines_sum}}}' if strict else "say"

    (tmp_path / "a.pdf").write_bytes(b"one thin two\fclear  noise three\f")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.pdf").write_bytes(b"bad")
    (tmp_path / "c.pdf").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    docs = engines.documents(spark, str(tmp_path))
    pages = engines.read_pages(docs, Lines())
    name = lambda p: p.rsplit("/", 1)[1]
    assert sorted((name(r.path), r.page_number, r.error) for r in pages.collect()) == [("a.pdf", 1, None), ("a.pdf", 2, None), ("b.pdf", None, "OSError: broken"), ("c.pdf", None, "no pages")]
    text = engines.scan_text(docs, pages, Lines())
    assert sorted((r.page_number, r.token_idx, r.text) for r in text.collect()) == [(1, 0, "one"), (1, 1, "two"), (2, 0, "clear"), (2, 1, "noise"), (2, 2, "three")]
    seen = engines.scan_twice(docs, pages, Eyes())
    assert sorted((r.page_number, r.text, r.confidence, r.x) for r in seen.collect()) == [(1, "one", 90.0, 450.0), (1, "thin", 90.0, 400.0), (1, "two", 90.0, 350.0), (2, "clear", 90.0, 450.0), (2, "three", 90.0, 350.0)]
    quality = {r.page_number: r.quality for r in engines.scan_quality(seen).collect()}
    plain = {r.page_number: r.quality for r in engines.scan_quality(text).collect()}
    assert set(quality) == {1, 2} and all(0 < q <= 1 for q in [*quality.values(), *plain.values()])
    asked = spark.createDataFrame([(1, "x", 5.0), (2, "fail", None), (3, None, None)], "invoice_id int, text string, lines_sum double")
    assert {r.invoice_id: r.reply for r in engines.enrich(asked, Asked()).collect()} == {1: '{"total_amount": 5.0}', 2: None, 3: '{"total_amount": None}'}


# --- composition ---


def invoice_tokens(doc, page, number, lines, total, page_no=None):
    rows = [(20.0, [("Bygg", 50.0), ("AB", 80.0)]), (40.0, [("Fakturanummer", 50.0), (number, 150.0)]), (60.0, [("Datum", 50.0), ("2024-03-05", 120.0)])] if number else [(20.0, [("forts.", 50.0)])]
    if page_no:
        rows.append((80.0, [("Sida", 400.0), (page_no, 430.0)]))
    rows += [(300.0 + 20 * i, [(f"{10000 + i}", 50.0), ("Skruv", 150.0), (str(q), 300.0), ("st", 330.0), (p, 400.0), (t, 520.0)]) for i, (q, p, t) in enumerate(lines)]
    if total:
        rows += [(700.0, [("Att", 400.0), ("betala", 420.0), (total, 520.0), ("kr", 570.0)])]
    words = [(w, x, y) for y, ws in rows for w, x in ws]
    return [(doc, page, i, w, x, y, 25.0, 10.0, 600.0, 800.0) for i, (w, x, y) in enumerate(words)]


def test_tokens_to_checked_invoices(spark, tmp_path):
    toks = invoice_tokens("d", 1, "1234567", [(2, "5,00", "10,00"), (3, "4,00", "12,00")], None, "1/2") + invoice_tokens("d", 2, None, [(1, "8,00", "8,00")], "30,00", "2/2") + invoice_tokens("d", 3, "7654321", [(1, "9,00", "9,00")], "99,00", "1/1") + [("e", 1, 0, "tom", 10.0, 10.0, 5.0, 5.0, 600.0, 800.0)]
    df = spark.createDataFrame(toks, "doc_id string, page_number int, token_idx int, text string, x double, y double, width double, height double, page_width double, page_height double")
    done = compose.process(df, keep=files.keeper(f"{tmp_path}/a"))
    got = {r.invoice_id: r for r in done["invoices"].collect()}
    assert set(got) == {"d__1", "d__2", "e__1"}
    a, b, e = got["d__1"], got["d__2"], got["e__1"]
    assert (a.page_start, a.page_end, a.invoice_number, a.supplier_name, a.invoice_date, a.header_total, a.lines_sum, a.n_lines) == (1, 2, "1234567", "Bygg AB", dt.date(2024, 3, 5), 30, 30, 3)
    assert (a.status, b.status, e.status) == ("OK", "REVIEW", "REVIEW") and b.errors[0].startswith("Hard gate failed") and b.diff == 90 and e.header_total is None
    lines = sorted((r.invoice_id, r.line_number, r.quantity, r.line_total) for r in done["lines"].collect())
    assert lines == [("d__1", 1, 2, 10), ("d__1", 2, 3, 12), ("d__1", 3, 1, 8), ("d__2", 1, 1, 9)]
    assert {r.invoice_id: r.chosen for r in compose.better_of(done["invoices"], done["invoices"].filter("invoice_id <> 'd__2'").withColumn("total_confidence", F.lit(1.0))).collect()}["d__2"] == "a"
    routes = spark.createDataFrame([("d", 1, True), ("d", 2, False)], "doc_id string, page_number int, use_text_layer boolean")
    scanned = df.withColumn("text", F.lit("s"))
    assert {(r.page_number, r.text == "s") for r in compose.by_route(df, scanned, routes).collect()} == {(1, False), (2, True)}
    assert compose.process(df.limit(0), keep=files.keeper(f"{tmp_path}/b"))["invoices"].count() == 0


def test_row_heights_set_the_gap(spark):
    rows = spark.createDataFrame([("d", 1, i, 20.0 * i, 0.0, h) for i, h in enumerate((5.0, 5.0, None, 5.0))], "doc_id string, page_number int, row_idx int, y double, x_min double, height double")
    assert layout.gap_threshold(rows).first().gap_threshold == 22.5 and layout.gap_threshold(rows.drop("height")).first().gap_threshold == 12.0


def test_columns_by_list_and_by_array_agree(spark):
    import random

    r = random.Random(1)
    toks = spark.createDataFrame([(r.uniform(-50, 700), r.choice((0.0, 10.0, 300.0))) for _ in range(300)], "x double, width double").withColumn("page_width", F.lit(612.0))
    for centers in ([100.0, 250.0, 500.0], [300.0]):
        a = layout.assign_columns(toks, centers)
        b = layout.assign_columns(a.withColumnRenamed("column", "a").withColumn("centers", F.array(*[F.lit(c) for c in centers])))
        assert b.filter("a <> column or column is null").count() == 0


# --- calibration ---


def test_segments_train_and_apply(spark):
    rows = [(i % 100 / 100, i % 100 >= 50, "s", "total") for i in range(240)] + [(i % 10 / 10, True, "t", "no") for i in range(60)] + [(None, True, "s", "total"), (2.0, True, "s", None)]
    truth = spark.createDataFrame(rows, "raw_confidence double, actual_correct boolean, supplier string, field string")
    models = calibration.train(truth)
    segments = {(r.supplier, r.field) for r in models.select("supplier", "field").distinct().collect()}
    assert segments == {("s", "total"), ("s", "*"), ("*", "total"), ("*", "*")}
    asked = spark.createDataFrame([(0.2, "s", "total"), (0.9, "s", "x"), (0.5, "t", "no"), (1.7, None, None)], "raw_confidence double, supplier string, field string")
    got = [(r.model, r.calibrated) for r in calibration.calibrate(asked, models).orderBy("raw_confidence").collect()]
    assert [m for m, _ in got] == ["s/total", "*/*", "s/*", "*/*"] and got[0][1] == 0.0 and got[2][1] == 1.0
    assert {r.calibrated for r in calibration.calibrate(asked, models.limit(0)).collect()} == {0.2, 0.9, 0.5, 1.0}
    again = calibration.register(models, models.filter("supplier = 's' and field = 'total'").withColumn("fit", F.lit(0.5)))
    assert calibration.calibrate(asked.limit(1), again).first().calibrated == 0.5 and again.count() == models.count()
    assert calibration.train(truth.limit(0)).count() == 0


def test_interpolation_by_halves(spark):
    points = [(i / 50, (i / 50) ** 2) for i in range(51)]
    curve = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("fit")) for x, y in points])
    import numpy as np

    xs = [0.0, 0.01, 0.02, 0.5, 0.333, 0.999, 1.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(calibration.interpolate(F.col("x"), curve)).collect()]
    assert got == pytest.approx(np.interp(xs, *zip(*points, strict=True)))


# --- entry points ---


def test_texts(spark, tmp_path):
    inv = spark.createDataFrame([("1", "S AB", dt.date(2024, 1, 2), D("10.50"), "OK"), ("2", None, None, None, "REVIEW")], "invoice_number string, supplier_name string, invoice_date date, total_amount decimal(18,2), status string")
    assert api.ask(inv, "visa fakturor").splitlines() == ["Hittade 2 fakturor:", "", "  • 1 - S AB (2024-01-02)", "    Totalsumma: 10.50 SEK, Status: OK", "  • 2 - N/A (N/A)", "    Totalsumma: 0.00 SEK, Status: REVIEW"]
    assert "  Totalsumma: 10.50 SEK" in api.ask(inv, "totalsumma") and "Antal leverantörer: 1" in api.ask(inv, "ge en översikt")
    assert "    S AB:" in api.ask(inv, "jämför leverantör") and api.ask(inv, "x", gate=lambda t: QueryIntent("odd")) == "Resultat: 2 fakturor"
    assert api.understand("x", gate=lambda t: 1 / 0).query_type == "filter"
    (tmp_path / "t.csv").write_text("raw_confidence,actual_correct\n" + "".join(f"{i / 100},{'yes' if i > 50 else 'no'}\n" for i in range(100)))
    assert "ECE" in api.validate_confidence(spark, f"{tmp_path}/t.csv")
    trained = api.validate_confidence(spark, f"{tmp_path}/t.csv", f"{tmp_path}/m", train=True)
    assert "  ECE: 0.0000" in trained and api.main(["validate", f"{tmp_path}/t.csv", "--models", f"{tmp_path}/m"]) == trained
    assert api.latest(spark, str(tmp_path), "*.csv").endswith("t.csv")
    with pytest.raises(FileNotFoundError):
        api.latest(spark, str(tmp_path), "*.none")
