"""Python entry points: ask in words, import corrections, keep patterns, train and check calibration; results as text.

Frames stay lazy until a text is asked for; texts show what their query's limit lets through.
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import analytics, calibration
from ledgerline.sources import files, store


def understand(text: str, *, gate: Callable[[str], analytics.QueryIntent | None] | None = None, today: dt.date | None = None) -> analytics.QueryIntent:
    """The intent of a question: of ``gate`` (a service of the caller's), where given and able; by keywords else."""
    if gate is not None:
        try:
            if (found := gate(text)) is not None:
                return found
        except Exception:  # a service that fails must not fail the question
            pass
    return analytics.parse_query(text, today=today)


def ask(invoices: DataFrame, text: str, **options) -> str:
    intent = understand(text, **options)
    return shown(analytics.execute(intent, invoices), intent)


def _money(value) -> str:
    return f"{value or 0:.2f}"


def shown(results: dict[str, DataFrame], intent: analytics.QueryIntent) -> str:
    """A query's results as Swedish text. Rows are fetched one partition at a time."""
    rows = results["rows"]
    count = rows.count()
    if intent.query_type == "filter":
        out = [f"Hittade {count} fakturor:", ""]
        for r in rows.toLocalIterator():
            out += [f"  • {r.invoice_number or 'N/A'} - {r.supplier_name or 'N/A'} ({r.invoice_date.isoformat() if r.invoice_date else 'N/A'})", f"    Totalsumma: {_money(r.total_amount)} SEK, Status: {r.status or 'N/A'}"]
    elif intent.query_type == "aggregate":
        found = results["aggregates"].first().asDict() if "aggregates" in results else {}
        out = [f"Resultat för {count} fakturor:", ""]
        out += [f"  {name}: {found[key] if key == 'count' else _money(found[key]) + ' SEK'}" for key, name in (("sum", "Totalsumma"), ("count", "Antal fakturor"), ("average", "Genomsnitt")) if key in found]
    elif intent.query_type == "summarize":
        s = results["summary"].first()
        names = s.suppliers.split(",") if s.suppliers else []
        out = [f"Sammanfattning för {count} fakturor:", "", f"  Totalsumma: {_money(s.total)} SEK", f"  Antal leverantörer: {len(names)}", f"  Leverantörer: {', '.join(names[:5])}"]
        out += [f"    ... och {len(names) - 5} fler"] if len(names) > 5 else []
        out += [f"  Datumintervall: {s.date_min} till {s.date_max}"] if s.date_min else []
        out += ["  Status:", *(f"    {k}: {s[f'n_{k.lower()}']}" for k in ("OK", "PARTIAL", "REVIEW") if s[f"n_{k.lower()}"])]
    elif intent.query_type == "compare":
        out = [f"Jämförelse för {count} fakturor:", "", "  Per leverantör:"]
        for r in results["comparison"].toLocalIterator():
            out += [f"    {r.supplier_name}:", f"      Antal: {r['count']}", f"      Totalsumma: {_money(r.total)} SEK", *([f"      Genomsnitt: {_money(r.average)} SEK"] if r.average else [])]
    else:
        out = [f"Resultat: {count} fakturor"]
    return "\n".join(out)


def report_text(report: DataFrame, bins: DataFrame) -> str:
    """A calibration report as text: one row of measures, and one line a bin."""
    r = report.first()
    out = ["Kalibreringsrapport", f"  Antal: {r.n}", f"  Träffsäkerhet: {r.accuracy:.3f}", f"  ECE: {r.ece:.4f} (lika breda: {r.ece_equal_width:.4f})", f"  MCE: {r.mce:.4f}", f"  Brier: {r.brier:.4f}", f"  Största avvikelse: {r.max_drift:.4f}", "  Per intervall:"]
    out += [f"    {b.label}: n={b.n}, rå={b.mean_raw:.3f}, kalibrerad={b.mean_calibrated:.3f}, träff={b.accuracy:.3f}, avvikelse={b.drift:.3f}" for b in sorted(bins.collect(), key=lambda b: b.bin)]
    return "\n".join([*out, f"  Ny kalibrering behövs: {'ja' if r.recalibrate else 'nej'}"])


def latest(spark: SparkSession, folder: str, pattern: str = "*") -> str:
    """The path of the newest file below ``folder``."""
    row = files.scan_documents(spark, folder, pattern).orderBy(F.desc("modified"), "path").first()
    if row is None:
        raise FileNotFoundError(f"nothing in {folder} matches {pattern}")
    return row.path


def import_corrections(spark: SparkSession, path: str, corrections: str, patterns: str) -> int:
    """Adds a file's corrections and the patterns they teach to the stores; the number of corrections."""
    now = F.current_timestamp()
    found = store.import_corrections(spark, path, now)
    known = store.create(spark, patterns, store.PATTERN)
    learnt = store.new_patterns(store.learning.extract_patterns(found).withColumnRenamed("corrected_total", "correct_total"), known, now)
    n = found.count()
    store.add(found.drop("arrival"), corrections)
    store.add(learnt, patterns)
    return n


def maintain_patterns(spark: SparkSession, patterns: str, **options) -> tuple[int, int]:
    """Upkeep of the pattern store: patterns before and after."""
    known = store.create(spark, patterns, store.PATTERN)
    before = known.count()
    store.replace(store.maintain(known, F.current_timestamp(), **options), patterns)
    return before, spark.read.schema(store.PATTERN).parquet(patterns).count()


def validate_confidence(spark: SparkSession, truth: str, models: str | None = None, *, train: bool = False) -> str:
    """Checks scores against truth, by the saved models where given; with ``train`` models are fitted and saved first."""
    known = files.read_truth(spark, truth)
    for c in ("supplier", "field"):
        known = known if c in known.columns else known.withColumn(c, F.lit(None).cast("string"))
    if train and models:
        files.save_models(calibration.train(known).select("supplier", "field", "x", F.col("fit").alias("y"), "weight"), models)
    if models:
        fitted = files.load_models(spark, models).select("supplier", "field", "x", F.col("y").alias("fit"))
        scored = calibration.calibrate(known, fitted)
    else:
        scored = known.withColumn("calibrated", calibration.clamped(F.col("raw_confidence")))
    return report_text(calibration.report(scored), calibration.report_bins(scored))


def main(argv: list[str] | None = None) -> str:
    """Command line: ask, import, maintain, validate. Returns what it prints."""
    parser = argparse.ArgumentParser(prog="ledgerline")
    parts = parser.add_subparsers(dest="what", required=True)
    one = parts.add_parser("ask")
    one.add_argument("folder")
    one.add_argument("question")
    one = parts.add_parser("import")
    for name in ("file", "corrections", "patterns"):
        one.add_argument(name)
    parts.add_parser("maintain").add_argument("patterns")
    one = parts.add_parser("validate")
    one.add_argument("truth")
    one.add_argument("--models")
    one.add_argument("--train", action="store_true")
    got = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if got.what == "ask":
        text = ask(files.read_export(spark, got.folder), got.question)
    elif got.what == "import":
        text = f"{import_corrections(spark, got.file, got.corrections, got.patterns)} korrigeringar"
    elif got.what == "maintain":
        text = "{} mönster, {} kvar".format(*maintain_patterns(spark, got.patterns))
    else:
        text = validate_confidence(spark, got.truth, got.models, train=got.train)
    print(text)
    return text
