"""What a run leaves: summary, manifest, review reports and packages, table dumps, and the profile that configured it.

Small single files (a summary, a manifest) go through the store's own file system, so any store Spark can open works; rows go
through Spark's writers.
"""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import constraints
from ledgerline.sources import files

MANIFEST = "filename string, artifact_type string, pipeline_stage string, relative_path string, file_size long, checksum string, created_at string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file, written beside its place and then moved there, so that nobody reads half of it."""
    fs, part = _fs(spark, f"{path}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, whole = _fs(spark, path)
    if fs.exists(whole):
        fs.delete(whole, False)
    if not fs.rename(part, whole):
        raise OSError(f"{path}.tmp could not be moved to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text; None where there is no file."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def json_safe(value):
    """A value that JSON can hold: numbers that are none count as 0, other numbers as floats, everything else as its text."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    if value is None or isinstance(value, (bool, int, str)):
        return value
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    return number if math.isfinite(number) else 0.0


@dataclass
class RunSummary:
    """Counts and places of one run."""

    run_id: str
    input_path: str
    output_dir: str
    started_at: str
    finished_at: str | None = None
    status: str = "RUNNING"
    total_files: int = 0
    processed_files: int = 0
    ok_count: int = 0
    partial_count: int = 0
    review_count: int = 0
    failed_count: int = 0
    errors: list[dict] = field(default_factory=list)
    durations: dict[str, float] = field(default_factory=dict)
    profile_name: str | None = None
    pipeline_version: str | None = None

    def count(self, invoices: DataFrame) -> RunSummary:
        """Adds the invoices' counts per status and their number of files (file_id, status)."""
        found = batch_counts(invoices).first()
        self.ok_count, self.partial_count, self.review_count, self.failed_count = found.n_ok, found.n_partial, found.n_review, found.n_failed
        self.total_files = self.processed_files = found.n_files
        return self

    def complete(self, at: str, status: str = "COMPLETED") -> RunSummary:
        self.status, self.finished_at = status, at
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        write_text(spark, json.dumps(json_safe(dataclasses.asdict(self)), ensure_ascii=False, indent=2), path)


def batch_counts(invoices: DataFrame) -> DataFrame:
    """One row: n_files, n_invoices and the number of invoices of each status."""
    each = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in constraints.ALL_STATUSES]
    return invoices.agg(F.count_distinct("file_id").alias("n_files"), F.count(F.lit(1)).alias("n_invoices"), *each)


def save_manifest(entries: DataFrame, path: str, *, run_id: str, created_at: str, version: str = "1.0") -> None:
    """The manifest as one row a file, with its run, time and format beside them."""
    known = entries.select(*[F.col(c).cast(t).alias(c) for c, t in (f.split() for f in MANIFEST.split(", "))])
    known.withColumns({"run_id": F.lit(run_id), "manifest_created_at": F.lit(created_at), "manifest_version": F.lit(version)}).write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A saved manifest; what an entry lacks is filled: empty path and checksum, size 0, first format."""
    read = spark.read.schema(f"{MANIFEST}, run_id string, manifest_created_at string, manifest_version string").json(path)
    return read.fillna({"relative_path": "", "checksum": "", "file_size": 0, "manifest_version": "1.0", "run_id": ""})


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest entries of all files below a folder."""
    kind = F.split("kind", "/")
    return files.index_artifacts(spark, folder).select(
        F.substring_index("path", "/", -1).alias("filename"), F.get(kind, F.lit(0)).alias("artifact_type"), F.nullif(F.get(kind, F.lit(1)), F.lit("")).alias("pipeline_stage"), F.col("path").alias("relative_path"),
        F.col("size").alias("file_size"), F.col("sha256").alias("checksum"), F.lit(None).cast("string").alias("created_at"),
    )


def check_artifacts(spark: SparkSession, folder: str, current: str) -> dict[str, str]:
    """Compatibility of a folder's run summary (in it or above it) and manifest; what is not there is left out, what cannot be read
    is UNKNOWN."""
    out = {}
    places = (f"{folder}/run_summary.json", f"{folder.rstrip('/').rpartition('/')[0]}/run_summary.json")
    text = next((t for t in (read_text(spark, p) for p in places) if t is not None), None)
    if text is not None:
        out["run_summary"] = _band(spark, text, "pipeline_version", lambda v: constraints.summary_band(v, F.lit(current)))
    if (text := read_text(spark, f"{folder}/artifact_manifest.json")) is not None:
        out["artifact_manifest"] = _band(spark, text, "manifest_version", constraints.manifest_band)
    return out


def _band(spark: SparkSession, text: str, key: str, rule) -> str:
    try:
        version = json.loads(text).get(key)
    except (ValueError, AttributeError):
        return "UNKNOWN"
    return spark.range(1).select(rule(F.lit(version).cast("string"))).first()[0]


def review_reports(checked: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """invoice_id and ``report`` (JSON text): header fields with their confidences and traces, and the check's result.

    ``checked`` is of ``linecheck.invoice_messages`` with invoice_number, supplier_name and invoice_date; ``traces`` has invoice_id, field,
    value, confidence, evidence (JSON text)."""
    if traces is not None:
        told = traces.groupBy("invoice_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("field", "value", "confidence", F.from_json("evidence", constraints.EVIDENCE).alias("evidence"))))).alias("_traces"))
        checked = checked.join(told, "invoice_id", "left")
    trace = lambda f: F.element_at("_traces", F.lit(f)) if traces is not None else F.lit(None).cast("string")
    safe = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    header = F.struct(
        "invoice_number", safe("number_confidence").alias("invoice_number_confidence"), safe("header_total").alias("total_amount"), safe("total_confidence").alias("total_confidence"), "supplier_name",
        F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"), trace("invoice_no").alias("invoice_number_traceability"), trace("total").alias("total_traceability"),
    )
    check = F.struct("status", safe("lines_sum").alias("lines_sum"), safe("diff").alias("diff"), F.lit(1.0).alias("tolerance"), "errors", "warnings", F.col("n_lines").alias("line_count"))
    return checked.select("invoice_id", F.to_json(F.struct(header.alias("invoice_header"), check.alias("validation")), {"ignoreNullFields": "false"}).alias("report"))


def write_review_package(reports: DataFrame, path: str) -> None:
    """A folder for each invoice under review, with its report."""
    reports.select("report", F.col("invoice_id").cast("string").alias("invoice")).write.mode("overwrite").partitionBy("invoice").text(path)


def write_table_dump(path: str, rows: DataFrame, lines: DataFrame, checks: DataFrame, tokens: DataFrame) -> None:
    """Four folders about tables whose sums fail, a part for each invoice: raw rows, read lines, checks, tokens."""
    for name, df in (("table_block_raw_text", rows), ("parsed_lines", lines), ("validation_result", checks), ("table_block_tokens", tokens)):
        df.withColumn("invoice", F.col("invoice_id").cast("string")).write.mode("overwrite").partitionBy("invoice").json(f"{path}/{name}")


#: Settings of the default profile.
DEFAULT_PROFILE = {"name": "default", "description": "", "header": {}, "footer": {}, "zones": {}, "tolerances": {}, "ocr_routing": {}, "ai_policy": {}, "table_parser_mode": "auto"}


def load_profile(spark: SparkSession, folder: str, name: str = "default") -> dict:
    """The settings of a profile file (JSON, or YAML where its library is there), over the defaults."""
    if (text := read_text(spark, f"{folder}/{name}.json")) is not None:
        read = json.loads(text)
    elif (text := read_text(spark, f"{folder}/{name}.yaml")) is not None:
        import yaml

        read = yaml.safe_load(text)
    else:
        raise FileNotFoundError(f"no profile {name} in {folder}")
    if not isinstance(read, dict) or not read:
        raise ValueError(f"profile {name} is empty")
    return DEFAULT_PROFILE | {k: v for k, v in read.items() if k in DEFAULT_PROFILE}


def list_profiles(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folder's profiles in order; the default alone where there are none."""
    fs, p = _fs(spark, folder)
    names = {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()
    return sorted({n.rpartition(".")[0] for n in names if n.endswith((".json", ".yaml"))}) or ["default"]
