"""Record validators: one predicate a rule; rows that break one go to a frame of rejects with the names of their rules.

A rule holds where its predicate is true; NULL breaks it unless the rule says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import compatibility

#: Domains of states, segments and traced fields.
STATUSES, ALL_STATUSES, SEGMENTS, TRACED = ("OK", "PARTIAL", "REVIEW"), ("OK", "PARTIAL", "REVIEW", "FAILED"), ("header", "items", "footer"), ("invoice_no", "total")
#: Parts of a traced value's evidence.
EVIDENCE = "page_number int, bbox array<double>, row_index int, text_excerpt string, tokens array<struct<text:string,bbox:array<double>,conf:double>>"
REPLY = "total_amount double, confidence double, reasoning string, validation_passed boolean"

#: Predicates by rule, as columns or SQL.
Rules = dict[str, Column | str]

_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
PAGE: Rules = {"page_number": "page_number >= 1"}
TOKEN: Rules = {"width": "width >= 0", "height": "height >= 0"}
ROW: Rules = {"tokens": "n_tokens > 0", "x_range": "x_min <= x_max"}
SEGMENT: Rules = {"segment_type": f"segment_type IN {_IN(SEGMENTS)}", "y_range": "y_min <= y_max", "rows": "n_rows > 0"}
LINE: Rules = {"rows": "n_rows > 0", "total": "line_total > 0"}
HEADER: Rules = {"number_confidence": "number_confidence BETWEEN 0 AND 1", "total_confidence": "total_confidence BETWEEN 0 AND 1"}
VALIDATION: Rules = {"status": f"status IN {_IN(STATUSES)}", "lines_sum": "lines_sum >= 0", **HEADER}
VIRTUAL: Rules = {"status": f"status IN {_IN(ALL_STATUSES)}", "index": "virtual_invoice_index >= 1", "page_start": "page_start >= 1", "page_order": "page_end >= page_start"}
QUALITY: Rules = {"score": "score BETWEEN 0 AND 100"}


def document_rules(pages: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with ``broken``: page_count must be the number of their pages."""
    found = pages.groupBy(key).agg(F.count(F.lit(1)).alias("_pages"))
    counted = documents.join(found, key, "left")
    return broken(counted.withColumn("_pages", F.coalesce("_pages", F.lit(0))), {"page_count": F.col("page_count") == F.col("_pages")}).drop("_pages")


def evidence_rules(evidence: str = "evidence") -> Rules:
    """Rules of a traced value whose evidence is a JSON text: its parts must be there, the box have four numbers, the tokens be a list."""
    e = F.from_json(F.col(evidence), EVIDENCE)
    part = lambda p: F.get_json_object(evidence, f"$.{p}")
    keys = F.json_object_keys(evidence)
    whole = F.forall(F.array(*[F.lit(k.split()[0]) for k in EVIDENCE.replace("array<struct<text:string,bbox:array<double>,conf:double>>", "tokens").split(", ")]), lambda k: F.array_contains(keys, k))
    return {"field": F.col("field").isin(*TRACED), "confidence": "confidence BETWEEN 0 AND 1", "parts": whole, "bbox": (F.size(e["bbox"]) == 4) & F.forall(e["bbox"], lambda v: v.isNotNull()), "tokens": part("tokens").startswith("[")}


def reply_rules(reply: str = "reply") -> Rules:
    """Rules of an enrichment service's reply (JSON text): a number, a share and a truth value."""
    number = lambda p: F.get_json_object(reply, f"$.{p}").try_cast("double")
    return {"total_amount": number("total_amount").isNotNull(), "confidence": number("confidence").between(0, 1), "validation_passed": F.get_json_object(reply, "$.validation_passed").isin("true", "false")}


def parse_reply(reply: Column) -> Column:
    """struct(total_amount, confidence, reasoning, validation_passed) from the JSON object in a free text; else the text's last
    number with confidence 0.7; NULL without any."""
    held = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    read = F.from_json(held, REPLY)
    sound = read["total_amount"].isNotNull() & read["confidence"].isNotNull() & read["validation_passed"].isNotNull()
    last = F.replace(F.element_at(F.regexp_extract_all(reply, F.lit(r"(\d+[.,]\d+|\d+)"), F.lit(1)), -1), F.lit(","), F.lit(".")).try_cast("double")
    plain = F.struct(last.alias("total_amount"), F.lit(0.7).alias("confidence"), F.lit("Fallback parsing from AI response").alias("reasoning"), F.lit(False).alias("validation_passed"))
    return F.when(sound, read).when(F.size(F.regexp_extract_all(reply, F.lit(r"(\d)"), F.lit(1))) > 0, plain)


def plausible(total: Column, confidence: Column, lines_sum: Column) -> tuple[Column, Column]:
    """(validated, confidence) of a service's total: a sum that cannot be right is no objection; one within 1.00 validates and raises
    the confidence by 0.1, by 0.2 if it is the same."""
    gap = F.abs(total - lines_sum)
    odd = (gap > F.greatest(F.lit(500.0), total * 0.15)) | ((lines_sum < 100) & (total > 1000))
    close = ~odd & (gap <= 1.0)
    validated = F.when(total.isNull(), False).when(lines_sum.isNull(), True).otherwise(odd | close)
    raised = F.when(F.coalesce(close, F.lit(False)), F.least(F.lit(1.0), confidence + F.when(gap < 0.01, 0.2).otherwise(0.1))).otherwise(confidence)
    return validated, raised


def broken(df: DataFrame, rules: Rules) -> DataFrame:
    """All rows with ``broken``, the names of the rules that don't hold."""
    holds = {name: F.expr(rule) if isinstance(rule, str) else rule for name, rule in rules.items()}
    return df.withColumn("broken", F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in holds.items()])))


def rejects(df: DataFrame, rules: Rules) -> DataFrame:
    return broken(df, rules).filter(F.size("broken") > 0)


def accepted(df: DataFrame, rules: Rules) -> DataFrame:
    return broken(df, rules).filter(F.size("broken") == 0).drop("broken")


def strict(df: DataFrame, rules: Rules) -> DataFrame:
    """The rows as they are; reading one that breaks a rule is an error that names it."""
    told = F.when(F.size("broken") > 0, F.raise_error(F.concat(F.lit("broken: "), F.array_join("broken", ", "))).cast("array<string>")).otherwise(F.col("broken"))
    return broken(df, rules).filter(F.size(told) == 0).drop("broken")


def with_raw_text(headers: DataFrame, rows: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Headers whose empty raw_text is filled with their rows' texts."""
    texts = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "text"))), lambda r: r["text"]), " ").alias("_t"))
    return headers.join(texts, key, "left").withColumn("raw_text", F.coalesce(F.nullif("raw_text", F.lit("")), "_t")).drop("_t")


def summary_band(version: Column, current: Column) -> Column:
    """Compatibility of a run summary's pipeline version."""
    return compatibility(version, current)


def manifest_band(version: Column) -> Column:
    """Compatibility of a manifest by its format version; one without a version is of the first format."""
    return F.when(F.coalesce(version, F.lit("1.0")) == "1.0", "COMPATIBLE").otherwise("WARNING")


def artifact_bands(summaries: DataFrame, manifests: DataFrame, current: str) -> DataFrame:
    """run_id, kind ('run_summary' or 'artifact_manifest') and band of all artifacts."""
    a = summaries.select("run_id", F.lit("run_summary").alias("kind"), summary_band(F.col("pipeline_version"), F.lit(current)).alias("band"))
    return a.unionByName(manifests.select("run_id", F.lit("artifact_manifest").alias("kind"), manifest_band(F.col("manifest_version")).alias("band")))
