"""Per-page and per-file decisions: text layer or OCR, structured-document signals, enrichment policy, artifact types."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import content_score, strip_space


@dataclass(frozen=True)
class RoutingConfig:
    min_chars: int = 500
    min_words: int = 40
    min_quality: float = 0.5
    required: tuple[str, ...] = (r"Faktura\s",)
    extra: tuple[str, ...] = (r"Sida\s*\d+\s*/\s*\d+",)
    allow_quality_override: bool = True


def sound_pattern(pattern: str) -> str:
    """The pattern, or its letters as they are where it is none."""
    try:
        re.compile(pattern)
    except re.error:
        return "".join(f"\\{c}" if not (c.isalnum() or c == "_" or c.isspace()) else c for c in pattern)
    return pattern


def matching(text: Column, patterns: tuple[str, ...]) -> Column:
    """Those of the patterns that the text matches, in their order, without case."""
    return flags(*[(F.coalesce(text.rlike(f"(?iu){sound_pattern(p)}"), F.lit(False)), p) for p in patterns]) if patterns else F.array().cast("array<string>")


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(text.rlike(f"(?iu){sound_pattern(p)}"), F.lit(False))
    return hit


def flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def text_layer(pages: DataFrame, config: RoutingConfig = RoutingConfig(), text_col: str = "text") -> DataFrame:
    """Adds text_chars, word_tokens, text_quality, use_text_layer and reasons."""
    out = pages.withColumn("_t", strip_space(F.coalesce(text_col, F.lit(""))))
    words = F.size(F.filter(F.split("_t", r"(?U)\s+"), lambda w: w != ""))
    out = out.withColumns({"text_chars": F.length("_t"), "word_tokens": words, "text_quality": content_score(F.col("_t"))})
    chars = F.col("text_chars") >= config.min_chars
    required = any_match(F.col("_t"), config.required) if config.required else F.lit(True)
    extra = any_match(F.col("_t"), config.extra) if config.extra else F.lit(True)
    base = chars & required & extra
    override = F.lit(config.allow_quality_override) & (F.col("text_quality") >= config.min_quality) & (F.col("word_tokens") >= config.min_words)
    reasons = flags((~chars, "min_text_chars"), (~required, "required_anchor_missing"), (~extra, "extra_anchor_missing"), (override & ~base, "quality_override"))
    return out.withColumns({"use_text_layer": base | override, "reasons": reasons}).drop("_t")


def structured_signals(pages: DataFrame, *, required: tuple[str, ...], extra: tuple[str, ...], tables: tuple[str, ...], min_signals: int = 2, min_quality: float = 0.5, text_col: str = "text") -> DataFrame:
    """Adds the signals found and whether the page looks like a structured (EDI-like) document."""
    t = F.coalesce(text_col, F.lit(""))
    need, more, table = (any_match(t, p) for p in (required, extra, tables))
    signals = flags((F.col("use_text_layer"), "text_layer"), (F.col("text_quality") >= min_quality, "text_quality"), (need, "anchor_required"), (more, "anchor_extra"), (table, "table_pattern"))
    like = F.col("use_text_layer") & (need if required else F.lit(True)) & (F.size("signals") >= max(1, min_signals))
    return pages.withColumn("signals", signals).withColumn("edi_like", like)


def overlaid(config: RoutingConfig, settings: dict | None) -> RoutingConfig:
    """The configuration with a profile's settings over it; names it does not know are passed over."""
    known = {f.name for f in fields(config)}
    return replace(config, **{k: tuple(v) if isinstance(v, list) else v for k, v in (settings or {}).items() if k in known})


#: The policy's defaults.
POLICY = {"allow_ai_for_edi": False, "force_review_on_edi_fail": True, "min_edi_signals": 2, "min_text_quality": 0.5}


def policy_of(settings: dict | None) -> dict:
    return POLICY | {k: v for k, v in (settings or {}).items() if k in POLICY and v is not None}


def policy_gate(pages: DataFrame, *, allow_structured: bool = False, review_on_failure: bool = True) -> DataFrame:
    """Adds allow_ai, gate_reason and ``gate_flags`` from edi_like, signals and status; also from ``fallback_passed`` (NULL: not tried,
    see ``fallback_attempted``) and ``extraction_source`` where they are columns."""
    sound = F.coalesce(F.col("status").isin("OK", "PARTIAL"), F.lit(False))
    allow = F.when(~F.col("edi_like"), True).when(~sound & F.lit(review_on_failure), False).otherwise(allow_structured)
    reason = F.when(F.col("edi_like") & sound & F.lit(not allow_structured), "edi_blocked_validation_ok").when(F.col("edi_like") & ~sound & F.lit(review_on_failure), "edi_force_review").when(F.col("edi_like") & ~sound & F.lit(not allow_structured), "edi_blocked_validation_fail")
    tried = F.coalesce("fallback_attempted", F.lit(False)) if "fallback_attempted" in pages.columns else F.lit(False)
    passed = F.col("fallback_passed") if "fallback_passed" in pages.columns else F.lit(None).cast("boolean")
    source = F.col("extraction_source") if "extraction_source" in pages.columns else F.lit(None).cast("string")
    told = F.array(
        F.when(F.col("status").isNull(), "validation_missing").when(sound, "validation_passed").otherwise("validation_failed"), F.when(tried, "fallback_attempted").otherwise("fallback_not_attempted"),
        F.when(tried & passed, "fallback_passed").when(tried & ~passed, "fallback_failed"), reason, F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("source:"), source)),
    )
    return pages.withColumns({"allow_ai": allow, "gate_reason": reason, "gate_flags": F.array_compact(F.concat(F.array_distinct("signals"), told))})


def document_type(pages: DataFrame, file: str = "file_id", text_col: str = "text") -> DataFrame:
    """Per file: searchable or scanned, its route, and how sure that is."""
    n = F.length(strip_space(F.coalesce(text_col, F.lit(""))))
    out = pages.groupBy(file).agg(F.count_if(n > 0).alias("pages_with_text"), F.sum(n).cast("long").alias("total_chars"), F.count(F.lit(1)).alias("n_pages"))
    share = F.col("pages_with_text") / F.col("n_pages")
    searchable = ((share >= 0.5) & (F.col("total_chars") > 50)) | ((share >= 0.3) & (F.col("total_chars") > 20))
    sure = F.when((share >= 0.8) & (F.col("total_chars") > 200), "HIGH").when((share >= 0.5) & (F.col("total_chars") > 50), "MEDIUM").otherwise("LOW")
    return out.withColumns({"pdf_type": F.when(searchable, "searchable").otherwise("scanned"), "route": F.when(searchable, "text").otherwise("ocr"), "confidence": sure})


def artifact_type(path: Column) -> Column:
    """Type and stage of a run's file from its relative path, as 'type/stage'."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    return (
        F.when(name.startswith("ai_"), "ai/ai_enrichment").when(name == "run_summary.json", "summary/").when(name.endswith(".xlsx") | name.endswith(".xls"), "excel/export")
        .when(low.contains("review"), "debug/validation").when(low.contains("tokens"), "tokens/tokenization").when(low.contains("rows"), "rows/row_grouping")
        .when(low.contains("segments"), "segments/segment_identification").otherwise("debug/")
    )
