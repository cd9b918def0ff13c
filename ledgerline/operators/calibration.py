"""Confidence calibration: weighted points, isotonic fit, lookup with fallbacks, ECE, MCE, Brier."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import let

#: Rows a segment needs: supplier and field, supplier only, field only, all.
LEAST_ROWS = (200, 150, 100, 50)
LEAST_SCORES = 8


def weighted_points(truth: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per score rounded to 4 decimals (half to even): x, mean correctness y and weight."""
    return truth.groupBy(*keys, F.bround("raw_confidence", 4).alias("x")).agg(F.avg(F.col("actual_correct").cast("double")).alias("y"), F.count(F.lit(1)).alias("weight"))


def isotonic(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``points`` with ``fit`` by pool adjacent violators, one segment a task.

    A segment has at most 10,001 points (scores are rounded to 4 decimals), however many rows made them."""
    names = [*keys, "x", "y", "weight"]

    def pool(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x")
        blocks: list[list[float]] = []
        for y, w in zip(part["y"], part["weight"], strict=True):
            blocks.append([y * w, w, 1])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, w2, n = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w2, blocks[-1][2] + n]
        return part.assign(fit=[b[0] / b[1] for b in blocks for _ in range(int(b[2]))])

    kept = points.select(*names)
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes) + ", fit double"
    return kept.groupBy(*keys).applyInPandas(pool, schema) if keys else kept.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(lambda p: pool(p.drop(columns="_all")), schema)


def interpolate(x: Column, curve: Column) -> Column:
    """Linear between the points (x, fit) of a sorted array, flat outside; NULL where it is empty. The point at or below x is
    found by halves."""
    steps = F.array(*[F.lit(2**i) for i in range(13, -1, -1)])  # up to 16,384 points
    jump = lambda at, by: F.when(F.coalesce(F.get(curve, at + by)["x"] <= x, F.lit(False)), at + by).otherwise(at)

    def between(at: Column) -> Column:
        low, high = F.get(curve, F.when(at >= 0, at)), F.get(curve, at + 1)
        inner = low["fit"] + (high["fit"] - low["fit"]) * (x - low["x"]) / (high["x"] - low["x"])
        return F.when(low["x"] == x, low["fit"]).otherwise(F.coalesce(inner, low["fit"], high["fit"]))

    return let(F.aggregate(steps, F.lit(-1), jump), between)


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def apply_fit(scores: DataFrame, fit: DataFrame, score_col: str = "raw_confidence") -> DataFrame:
    """Scores with ``calibrated``: linear between fitted points, flat outside; without points the score itself.

    The points (at most 10,001) are one row, joined to every row by broadcast."""
    curve = fit.agg(F.array_sort(F.collect_list(F.struct("x", "fit"))).alias("_curve"))
    x = clamped(F.col(score_col))
    return scores.join(F.broadcast(curve)).withColumn("calibrated", F.coalesce(interpolate(x, F.col("_curve")), x)).drop("_curve")


def segments(truth: DataFrame) -> DataFrame:
    """CUBE of supplier and field ('*' is any): rows, distinct rounded scores, accuracy, and whether the segment may train."""
    level = F.grouping_id()
    made = truth.cube("supplier", "field").agg(level.alias("level"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.bround("raw_confidence", 4)).alias("n_scores"), F.avg(F.col("actual_correct").cast("double")).alias("accuracy"))
    need = F.element_at(F.array(*[F.lit(n) for n in LEAST_ROWS]), F.col("level").cast("int") + 1)
    return made.select(F.coalesce("supplier", F.lit("*")).alias("supplier"), F.coalesce("field", F.lit("*")).alias("field"), "n_rows", "n_scores", "accuracy", ((F.col("n_rows") >= need) & (F.col("n_scores") >= LEAST_SCORES)).alias("trains"))


def segment_truth(truth: DataFrame) -> DataFrame:
    """Every row once for each of the segments it belongs to ('*' is any): supplier and field, supplier, field, all."""
    keys = F.array(*[F.struct(F.coalesce(s, F.lit("*")).alias("s"), F.coalesce(f, F.lit("*")).alias("f")) for s, f in ((F.col("supplier"), F.col("field")), (F.col("supplier"), F.lit("*")), (F.lit("*"), F.col("field")), (F.lit("*"), F.lit("*")))])
    return truth.select(F.explode(F.array_distinct(keys)).alias("k"), "raw_confidence", "actual_correct").select(F.col("k.s").alias("supplier"), F.col("k.f").alias("field"), "raw_confidence", "actual_correct")


def least_rows(supplier: Column, field: Column) -> Column:
    """Rows that a segment needs before it is trained."""
    return F.when((supplier != "*") & (field != "*"), LEAST_ROWS[0]).when(supplier != "*", LEAST_ROWS[1]).when(field != "*", LEAST_ROWS[2]).otherwise(LEAST_ROWS[3])


def train(truth: DataFrame) -> DataFrame:
    """supplier, field, x, y, weight, fit of every segment with enough rows and distinct scores; scores are clamped to 0..1.

    Points are summed up by rounded score before segments are counted, so a hot segment shuffles 10,001 rows a task at most."""
    known = truth.withColumn("raw_confidence", clamped(F.col("raw_confidence"))).filter("raw_confidence is not null and actual_correct is not null")
    points = weighted_points(segment_truth(known), ("supplier", "field"))
    size = points.groupBy("supplier", "field").agg(F.sum("weight").alias("_rows"), F.count(F.lit(1)).alias("_scores"))
    able = size.filter((F.col("_rows") >= least_rows(F.col("supplier"), F.col("field"))) & (F.col("_scores") >= LEAST_SCORES))
    return isotonic(points.join(able.select("supplier", "field"), ["supplier", "field"]), ("supplier", "field"))


def register(models: DataFrame, more: DataFrame) -> DataFrame:
    """The models with those of ``more`` put in the place of their segments'."""
    return models.join(more.select("supplier", "field").distinct(), ["supplier", "field"], "left_anti").unionByName(more)


def calibrate(rows: DataFrame, models: DataFrame, score_col: str = "raw_confidence") -> DataFrame:
    """Rows (supplier, field) with ``model``, the segment used, and ``calibrated``; the clamped score itself where no segment fits."""
    curves = models.groupBy(F.concat_ws("/", "supplier", "field").alias("_m")).agg(F.array_sort(F.collect_list(F.struct("x", "fit"))).alias("_curve"))
    keyed = lookup(rows, models.select("supplier", "field").distinct())
    x = clamped(F.col(score_col))
    return keyed.join(curves, F.col("model") == F.col("_m"), "left").withColumn("calibrated", F.coalesce(interpolate(x, F.col("_curve")), x)).drop("_m", "_curve")


def bin_errors(scores: DataFrame, edges: DataFrame | None = None, bins: int = 10) -> DataFrame:
    """One row: ece, mce, n, bins_with_data of ``calibrated`` against ``actual_correct``, in bins of ``raw_confidence``: of equal
    width, or by ``edges`` (of ``quantile_edges``)."""
    raw = clamped(F.col("raw_confidence"))
    if edges is None:
        return errors(bin_means(scores, F.least(F.floor(raw * bins), F.lit(bins - 1)).cast("int")))
    placed = scores.join(F.broadcast(edges)).withColumn("_bin", bin_index(raw, F.col("edges")))  # one row of bins + 1 numbers
    return errors(bin_means(placed, F.col("_bin")))


def report(scores: DataFrame, bins: int = 10) -> DataFrame:
    """One row about scores with raw_confidence, calibrated and actual_correct: accuracy, ece and mce in quantile bins,
    ece_equal_width, brier, n, bins_with_data (of equal width), largest drift, and whether to train anew."""
    even = bin_means(scores, F.least(F.floor(clamped(F.col("raw_confidence")) * bins), F.lit(bins - 1)).cast("int"))
    wide = errors(even).select(F.col("ece").alias("ece_equal_width"), F.col("mce").alias("max_drift"), "bins_with_data")
    fine = bin_errors(scores, quantile_edges(scores.withColumn("raw_confidence", clamped(F.col("raw_confidence"))), bins)).select("ece", "mce", "n")
    accuracy = scores.agg(F.coalesce(F.avg(F.col("actual_correct").cast("double")), F.lit(0.0)).alias("accuracy"))
    one = fine.join(wide).join(brier(scores)).join(accuracy)  # one row each
    return one.withColumn("recalibrate", recalibrate(F.col("ece"), F.col("mce"), F.col("n"), F.col("bins_with_data")))


def report_bins(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin of equal width, empty ones too: label, n, mean_raw, mean_calibrated, accuracy, drift."""
    at = F.least(F.floor(clamped(F.col("raw_confidence")) * bins), F.lit(bins - 1)).cast("int")
    found = scores.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(clamped(F.col("raw_confidence"))).alias("mean_raw"), F.avg("calibrated").alias("mean_calibrated"), F.avg(F.col("actual_correct").cast("double")).alias("accuracy"))
    every = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(found, "bin", "left").fillna(0).withColumn("drift", F.abs(F.col("mean_calibrated") - F.col("accuracy")))
    return out.withColumn("label", F.concat(F.format_string("%.1f", F.col("bin") / bins), F.lit("-"), F.format_string("%.1f", (F.col("bin") + 1) / bins)))


def lookup(rows: DataFrame, models: DataFrame) -> DataFrame:
    """The model key each row uses: (supplier, field), (supplier, *), (*, field), (*, *). ``models`` has supplier and field."""
    out = rows
    for i, (s, f) in enumerate((("supplier", "field"), ("supplier", None), (None, "field"), (None, None))):
        # Models are one row per trained segment; adaptive execution broadcasts them when their size allows.
        m = models.select(F.col("supplier").alias(f"_s{i}"), F.col("field").alias(f"_f{i}"))
        out = out.join(m, (F.col(f"_s{i}") == (F.col(s) if s else F.lit("*"))) & (F.col(f"_f{i}") == (F.col(f) if f else F.lit("*"))), "left")
    found = [F.when(F.col(f"_s{i}").isNotNull(), F.concat_ws("/", f"_s{i}", f"_f{i}")) for i in range(4)]
    return out.withColumn("model", F.coalesce(*found)).drop(*[f"_{c}{i}" for c in "sf" for i in range(4)])


def quantile_edges(scores: DataFrame, bins: int = 10, score_col: str = "raw_confidence") -> DataFrame:
    """One row, ``edges``: linear quantiles, then strictly increasing, then ends at 0 and 1. Fewer rows than bins: one bin."""
    q = F.percentile(score_col, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))
    raw = scores.agg(q.alias("q"), F.count(score_col).alias("n"))
    rising = F.aggregate(F.col("q"), F.slice("q", 1, 0), lambda a, x: F.concat(a, F.array(F.when((F.size(a) > 0) & (x <= F.element_at(a, -1)), F.element_at(a, -1) + 1e-9).otherwise(x))))
    ends = F.concat(F.array(F.lit(0.0)), F.slice(rising, 2, bins - 1), F.array(F.lit(1.0)))
    return raw.select(F.when(F.col("n") < bins, F.array(F.lit(0.0), F.lit(1.0))).otherwise(ends).alias("edges"))


def bin_index(x: Column, edges: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.size(F.filter(edges, lambda e: e <= x)) - 1, F.size(edges) - 2))


def bin_means(scores: DataFrame, bin_col: Column, calibrated: str = "calibrated") -> DataFrame:
    return scores.groupBy(bin_col.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(calibrated).alias("confidence"), F.avg(F.col("actual_correct").cast("double")).alias("accuracy"))


def errors(bins: DataFrame) -> DataFrame:
    """One row: ece, mce, n, bins_with_data."""
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return bins.agg(F.coalesce(F.sum(gap * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("ece"), F.coalesce(F.max(gap), F.lit(0.0)).alias("mce"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("bins_with_data"))


def brier(scores: DataFrame, calibrated: str = "calibrated") -> DataFrame:
    d = F.col(calibrated) - F.col("actual_correct").cast("double")
    return scores.agg(F.coalesce(F.avg(d * d), F.lit(0.0)).alias("brier"))


def recalibrate(ece: Column, mce: Column, n: Column, bins: Column) -> Column:
    """Whether drift passes the volume's thresholds; never with fewer than 5 bins."""
    limit = lambda a, b, c: F.when(n < 200, a).when(n < 500, b).otherwise(c)
    return (bins >= 5) & ((ece > limit(0.08, 0.06, 0.05)) | (mce > limit(0.15, 0.12, 0.10)))
