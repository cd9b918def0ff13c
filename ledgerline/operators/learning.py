"""Corrections and learned patterns as pure rewrites: nothing here changes a table in place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import layout_hash, supplier_key


def keep_best(corrections: DataFrame, key: str = "invoice_id", confidence: str = "confidence", arrival: str = "arrival") -> DataFrame:
    """One correction per key: the highest confidence (missing counts as 0); a tie keeps the first to arrive.

    A max over a struct is pre-aggregated in every map task, so a hot key shuffles one row a task."""
    best = F.max_by(F.struct(*corrections.columns), F.struct(F.coalesce(confidence, F.lit(0.0)), -F.col(arrival)))
    return corrections.groupBy(F.col(key).alias("_key")).agg(best.alias("_best")).select("_best.*")


def apply_corrections(rows: DataFrame, corrections: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Export rows with ``corrected_total`` of the last correction of their invoice, else their own total."""
    last = corrections.groupBy(key).agg(F.max_by("corrected_total", "arrival").alias("corrected_total"))
    return rows.join(last, key, "left").withColumn("final_total", F.coalesce("corrected_total", "total"))


def extract_patterns(corrections: DataFrame) -> DataFrame:
    """Corrections with a total become patterns of their supplier's layout."""
    return corrections.filter("corrected_total is not null").select(supplier_key(F.col("supplier_name")).alias("supplier_name"), layout_hash(F.col("supplier_name")).alias("layout_hash"), "corrected_total", F.lit(0.1).alias("confidence_boost"), F.lit(1).alias("usage_count"))


def similarity(same_layout: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Half for the layout, half over distance; neither side with a position is a quarter, one side none."""
    none = (x1.isNull() | y1.isNull()) & (x2.isNull() | y2.isNull())
    distance = F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
    return F.when(same_layout, 0.5).otherwise(0.0) + F.when(none, 0.25).otherwise(F.coalesce(F.lit(0.5) / (distance / 100.0 + 1.0), F.lit(0.0)))


def match_patterns(invoices: DataFrame, patterns: DataFrame, *, threshold: float = 0.5, k: int = 3, cell: float = 25.0) -> DataFrame:
    """Each invoice's ``k`` most similar patterns of its supplier, at ``threshold`` or more (at least 0.5); ties go to the smaller pattern id.

    At such a threshold a pattern of another layout matches only at a small distance, found by place. Of the invoice's own
    layout, patterns are looked up by cells of ``cell`` points: the invoice meets the layout's list of cells (pages bound it), keeps
    those that can hold one of the ``k`` nearest, and joins their patterns. Patterns at one place are equally similar, so the
    ``k`` smallest ids of each place stand for it; so do those of patterns without a place."""
    if threshold < 0.5:
        raise ValueError("threshold must be 0.5 or more")
    keys = ["supplier_name", "layout_hash"]
    first = lambda by, df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("pattern_id"))).filter(F.col("_n") <= k).drop("_n")
    known = F.col("position_x").isNotNull() & F.col("position_y").isNotNull()
    p = patterns.select(*keys, "pattern_id", "position_x", "position_y")
    at_places = first([*keys, "position_x", "position_y"], p.filter(known)).withColumns({"cx": F.floor(F.col("position_x") / cell), "cy": F.floor(F.col("position_y") / cell)})
    unplaced, any_placed = first(keys, p.filter(~known)), first(keys, p.filter(known))
    q = invoices.select("invoice_id", *keys, F.col("position_x").alias("x"), F.col("position_y").alias("y"))
    placed = q.filter("x is not null and y is not null")

    cells = at_places.groupBy(*keys, "cx", "cy").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.collect_list(F.struct("cx", "cy", "n")).alias("cells"))
    away = lambda v, c: F.greatest(F.lit(0.0), c * cell - v, v - (c + 1) * cell)
    reach = lambda v, c: F.greatest(F.abs(v - c * cell), F.abs((c + 1) * cell - v))
    ranged = F.array_sort(F.transform("cells", lambda c: F.struct(F.hypot(reach(F.col("x"), c["cx"]), reach(F.col("y"), c["cy"])).alias("far"), F.hypot(away(F.col("x"), c["cx"]), away(F.col("y"), c["cy"])).alias("near"), c["n"].alias("n"), c["cx"].alias("cx"), c["cy"].alias("cy"))))
    # Cells in order of their far corner: where k patterns are certain, nothing beyond that distance is among the k nearest.
    enough = F.aggregate("r", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d")), lambda a, c: F.when(a["n"] >= k, a).otherwise(F.struct((a["n"] + c["n"]).alias("n"), c["far"].alias("d"))))
    asked = placed.join(cells, keys).withColumn("r", ranged).withColumn("d", enough["d"])
    asked = asked.select("invoice_id", *keys, "x", "y", F.explode(F.filter("r", lambda c: c["near"] <= F.col("d") + 1e-6)).alias("c")).select("invoice_id", *keys, "x", "y", "c.cx", "c.cy")
    here = ["invoice_id", F.lit(True).alias("same"), "x", "y", "pattern_id", "position_x", "position_y"]
    found = asked.join(at_places, [*keys, "cx", "cy"]).select(here)
    found = found.unionByName(q.join(unplaced, keys).select(here)).unionByName(q.filter("x is null or y is null").join(any_placed, keys).select(here))
    # Another layout: 0.5 / (1 + d/100) reaches 0.5 only where d is 0.
    other = placed.withColumnRenamed("layout_hash", "own").join(at_places.drop("cx", "cy"), (F.col("x") == F.col("position_x")) & (F.col("y") == F.col("position_y")) & (placed["supplier_name"] == at_places["supplier_name"]) & (F.col("own") != F.col("layout_hash")))
    found = found.unionByName(other.select("invoice_id", F.lit(False).alias("same"), "x", "y", "pattern_id", "position_x", "position_y"))
    s = similarity(F.col("same"), F.col("position_x"), F.col("position_y"), F.col("x"), F.col("y"))
    scored = found.withColumn("similarity", s).filter(F.col("similarity") >= threshold)
    order = Window.partitionBy("invoice_id").orderBy(F.desc("similarity"), "pattern_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("invoice_id", "rank", "pattern_id", "similarity")


def boost(candidates: DataFrame, matches: DataFrame, amount: float = 0.1) -> DataFrame:
    """Candidate scores raised by ``amount`` (at most to 1) where their invoice has a matching pattern."""
    hit = matches.filter("rank = 1").select("invoice_id", F.lit(amount).alias("_boost"))
    return candidates.join(hit, "invoice_id", "left").withColumn("score", F.least(F.lit(1.0), F.col("score") + F.coalesce("_boost", F.lit(0.0)))).drop("_boost")


def without_conflicts(patterns: DataFrame) -> DataFrame:
    """Of patterns in one supplier, layout and 10-point cell with different totals only the most used stays
    (then the largest boost, then the smallest id). Cells that agree stay whole."""
    cell = F.when(F.col("position_x").isNotNull() & F.col("position_y").isNotNull(), F.concat_ws("::", F.floor(F.col("position_x") / 10), F.floor(F.col("position_y") / 10))).otherwise("none")
    keyed = patterns.withColumn("_cell", cell)
    keys = ["supplier_name", "layout_hash", "_cell"]
    facts = keyed.groupBy(keys).agg(F.min("correct_total").alias("_lo"), F.max("correct_total").alias("_hi"), F.max_by("pattern_id", F.struct("usage_count", "confidence_boost", -F.col("pattern_id"))).alias("_best"))
    return keyed.join(facts, keys).filter(F.col("_lo").eqNullSafe(F.col("_hi")) | (F.col("pattern_id") == F.col("_best"))).drop("_cell", "_lo", "_hi", "_best")


def clean_up(patterns: DataFrame, now: Column, *, max_age_days: int = 90, min_usage: int = 1) -> DataFrame:
    """Adds ``kept``: used within the age and often enough."""
    return patterns.withColumn("kept", F.coalesce((F.col("last_used") >= now - F.expr(f"interval {max_age_days} days")) & (F.col("usage_count") >= min_usage), F.lit(False)))


def consolidate(patterns: DataFrame, *, max_distance: float = 50.0) -> DataFrame:
    """Greedy leaders in (usage, last use) order within a supplier's layout: patterns within ``max_distance`` of a leader merge
    into it (usage summed, latest use kept). Patterns without a position stay.

    A pattern at the place of an earlier one joins the same leader, so places are summed up first. A layout's places then
    stream in order through one task that holds nothing but the leaders, which lie more than ``max_distance`` apart on a page."""
    keys = ["supplier_name", "layout_hash"]
    patterns = patterns.withColumn("last_used", F.col("last_used").cast("timestamp"))
    placed = patterns.filter("position_x is not null and position_y is not null")
    order = F.struct((-F.col("usage_count")).alias("u"), (-F.unix_micros("last_used")).alias("t"), F.col("pattern_id").alias("id"))
    places = placed.groupBy(*keys, "position_x", "position_y").agg(F.min(order).alias("o"), F.sum("usage_count").alias("u"), F.max("last_used").alias("t"), F.count(F.lit(1)).alias("n"))
    stream = places.repartition(*keys).sortWithinPartitions(*keys, "o").select(*keys, "position_x", "position_y", F.col("o.id").alias("pattern_id"), "u", "t", "n")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, leaders, ids = None, np.zeros((0, 2)), []
        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True))
            at = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)])
            own, to = batch.column(4).to_pylist(), [None] * batch.num_rows
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if names[a : a + 1] != [layout]:
                    layout, leaders, ids = names[a] if names else None, np.zeros((0, 2)), []
                near = _nearby(at[a:b], leaders, max_distance)
                for i in np.flatnonzero(near < 0).tolist():
                    if near[i] < 0:  # nobody before it is near: a leader, for all after it that have none
                        leaders = np.vstack([leaders, at[a + i]])
                        ids.append(own[a + i])
                        free = np.flatnonzero(near < 0)
                        free = free[free >= i]
                        near[free[_nearby(at[a + free], at[a + i][None, :], max_distance) == 0]] = len(ids) - 1
                to[a:b] = [ids[j] for j in near.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(to, batch.schema.field(4).type), *(batch.column(i) for i in (5, 6, 7))], names=[*keys, "pattern_id", "u", "t", "n"])

    kinds = dict(stream.dtypes)
    merged = stream.mapInArrow(merge, f"supplier_name string, layout_hash string, pattern_id {kinds['pattern_id']}, u long, t timestamp, n long")
    out = merged.groupBy(*keys, "pattern_id").agg(F.sum("u").alias("usage_count"), F.max("t").alias("last_used"), F.sum("n").alias("merged"))
    alone = patterns.filter("position_x is null or position_y is null").select(*keys, "pattern_id", F.col("usage_count").cast("long"), "last_used", F.lit(1).cast("long").alias("merged"))
    return out.unionByName(alone)


def _nearby(points: np.ndarray, leaders: np.ndarray, reach: float) -> np.ndarray:
    """The first leader within ``reach`` of each point, or -1."""
    if not len(leaders) or not len(points):
        return np.full(len(points), -1)
    close = ((points[:, None, :] - leaders[None, :, :]) ** 2).sum(2) <= reach * reach
    return np.where(close.any(1), close.argmax(1), -1)


def update_where(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """The table with ``changes`` where ``condition`` holds."""
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.filter(~F.coalesce(condition, F.lit(False)))
