"""Page layout: anchored rows, reading order, bands, columns, wrapped rows, invoice boundaries.

Folds run over one page's (or file's) array, which a page bounds; arrays hold keys and
coordinates only, and anchors are kept instead of a label per token, so folds stay linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import let


def anchors(ys: Column, tolerance: Column) -> Column:
    """First y of each row: a new row starts where y is more than ``tolerance`` below the row's first y."""
    return F.aggregate(F.array_sort(ys), F.slice(ys, 1, 0), lambda a, y: F.when((F.size(a) == 0) | (y - F.element_at(a, -1) > tolerance), F.concat(a, F.array(y))).otherwise(a))


def _by_page(tokens: DataFrame, page: tuple[str, ...], limit: Column, extra: dict[str, Column]) -> DataFrame:
    """Tokens with the row each belongs to (``_row``): pages are gathered once, in one shuffle, and each token finds its
    row among the page's anchors. A page bounds the arrays."""
    rest = [c for c in tokens.columns if c not in page]
    paged = tokens.groupBy(*page).agg(F.collect_list(F.struct(*rest)).alias("_tokens"), limit.alias("_limit"), *[c.alias(n) for n, c in extra.items()])
    ys = F.array_distinct(F.transform("_tokens", lambda t: t["y"]))
    marked = paged.withColumn("_anchors", anchors(ys, F.col("_limit")))
    placed = F.transform("_tokens", lambda t: F.struct(*[t[c].alias(c) for c in rest], (F.size(F.filter("_anchors", lambda a: a <= t["y"])) - 1).alias("_row")))
    return marked.select(*page, *extra, F.inline(placed))


def group_rows(tokens: DataFrame, *, page: tuple[str, ...] = ("doc_id", "page_number"), tolerance: Column | None = None) -> DataFrame:
    """Tokens (text, x, y, width, page_height) with ``row_idx`` from 0 in each page."""
    limit = F.least(F.lit(5.0), F.max("page_height") * 0.02) if tolerance is None else tolerance
    return _by_page(tokens, page, limit, {}).withColumnRenamed("_row", "row_idx")


def row_table(tokens: DataFrame, *, page: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Rows: mean y, x range, text in x order, height of the first token."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("x", "token_idx", "text"))), lambda t: t["text"])
    return tokens.groupBy(*page, "row_idx").agg(F.avg("y").alias("y"), F.min("x").alias("x_min"), F.max(F.col("x") + F.col("width")).alias("x_max"), F.array_join(words, " ").alias("text"), F.max("page_height").alias("page_height"), F.min_by("height", F.struct("x", "token_idx")).alias("height"))


def reading_tolerance(height: Column) -> Column:
    return F.greatest(F.lit(2.0), F.least(F.lit(15.0), height * 0.5))


def reading_order(tokens: DataFrame, *, page: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Tokens with ``position`` from 0: by anchored row (half the median height, 2 to 15 points), then x."""
    placed = _by_page(tokens, page, reading_tolerance(F.median("height")), {})
    order = Window.partitionBy(*page).orderBy("_row", "x", "token_idx")
    return placed.withColumn("position", F.row_number().over(order) - 1).drop("_row")


def bands(rows: DataFrame) -> DataFrame:
    """Rows with ``segment_type``: header above 0.3 of the height, footer below 0.7, items between."""
    h = F.col("page_height")
    return rows.withColumn("segment_type", F.when(F.col("y") < h * 0.3, "header").when(F.col("y") > h * 0.7, "footer").otherwise("items"))


def segments(rows: DataFrame, *, page: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Segments with row count and y range; a page with footer rows only also has an items segment with all rows."""
    banded = bands(rows)
    flags = banded.groupBy(*page).agg(F.bool_and(F.col("segment_type") == "footer").alias("_only"))
    copies = banded.join(flags, list(page)).withColumn("segment_type", F.explode(F.when(F.col("_only"), F.array(F.lit("footer"), F.lit("items"))).otherwise(F.array("segment_type"))))
    return copies.groupBy(*page, "segment_type").agg(F.count(F.lit(1)).alias("n_rows"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def _bottom(rows: DataFrame) -> Column:
    """Where a row ends: 12 points below its y where its height is not known."""
    return F.col("y") + (F.coalesce("height", F.lit(12.0)) if "height" in rows.columns else F.lit(12.0))


def gap_threshold(rows: DataFrame, *, page: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """1.5 times the page's median positive gap between a row's end and the next row; 15 without one."""
    gap = F.lead("y").over(Window.partitionBy(*page).orderBy("y", "row_idx")) - _bottom(rows)
    return rows.withColumn("_gap", gap).groupBy(*page).agg(F.coalesce(F.median(F.when(F.col("_gap") > 0, F.col("_gap"))) * 1.5, F.lit(15.0)).alias("gap_threshold"))


def absorb_wraps(rows: DataFrame, *, page: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Rows with ``line_number``: a row with an amount or a start mark (``starts``) begins a line; later rows of its run join it while
    the gap stays within the page's threshold and x is within 2 % of the page width left or 5 % right of the line's start."""
    order = Window.partitionBy(*page).orderBy("y", "row_idx")
    joined = rows.join(gap_threshold(rows, page=page), list(page))
    line = joined.withColumn("line_number", F.sum(F.col("starts").cast("int")).over(order)).withColumn("_gap", F.col("y") - F.lag(_bottom(rows)).over(order))
    own = Window.partitionBy(*page, "line_number")
    start_x = F.min(F.when(F.col("starts"), F.col("x_min"))).over(own)
    fits = F.col("starts") | ((F.col("_gap") <= F.col("gap_threshold")) & (F.col("x_min") - start_x).between(F.col("page_width") * -0.02, F.col("page_width") * 0.05))
    # The first row that does not fit ends the line's run.
    run = F.min(fits.cast("int")).over(own.orderBy("y", "row_idx").rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("absorbed", (run == 1) & (F.col("line_number") > 0)).drop("_gap")


def invoice_boundaries(pages: DataFrame, *, file: str = "doc_id") -> DataFrame:
    """(file, page_start, page_end) from pages with page_number, invoice_no and counter struct(current, total).

    A changed invoice number starts an invoice; without a number, a broken page counter does, and then no number is current. The
    first number found starts none. The fold keeps the starts, the current number and the last counter."""
    page = F.struct("page_number", "invoice_no", F.col("counter.current").alias("cur"), F.col("counter.total").alias("tot"))
    lists = pages.groupBy(file).agg(F.array_sort(F.collect_list(page)).alias("p"))
    state = lambda starts, number, cur, tot: F.struct(starts.alias("starts"), number.alias("number"), cur.alias("cur"), tot.alias("tot"))
    first = F.get("p", F.lit(0))

    def step(a: Column, p: Column) -> Column:
        changed = p["invoice_no"].isNotNull() & a["number"].isNotNull() & (p["invoice_no"] != a["number"])
        follows = (p["cur"] == a["cur"] + 1) & ((p["tot"] == a["tot"]) | p["tot"].isNull() | a["tot"].isNull())
        broken = p["invoice_no"].isNull() & p["cur"].isNotNull() & a["cur"].isNotNull() & ~follows
        opens = F.coalesce(changed, F.lit(False)) | F.coalesce(broken, F.lit(False))
        starts = F.when(opens & (p["page_number"] > F.element_at(a["starts"], -1)), F.concat(a["starts"], F.array(p["page_number"]))).otherwise(a["starts"])
        number = F.when(p["invoice_no"].isNotNull(), p["invoice_no"]).when(F.coalesce(broken, F.lit(False)), F.lit(None).cast("string")).otherwise(a["number"])
        return state(starts, number, p["cur"], p["tot"])

    start = state(F.array(first["page_number"]), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"))
    folded = lists.select(file, F.aggregate("p", start, step)["starts"].alias("s"), F.element_at("p", -1)["page_number"].alias("last"))
    spans = folded.select(file, "s", "last", F.posexplode("s").alias("i", "page_start"))
    return spans.select(file, "page_start", F.coalesce(F.get("s", F.col("i") + 1) - 1, F.col("last")).cast("int").alias("page_end"))


def assign_columns(tokens: DataFrame, centers: str | list[float] = "centers", page_width: Column | None = None) -> DataFrame:
    """Tokens with ``column``: the span they overlap most (ties to the left), else the nearest centre.

    Centres known beforehand are plain comparisons, compiled with their stage; centres that vary by row come as an array column."""
    width = page_width if page_width is not None else F.col("page_width")
    left, right = F.col("x"), F.col("x") + F.col("width")
    if not isinstance(centers, str):
        edges = [F.lit(0.0), *[F.lit((a + b) / 2) for a, b in zip(centers, centers[1:], strict=False)], width]
        overlap = [F.greatest(F.lit(0.0), F.least(right, b) - F.greatest(left, a)) for a, b in zip(edges, edges[1:], strict=False)]
        distance = [F.abs(F.lit(c) - (left + F.col("width") / 2)) for c in centers]
        first = lambda values, best: F.coalesce(*[F.when(v == best, i) for i, v in enumerate(values)])
        best, near = (values[0] if len(values) == 1 else f(*values) for f, values in ((F.greatest, overlap), (F.least, distance)))
        return tokens.withColumn("column", F.when(best > 0, first(overlap, best)).otherwise(first(distance, near)))
    return tokens.withColumn("column", column_of(left, F.col("width"), F.col(centers), width).cast("int"))


def column_of(x: Column, width: Column, centers: Column, page_width: Column) -> Column:
    """The place in ``centers`` of the span that a token overlaps most (ties to the left), else of the nearest centre; NULL without centres."""
    before = lambda c, i: F.coalesce((c + F.get(centers, F.when(i > 0, i - 1))) / 2, F.lit(0.0))
    after = lambda c, i: F.coalesce((c + F.get(centers, i + 1)) / 2, page_width)
    overlap = lambda c, i: F.greatest(F.lit(0.0), F.least(x + width, after(c, i)) - F.greatest(x, before(c, i)))
    spans = F.transform(centers, lambda c, i: F.struct((-overlap(c, i)).alias("o"), i.alias("i"), F.abs(c - (x + width / 2)).alias("d")))
    nearest = lambda s: F.array_min(F.transform(s, lambda v: F.struct(v["d"].alias("d"), v["i"].alias("i"))))["i"]
    return let(spans, lambda s: let(F.array_min(s), lambda best: F.when(best["o"] < 0, best["i"]).otherwise(nearest(s))))
