"""Token scans behind an interface: document readers, page renderers and text recognisers are plugged in, Spark does the rest.

No reader of this kind is built in. An engine is an object that can be pickled; it runs on the executors, a document or page at
a time. What it raises becomes the row's ``error``, so that one bad file does not end a batch.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import content_score

PAGES = "path string, page_number int, page_width double, page_height double, error string"
TOKENS = "path string, page_number int, token_idx int, text string, x double, y double, width double, height double, font_size double, font_name string, confidence double, page_width double, page_height double"
#: Resolutions of the first and the second scan, mean confidence below which the second is made, and confidences of routing.
BASE_DPI, RETRY_DPI, RETRY_BELOW, ROUTE_MEDIAN, LOW_WORD = 300, 400, 55, 70, 50


class TextLayer(ABC):
    """Reads the text layer of documents."""

    @abstractmethod
    def pages(self, content: bytes) -> Iterator[tuple[float, float]]:
        """Width and height of each page, in order."""

    @abstractmethod
    def tokens(self, content: bytes, page: int) -> Iterator[dict]:
        """text, x, y, width, height and optionally font_size, font_name of a page's tokens, in text order."""


class Recogniser(ABC):
    """Recognises the words of a page's picture."""

    @abstractmethod
    def render(self, content: bytes, page: int, dpi: int) -> bytes:
        """A picture of the page."""

    @abstractmethod
    def words(self, picture: bytes) -> tuple[float, float, Iterator[dict]]:
        """Width and height of the picture, and text, x, y, width, height (pixels) and confidence (0..100, negative for none) of its words."""


def documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path and content of the matching files below ``folder``, each a document of a batch."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def read_pages(docs: DataFrame, layer: TextLayer) -> DataFrame:
    """A row a page; a document that cannot be read, or has no page, is one row with ``error``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[tuple] = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    found = [(path, i, float(w), float(h), None) for i, (w, h) in enumerate(layer.pages(bytes(content)), 1)]
                    rows += found or [(path, None, None, None, "no pages")]
                except Exception as why:
                    rows.append((path, None, None, None, f"{type(why).__name__}: {why}"))
            yield pd.DataFrame(rows, columns=["path", "page_number", "page_width", "page_height", "error"]).astype({"page_number": "Int32"})

    return docs.select("path", "content").mapInPandas(run, PAGES)


def _rows(path: str, page: int, size: tuple[float, float], found: Iterator[dict]) -> list[tuple]:
    kept = [t for t in found if (t.get("text") or "").strip() and t["width"] > 0 and t["height"] > 0]
    return [(path, page, i, t["text"], float(t["x"]), float(t["y"]), float(t["width"]), float(t["height"]), t.get("font_size"), t.get("font_name"), t.get("confidence"), *size) for i, t in enumerate(kept)]


def _scan(docs: DataFrame, pages: DataFrame, read) -> DataFrame:
    joined = pages.filter("error is null").join(docs, "path").select("path", "content", "page_number", "page_width", "page_height")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [row for r in part.itertuples(index=False) for row in _rows(r.path, int(r.page_number), (r.page_width, r.page_height), read(bytes(r.content), int(r.page_number), r.page_width, r.page_height))]
            made = pd.DataFrame(rows, columns=[f.split()[0] for f in TOKENS.split(", ")])
            yield made.astype({"font_size": float, "confidence": float})

    return joined.mapInPandas(run, TOKENS)


def scan_text(docs: DataFrame, pages: DataFrame, layer: TextLayer) -> DataFrame:
    """Tokens of the text layer; empty words and boxes without extent are left out."""
    return _scan(docs, pages, lambda content, page, w, h: layer.tokens(content, page))


def scan_pictures(docs: DataFrame, pages: DataFrame, engine: Recogniser, *, dpi: int = BASE_DPI) -> DataFrame:
    """Recognised tokens in points, from top to bottom, then left to right; words without a confidence are left out."""

    def read(content: bytes, page: int, width: float, height: float) -> Iterator[dict]:
        across, down, words = engine.words(engine.render(content, page, dpi))
        kept = [w for w in words if w["confidence"] >= 0]
        a, b = width / across, height / down
        return iter(sorted(({**w, "x": w["x"] * a, "y": w["y"] * b, "width": w["width"] * a, "height": w["height"] * b} for w in kept), key=lambda w: (w["y"], w["x"])))

    return _scan(docs, pages, read)


def page_metrics(tokens: DataFrame, page: tuple[str, ...] = ("path", "page_number")) -> DataFrame:
    """mean_conf, median_conf and low_conf_fraction of a page's tokens with a confidence of 0 or more; 0, 0 and 1 without any."""
    c = F.when(F.col("confidence") >= 0, F.col("confidence"))
    return tokens.groupBy(*page).agg(F.coalesce(F.avg(c), F.lit(0.0)).alias("mean_conf"), F.coalesce(F.median(c), F.lit(0.0)).alias("median_conf"), F.coalesce(F.avg((c < LOW_WORD).cast("double")), F.lit(1.0)).alias("low_conf_fraction"))


def scan_twice(docs: DataFrame, pages: DataFrame, engine: Recogniser) -> DataFrame:
    """Recognised tokens; pages whose mean confidence is too low are scanned again in finer pictures, and that scan is taken."""
    first = scan_pictures(docs, pages, engine)
    poor = page_metrics(first).filter(F.col("mean_conf") < RETRY_BELOW).select("path", "page_number")
    again = scan_pictures(docs, pages.join(poor, ["path", "page_number"]), engine, dpi=RETRY_DPI)
    return first.join(poor, ["path", "page_number"], "left_anti").unionByName(again)


def mean_confidence(confidence: Column) -> Column:
    """Mean of a group's confidences as a share; 1 without any."""
    c = F.when(confidence >= 0, confidence)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(c) / 100.0)), F.lit(1.0))


def scan_quality(tokens: DataFrame, page: tuple[str, ...] = ("path", "page_number")) -> DataFrame:
    """``quality`` of a page's tokens: half the text's, half the median confidence; the text's alone without confidences."""
    c = F.when(F.col("confidence") >= 0, F.col("confidence"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "text"))), lambda t: t["text"]), " ")
    paged = tokens.groupBy(*page).agg(text.alias("_t"), F.median(c).alias("_c")).withColumn("_s", content_score(F.col("_t")))
    return paged.select(*page, F.when(F.col("_c").isNull(), F.col("_s")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s") * 0.5 + F.col("_c") / 200.0))).alias("quality"))


class Enricher(ABC):
    """A service that reads an invoice's total from its text. Off unless given; the library makes no network call of its own."""

    @abstractmethod
    def ask(self, text: str, lines_sum: float | None, strict: bool) -> str:
        """The service's reply; ``strict`` asks for nothing but JSON."""


def enrich(texts: DataFrame, service: Enricher) -> DataFrame:
    """invoice_id and reply (NULL where the service fails twice) for rows with invoice_id, text and lines_sum. A reply without an object
    is asked for once more, strictly."""
    kinds = dict(texts.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            replies = []
            for text, total in zip(part["text"], part["lines_sum"], strict=True):
                reply = None
                for strict in (False, True):
                    try:
                        reply = service.ask(text or "", None if pd.isna(total) else float(total), strict)
                    except Exception:
                        continue  # a service that fails gives no reply; the row says so
                    if reply and "{" in reply:
                        break
                replies.append(reply)
            yield pd.DataFrame({"invoice_id": part["invoice_id"], "reply": replies})

    return texts.select("invoice_id", "text", F.col("lines_sum").cast("double").alias("lines_sum")).mapInPandas(run, f"invoice_id {kinds['invoice_id']}, reply string")
