"""Secret scan: pattern spans plus a randomness test battery with false-discovery control.

Method. Every maximal run of ``SHORTEST`` or more encoding characters is a candidate. Its encoding (hex, lower, upper,
base32, base62, base64, base64url) is the smallest alphabet that holds all its symbols. Three tests ask whether the
symbols look uniform and independent in that alphabet: chi-squared on equal symbol bins, Wald-Wolfowitz runs
about the alphabet's middle, and lag-1 serial correlation; Fisher's method joins their p-values into one, B. Against
the null of ordinary text, the likelihood ratio of "uniform" to a fixed first-order model of words and identifiers
is an e-value, and so is its product with B, which is at most 1: ``1 / (ratio * B)`` bounds the chance that ordinary text of
that length looks as random (Markov's inequality), and a run that fails the battery loses its evidence by as much
as it fails. Benjamini-Hochberg is applied over all candidates of the corpus, separately in each length band
(powers of two, of any length), so that many short words cannot drown long keys. The first pass over the texts
sends only counts per (band, p bin) to the driver, at most 28 x 122 numbers; the second applies the thresholds. Of an accepted
run, the parts that no base span covers are reported. Digits alone are as likely in ordinary numbers and are never accepted.

Defined cases: null and empty text have no span; long runs are tested on all their
characters; rows repeat as they come; extra columns are ignored by
``scan_secrets`` and kept by ``redact``. Spans are code points, end exclusive, of the whole match.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_HINTS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Shorter runs cannot carry enough evidence in any band; a parameter of the method.
SHORTEST = 16
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: From the smallest alphabet to the largest.
ENCODINGS = (
    ("hex", _DIGIT + "abcdef"),
    ("hex_upper", _DIGIT + "ABCDEF"),
    ("lower", _LOWER),
    ("upper", _UPPER),
    ("base32", _UPPER + "234567"),
    ("base62", _UPPER + _LOWER + _DIGIT),
    ("base64", _UPPER + _LOWER + _DIGIT + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGIT + "-_"),
)
_INDEX = [(n, {c: i for i, c in enumerate(a)}, len(a)) for n, a in ENCODINGS]

#: Letters of running text, per mille (rounded averages of Latin-script languages).
LETTERS = dict(zip(_LOWER, (82, 15, 35, 42, 130, 18, 18, 40, 72, 3, 5, 40, 27, 70, 65, 22, 6, 65, 70, 85, 33, 11, 12, 4, 12, 4), strict=True))
_TOTAL = sum(LETTERS.values())
#: Log probability that ordinary text stays in a character class, or leaves it for one of the three others.
_STAY, _LEAVE = math.log(0.9), math.log(0.1 / 3)
_LOG = {c: math.log(v / _TOTAL) for c, v in LETTERS.items()}
_LOG |= {c.upper(): v for c, v in _LOG.items()} | dict.fromkeys(_DIGIT, math.log(0.1)) | dict.fromkeys("+/-_", math.log(0.25))
_CLASS = dict.fromkeys(_LOWER, 0) | dict.fromkeys(_UPPER, 1) | dict.fromkeys(_DIGIT, 2) | dict.fromkeys("+/-_", 3)

BINS, BIN_WIDTH = 121, 0.5


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by the Wilson-Hilferty cube-root normal."""
    return 1.0 if x <= 0 else _normal_tail(((x / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))


def battery(symbols: np.ndarray, size: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for symbols in 0..size-1."""
    n = len(symbols)
    bins = max(2, min(size, n // 5))
    counts = np.bincount(symbols * bins // size, minlength=bins)
    expected = n * np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    chi = chi2_tail(float(((counts - expected) ** 2 / expected).sum()), bins - 1)
    high = symbols * 2 >= size
    ones = int(high.sum())
    if 0 < ones < n:
        mean = 2 * ones * (n - ones) / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs = 2 * _normal_tail(max(0.0, abs(1 + int((high[1:] != high[:-1]).sum()) - mean) - 0.5) / math.sqrt(var))
    else:
        runs = 2.0 ** (1 - n) if n < 1000 else 0.0
    d = symbols - symbols.mean()
    power = float((d * d).sum())
    serial = 2 * _normal_tail(abs(float((d[1:] * d[:-1]).sum()) / power) * math.sqrt(n)) if power else 0.0
    return chi, min(1.0, runs), serial


def fisher(p_values: tuple[float, float, float]) -> float:
    """Natural log of the joint p-value of three tests: the upper tail of chi-squared with 6 degrees."""
    if min(p_values) <= 0:
        return -math.inf
    half = -sum(map(math.log, p_values))
    return -half + math.log1p(half + half * half / 2)


def surprise(run: str) -> tuple[str, float] | None:
    """The inferred encoding and minus the natural log of the p-value against ordinary text; None when no encoding
    fits or there is no evidence."""
    body = run.rstrip("=")
    symbols = set(body)
    found = next(((name, index, size) for name, index, size in _INDEX if symbols <= index.keys()), None)
    if not found:
        return None
    name, index, size = found
    kinds = [_CLASS[c] for c in body]
    ordinary = sum(_LOG[c] for c in body) + sum(_STAY if a == b else _LEAVE for a, b in zip(kinds, kinds[1:], strict=False))
    evidence = -len(body) * math.log(size) - ordinary
    if evidence > 0:  # the battery only lowers it
        evidence += fisher(battery(np.fromiter((index[c] for c in body), np.int64, len(body)), size))
    return (name, evidence) if evidence > 0 else None


def scan_text(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int, float]], list[int]]:
    """Base spans in order, random candidates as (start, end, band, surprise), and the length
    band of every run tested."""
    if not text:
        return [], [], []
    base: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        base += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found, tested = [], []
    for m in _RUN.finditer(text):
        run, at = m[0], m.start()
        if "AKIA" in run:
            base += [("access", at + x.start(), at + x.end()) for x in _ACCESS.finditer(run) if len(x[0]) >= 20]
        base += [("hex", at + x.start(), at + x.end()) for x in _HEX.finditer(run) if len(x[0]) >= 24]
        band = len(run).bit_length() - SHORTEST.bit_length()
        tested.append(band)
        if s := surprise(run):
            found.append((at, m.end(), band, s[1]))
    base.sort(key=lambda s: (s[1], _ORDER[s[0]]))
    return base, found, tested


BandCounts = dict[tuple[int, int], int]


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this partition by (band, bin of surprise); bin -1 counts every run tested."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            _, found, tested = scan_text(text)
            counts.update((band, -1) for band in tested)
            counts.update((band, min(BINS - 1, int(s / BIN_WIDTH))) for _, _, band, s in found)
    if counts:
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["band", "bin", "n"])


def discovery_bins(counts: BandCounts, rate: float) -> dict[int, int]:
    """Benjamini-Hochberg in each band: the lowest bin of surprise that is accepted there.

    A bin's candidates all count with the bin's largest p-value, so the control is conservative."""
    accept = {}
    for band in {k[0] for k in counts}:
        total, above = counts.get((band, -1), 0), 0
        for b in range(BINS - 1, -1, -1):
            above += counts.get((band, b), 0)
            if above and math.exp(-b * BIN_WIDTH) * total <= rate * above:
                accept[band] = b
    return accept


def thresholds(docs: DataFrame, *, text_col: str = "text", false_discovery_rate: float = 0.01) -> dict[int, int]:
    """The accepted bins over all texts of ``docs``, by length band."""
    binned = docs.select(F.col(text_col).cast("string")).mapInArrow(_bins, "band int, bin int, n long").groupBy("band", "bin").agg(F.sum("n"))
    return discovery_bins({(r[0], r[1]): r[2] for r in binned.collect()}, false_discovery_rate)


Span = tuple[str, int, int]


def uncovered(start: int, end: int, spans: list[Span]) -> Iterator[Span]:
    """The parts of a run that ``spans`` (in order of start) leave."""
    for _, a, b in spans:
        if b > start and a < end:
            if a > start:
                yield ("random", start, a)
            start = b
    if start < end:
        yield ("random", start, end)


def all_spans(text: str | None, accept: dict[int, int]) -> tuple[list[Span], list[Span]]:
    """The base spans, and those plus what they leave of the accepted random runs."""
    base, found, _ = scan_text(text)
    extra = [s for a, b, band, x in found if min(BINS - 1, int(x / BIN_WIDTH)) >= accept.get(band, BINS) for s in uncovered(a, b, base)]
    return base, sorted(base + extra, key=lambda s: (s[1], _ORDER[s[0]])) if extra else base


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", false_discovery_rate: float = 0.01) -> DataFrame:
    """One row per document: ``id_col``, ``base`` and ``spans`` (arrays of kind, start, end)."""
    accept = thresholds(docs, text_col=text_col, false_discovery_rate=false_discovery_rate)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [all_spans(t, accept) for t in batch.column(1).to_pylist()]
            out = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[i]] for x in both], _SPANS) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["_id", "base", "spans"])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    kept = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string"))
    return kept.mapInArrow(scan, f"_id {kept.dtypes[0][1]}, base {span}, spans {span}").withColumnRenamed("_id", id_col)


def digest(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_text(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = None, mark: str = "[secret]", false_discovery_rate: float = 0.01) -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark`` (overlapping spans by one mark)
    and ``chars_col``, where given, counted anew; all rows and other columns stay as they are."""
    accept = thresholds(docs, text_col=text_col, false_discovery_rate=false_discovery_rate)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(texts):
                if text and (spans := all_spans(text, accept)[1]):
                    texts[i] = redact_text(text, spans, mark)
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col else out
