"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w.x) with one weight vector for all grades and ordered
thresholds (each is the one before plus an exponential). x is hashed text: character 1- to
3-grams (case kept) and words as log counts scaled to length one, and bucketed whole-text
statistics (share of capitals, of signs, of repeated words and lines, mean word length, length) as
further hashed entries. A text gets its expected grade and the tail probability P(grade >= k)
for selection.

Bounds. The fit uses at most ``sample`` rows of each grade and 4,096 together; their features
(``SLOTS`` half floats a row) are made on the executors. Weights are fitted by Adam on all sample rows, in row
order of a hash, so the fit is deterministic.

Defined cases: null text counts as empty; the empty text has only its statistics; rows with a null
grade don't train; with fewer than two grades every text gets that grade (0 if none) and tail
probability 0 or 1; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import labelled_sample, with_text

SLOTS, BATCH = 4096, 256
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_SHIFT = np.uint32(32 - (SLOTS - 1).bit_length())
STATISTICS = 0.35


def featurise(text: str | None, out: np.ndarray) -> None:
    """Write the features of one text into ``out`` (one row of ``SLOTS`` floats)."""
    text = text or ""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = np.zeros(SLOTS, np.int64)
    h = np.zeros(len(c), np.uint32)
    for k in range(min(3, len(c))):
        h = h[: len(c) - k] * _A + c[k:] * _B + np.uint32(k + 1)
        counts += np.bincount((h ^ (h >> np.uint32(15))) * _A >> _SHIFT, minlength=SLOTS)
    words, lines = text.split(), text.split("\n")
    values = np.log1p(counts)
    norm = np.sqrt((values * values).sum())
    out += values / norm if norm else 0
    n = max(1, len(c))
    ascii_upper = int(((c >= 65) & (c <= 90)).sum())
    signs = int(((c >= 33) & (c <= 47) | (c >= 58) & (c <= 64) | (c >= 91) & (c <= 96) | (c >= 123) & (c <= 126)).sum())
    digits = int(((c >= 48) & (c <= 57)).sum())
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words) - 1)
    facts = {
        "upper": int(20 * ascii_upper / n), "signs": int(40 * signs / n), "digits": int(20 * digits / n),
        "distinct": int(20 * len(set(words)) / max(1, len(words))), "again": int(20 * repeated),
        "lines": int(10 * len(set(lines)) / max(1, len(lines))), "word": min(20, int(2 * (n / max(1, len(words))))), "length": n.bit_length(),
    }
    for name, bucket in facts.items():
        for width in (1, 2, 4):
            out[xxhash.xxh32_intdigest(f"{name}/{width}/{bucket // width}") % SLOTS] += STATISTICS


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1.. in columns."""
        z = np.clip((x @ self.weights)[:, None] - self.thresholds[None, :], -30, 30)
        return 1 / (1 + np.exp(-z))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(np.array(self.grades, float))


def _weights(grades: np.ndarray, shares: dict[int, int]) -> np.ndarray:
    """Sample rows count as their grade's share of all ratings, so the per-grade bound doesn't bend the thresholds."""
    seen = {g: (grades == g).sum() for g in shares}
    w = np.array([shares[g] / seen[g] for g in grades.tolist()])
    return w / w.mean() if len(w) else w


def fit(x: np.ndarray, grade: np.ndarray, *, weights: np.ndarray | None = None, rounds: int = 400, rate: float = 0.05, ridge: float = 2e-4) -> OrdinalModel:
    """Maximum likelihood with a ridge on the weights."""
    grades = sorted(set(grade.tolist()))
    k = np.searchsorted(grades, grade)
    cuts = len(grades) - 1
    each = np.ones(len(grade)) if weights is None else weights
    if cuts < 1:
        return OrdinalModel(np.zeros(SLOTS), np.zeros(0), grades or [0])
    above = np.array([each[k > j].sum() / each.sum() for j in range(cuts)])
    start = np.log((1 - above) / above)
    p = np.concatenate([np.zeros(x.shape[1]), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v, d = np.zeros_like(p), np.zeros_like(p), x.shape[1]
    for t in range(1, rounds + 1):
        theta = p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])
        z = x @ p[:d].astype(x.dtype)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        up, low = 1 / (1 + np.exp(np.clip(z - edge[k + 1], -40, 40))), 1 / (1 + np.exp(np.clip(z - edge[k], -40, 40)))
        up, low = np.where(k == cuts, 1.0, up), np.where(k == 0, 0.0, low)
        likelihood = np.maximum(up - low, 1e-9)
        du, dl = each * up * (1 - up) / likelihood, each * low * (1 - low) / likelihood
        g_theta = np.array([-(du[k == j].sum() - dl[k == j + 1].sum()) for j in range(cuts)]) / len(z)
        g = np.concatenate([x.T @ ((du - dl) / len(z)).astype(x.dtype) + ridge * p[:d], [g_theta.sum()], np.exp(p[d + 1 :]) * np.cumsum(g_theta[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))]), grades)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            row = np.zeros(SLOTS, np.float32)
            featurise(text, row)
            rows.append(row.astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], names=["x", "grade"])


def learn(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = 2048) -> OrdinalModel:
    """A model from the texts of ``docs`` and the grades of ``ratings`` (id and an integer grade)."""
    kept = ratings.select(F.col(id_col), F.col(grade_col).cast("int").alias("_grade")).dropna()
    shares = {r[0]: r[1] for r in kept.groupBy("_grade").count().collect()}
    per = max(1, min(sample, 4096 // max(1, len(shares))))
    rows = labelled_sample(docs, kept, shares, id_col=id_col, text_col=text_col, label_col="_grade", per_label=per).mapInArrow(_features, "x binary, grade int").collect()
    rows = sorted((bytes(r[0]), r[1]) for r in rows)
    x = np.frombuffer(b"".join(r[0] for r in rows), np.float16).reshape(len(rows), SLOTS).astype(np.float32)
    grades = np.array([r[1] for r in rows], int)
    return fit(x, grades, weights=_weights(grades, shares))


def grade(docs: DataFrame, model: OrdinalModel, *, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols``, ``expected_grade`` and ``tails`` (P(grade >= k) for each grade but the least)."""

    kept, text_at, fields = with_text(docs, id_cols, text_col, ("expected_grade", "tails"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tails = batch.column(text_at), []
            for at in range(0, len(texts), BATCH):
                x = np.zeros((len(texts[at : at + BATCH]), SLOTS), np.float32)
                for r, t in enumerate(texts[at : at + BATCH]):
                    featurise(t.as_py(), x[r])
                tails.append(model.tails(x.astype(np.float16).astype(np.float64)))
            all_tails = np.concatenate(tails) if tails else np.zeros((0, len(model.thresholds)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], pa.array(model.expected(all_tails), pa.float64()), pa.array(list(all_tails), pa.list_(pa.float64()))], names=[*id_cols, "expected_grade", "tails"])

    return kept.mapInArrow(run, f"{fields}, expected_grade double, tails array<double>")
