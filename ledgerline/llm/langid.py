"""Language identification with a blended-spectrum string kernel.

Kernel. A text (lower-cased, runs of non-letters turned into one space) is the set of its character
1- to ``n``-grams, hashed into ``slots`` bits; k(x, y) = |x and y| / sqrt(|x| |y|). Nystroem: with
landmark texts L and n sample texts X, one-versus-rest kernel ridge regression restricted to the
span of the landmarks is alpha = (K_XL' K_XL + ridge n K_LL)^-1 K_XL' Y, and a text scores
k(x, L) alpha. A batch of texts is one 0/1 matrix and two matrix products.

Bounds. Every label is learned. Sample rows: about ``sample`` of each label and 4,096 together (one of each
label where there are more labels than that); landmarks: ``landmarks`` of those (one of each label where there are
more), spread evenly over the labels. Features of the sample (``slots``/8 bytes a row) are made on the executors.

Defined cases: null text, empty text and text without a letter give ``und`` with score 0; without
any training row everything is ``und``; rows with null labels don't train; ties go to the label that
sorts first; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import labelled_sample, with_text

SLOTS, BATCH = 8192, 128
_OTHER = re.compile(r"[\W\d_]+")
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def letters(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()) if text else ""


def presence(plain: str, out: np.ndarray, n: int = 3) -> None:
    """Mark the hashed 1- to n-grams of ``plain`` in ``out`` (one row of 0/1)."""
    c = np.frombuffer(plain.encode("utf-32-le", "replace"), np.uint32)
    h = np.zeros(len(c), np.uint32)
    shift = np.uint32(32 - (len(out) - 1).bit_length())
    for k in range(min(n, len(c))):
        h = h[: len(c) - k] * _A + c[k:] * _B + np.uint32(k + 1)
        out[(h ^ (h >> np.uint32(15))) * _A >> shift] = 1


@dataclass
class LanguageModel:
    labels: list[str]
    landmarks: np.ndarray  # slots x m, columns scaled to length one
    alpha: np.ndarray  # m x labels

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts) if self.labels else 0, BATCH):
            plain = [letters(t.as_py()) for t in texts[at : at + BATCH]]
            part = [at + i for i, p in enumerate(plain) if any(ch.isalpha() for ch in p)]
            if not part:
                continue
            x = np.zeros((len(part), self.landmarks.shape[0]), np.float32)
            for r, i in enumerate(part):
                presence(plain[i - at], x[r])
            f = (x @ self.landmarks) / np.sqrt(x.sum(1, keepdims=True)) @ self.alpha
            best = f.argmax(1)
            for r, i in enumerate(part):
                names[i] = self.labels[best[r]]
            scores[part] = np.clip(f[np.arange(len(part)), best], 0, 1)
        return names, scores


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = []
        for text in batch.column(0).to_pylist():
            row = np.zeros(SLOTS, np.uint8)
            presence(letters(text), row)
            bits.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), batch.column(1)], names=["bits", "label"])


def solve(k_xl: np.ndarray, k_ll: np.ndarray, target: np.ndarray, balance: np.ndarray, ridge: float) -> np.ndarray:
    """The weights of the landmarks that minimise the weighted squared error with the ridge."""
    a = (k_xl * balance).T @ (k_xl * balance) + ridge * len(k_xl) * k_ll + 1e-8 * np.eye(len(k_ll))
    return np.linalg.solve(a, (k_xl * balance).T @ (target * balance))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = 1000, landmarks: int = 256, ridge: float = 1e-4) -> LanguageModel:
    """A model from the rows of ``docs`` with a text and a label."""
    known = docs.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("_label"))
    counts = known.dropna().groupBy("_label").count().collect()
    names = sorted(r[0] for r in counts)
    empty = LanguageModel([], np.zeros((SLOTS, 0), np.float32), np.zeros((0, 0), np.float32))
    if not names:
        return empty
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_plain"))
    picked = labelled_sample(texts, known, {r[0]: r[1] for r in counts}, id_col="_id", text_col="_plain", label_col="_label", per_label=max(1, min(sample, 4096 // len(names))))
    rows = picked.mapInArrow(_features, "bits binary, label string").collect()
    if not rows:
        return empty
    rows = sorted((bytes(r[0]), r[1]) for r in rows)
    bits = np.unpackbits(np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    size = bits.sum(1, keepdims=True)
    bits, y = bits[size[:, 0] > 0] / np.sqrt(size[size > 0])[:, None], np.array([names.index(r[1]) for r in rows])[size[:, 0] > 0]
    if not len(y):
        return empty
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(names))])
    marks = bits[chosen]
    k_xl, k_ll = (bits @ marks.T).astype(np.float64), (marks @ marks.T).astype(np.float64)
    target = (y[:, None] == np.arange(len(names))).astype(np.float64)
    balance = np.sqrt(1 / np.bincount(y, minlength=len(names)).clip(1))[y][:, None] * np.sqrt(len(y) / len(names))
    alpha = solve(k_xl, k_ll, target, balance, ridge)
    return LanguageModel(names, np.ascontiguousarray(marks.T), alpha.astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, *, id_cols: list[str], text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``id_cols``, ``lang_col`` and ``score_col`` for every row; an error if ``id_cols`` holds one of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: slots x landmarks floats

    kept, at, fields = with_text(docs, id_cols, text_col, (lang_col, score_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], pa.array(names, pa.string()), pa.array(scores)], names=[*id_cols, lang_col, score_col])

    return kept.mapInArrow(run, f"{fields}, `{lang_col}` string, `{score_col}` double")
