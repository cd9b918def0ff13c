"""Toxicity: a learned weighted lexicon matched by Aho-Corasick over folded text.

Folding. Compatibility forms and accents fold to their base letters, look-alikes of other scripts
to Latin, A-Z to lower case; zero-width characters go. A second reading of the text also turns
digits and signs that stand for letters into them; a match there counts only if the first reading
has none at that place. A match must start at a word start; whole-word entries must end at one.

Lexicon. From a bounded sample of labelled rows (about ``sample`` per class, by id hash): entries are
folded words of any length and word stems of 4 to 6 letters; each row counts an entry once. An entry is kept
when it is in ``least`` toxic rows or more and its smoothed log-odds less their standard error exceed
``odds``; the weight is the log-odds. Counting runs as a group-by; the entries that reach the driver are bounded by the words of the sample.

Exceptions. A phrase (an entry's word with the word before or after it, whatever lies between) that occurs in ``least``
clean sample rows and no toxic one is an exception: a match inside it does not count. Callers can
pass further phrases.

Score. A logistic function of two numbers, fitted on the sample and corrected for its class shares:
the log of the total weight, and of the weight per 100 words. Labels, language, source and id
are never inputs.

Defined cases: null and empty texts score like a text without a match; without labelled rows of both
classes the lexicon is empty and every score is the smoothed share of label 1; rows with null
labels don't train; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import labelled_sample, with_text

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {c: chr(c + 32) for c in range(65, 91)}
    blocks = [range(0xA0, 0x250), range(0x370, 0x530), range(0x1D00, 0x1F00), range(0x2100, 0x2150), range(0x2460, 0x2500), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800)]
    for cp in (c for b in blocks for c in b):
        base = unicodedata.normalize("NFKD", chr(cp)).lower()
        base = "".join(LOOKALIKES.get(ch, ch) for ch in base if not unicodedata.combining(ch))
        base = LOOKALIKES.get(chr(cp).lower(), base)
        if len(base) == 1 and base != chr(cp) and base.isalpha():
            table[cp] = base
    table |= {ord(c): v for c, v in LOOKALIKES.items()}
    table |= dict.fromkeys((*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
    return table


FOLD = _fold_table()
_LEET = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"[^\W\d_][013457-9@$!|€]|[013457-9@$!|€][^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")
_LEET_WORD = re.compile(r"[^\W_]*[^\W\d_][\w@$!|€]*")


def fold_text(text: str) -> str:
    return text.lower().translate(FOLD) if not text.isascii() else text.lower()


def word_before(text: str, at: int) -> str:
    """The word nearest before ``at``, however far; "" if none."""
    end = at
    while end and not _WORD.match(text, end - 1):
        end -= 1
    start = end
    while start and _WORD.match(text, start - 1, start):
        start -= 1
    return text[start:end]


@dataclass
class Lexicon:
    """``words`` match whole words, ``stems`` word starts; both map to weights. ``phrases`` are exceptions."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    phrases: frozenset[str] = frozenset()
    bias: float = -2.0
    slopes: tuple[float, float] = (0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for word in {*self.words, *self.stems}:
            made.add_word(word, (len(word), self.words.get(word), self.stems.get(word)))
        if len(made):
            made.make_automaton()
        return made

    def matches(self, text: str | None, automaton: ahocorasick.Automaton) -> dict[int, tuple[str, float]]:
        """Word starts in the folded text, with the entry and the largest weight that matches there."""
        if not text or not len(automaton):
            return {}
        plain, found = fold_text(text), {}
        readings = [plain, plain.translate(_LEET)] if _MIXED.search(plain) else [plain]
        for reading in readings:
            for end, (size, whole, stem) in automaton.iter(reading):
                at = end - size + 1
                if at and (reading[at - 1].isalpha() and plain[at - 1].isalpha()):
                    continue
                closed = end + 1 == len(plain) or not reading[end + 1].isalpha() or not plain[end + 1].isalpha()
                weight = max((whole or 0.0) if closed else 0.0, stem or 0.0)
                if weight > found.get(at, ("", 0.0))[1] and not (self.phrases and self._excepted(reading, at)):
                    found[at] = (reading[at : end + 1], weight)
        return found

    def _excepted(self, reading: str, at: int) -> bool:
        word = _WORD.match(reading, at)
        if not word:
            return False
        before, after = word_before(reading, at), _WORD.search(reading, word.end())
        return bool(before) and f"{before} {word[0]}" in self.phrases or bool(after) and f"{word[0]} {after[0]}" in self.phrases

    def numbers(self, text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float]:
        total = sum(w for _, w in self.matches(text, automaton).values())
        words = text.count(" ") + text.count("\n") + 1 if text else 1
        return math.log1p(total), math.log1p(100 * total / words)

    def score(self, text: str | None, automaton: ahocorasick.Automaton) -> float:
        a, b = self.numbers(text, automaton)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slopes[0] * a + self.slopes[1] * b))))


def entries_of(text: str | None) -> set[str]:
    """Words, and stems with a closing ``*``, of a text's folded reading."""
    out: set[str] = set()
    if text:
        plain = fold_text(text)
        words = set(_WORD.findall(plain))
        if _MIXED.search(plain):
            words |= {w for x in _LEET_WORD.findall(plain) for w in _WORD.findall(x.translate(_LEET))}
        out = words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) >= n}
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for e in entries_of(text):
                counts.setdefault(e, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))], names=["entry", "clean", "toxic"])


def _phrases(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            rows: list[tuple[str, int]] = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: set[str] = set()
                if text and (hits := lexicon.matches(text, automaton)):
                    plain = fold_text(text)
                    spans = [(m.start(), m[0]) for m in _WORD.finditer(plain)]
                    for i, (at, word) in enumerate(spans):
                        if at in hits:
                            seen |= {f"{spans[j][1]} {spans[j + 1][1]}" for j in (i - 1, i) if 0 <= j < len(spans) - 1}
                rows += [(p, toxic) for p in seen]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["phrase", "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for weighted logistic regression; the first column is the constant."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) / len(y) + keep * w * 0.1
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + np.diag(keep) * 0.1
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 6000, least: int = 5, odds: float = 2.5, exceptions: frozenset[str] = frozenset()) -> Lexicon:
    """A lexicon from the texts of ``docs`` and the 0/1 labels of ``labels``; about ``sample`` rows of each label are used."""
    known = labels.filter(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("_y"))
    share = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    prior = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
    lexicon = Lexicon(bias=math.log(prior / (1 - prior)), phrases=frozenset(exceptions))
    picked = labelled_sample(docs, known, share, id_col=id_col, text_col=text_col, label_col="_y", per_label=sample)
    seen = {r[0]: r[1] for r in picked.groupBy("_label").count().collect()}
    if len(seen) < 2:
        return lexicon
    n0, n1 = seen[0], seen[1]
    p = picked.mapInArrow(_counted, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    log_odds = F.log((F.col("toxic") + 0.5) / (n1 + 1) / ((F.col("clean") + 0.5) / (n0 + 1)))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    kept = p.filter(F.col("toxic") >= least).withColumn("w", log_odds).filter(F.col("w") - error > odds)
    for entry, clean, toxic, w in kept.collect():
        if entry.endswith("*"):
            lexicon.stems[entry[:-1]] = w
        else:
            lexicon.words[entry] = w
    phrase = picked.mapInArrow(_phrases(lexicon), "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    lexicon.phrases |= frozenset(r[0] for r in phrase.filter((F.col("t") == 0) & (F.col("n") >= least)).collect())

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            both = [lexicon.numbers(t, automaton) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in both], pa.float64()), pa.array([b[1] for b in both], pa.float64()), batch.column(1)], names=["a", "b", "y"])

    rows = np.array([tuple(r) for r in picked.mapInArrow(measured, "a double, b double, y int").collect()])
    weight = np.where(rows[:, 2] == 1, share[1] / n1, share[0] / n0)
    w = _logistic(np.column_stack([np.ones(len(rows)), rows[:, :2]]), rows[:, 2], weight / weight.mean())
    lexicon.bias, lexicon.slopes = float(w[0]), (float(w[1]), float(w[2]))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, *, id_cols: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``id_cols`` and ``score_col`` (0 to 1) for every row; an error if ``id_cols`` holds ``score_col``."""
    kept, at, fields = with_text(docs, id_cols, text_col, (score_col,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            scores = pa.array([lexicon.score(t.as_py(), automaton) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], scores], names=[*id_cols, score_col])

    return kept.mapInArrow(run, f"{fields}, `{score_col}` double")
